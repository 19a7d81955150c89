"""Sources: producer tables, transcripts and files as episodes and documents."""
