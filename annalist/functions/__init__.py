"""Column functions: text, scores, time."""
