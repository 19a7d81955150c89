"""All registered queries: importing the modules registers theirs."""

from annalist.plans import composed, governed, intake, memory, queries, registered

QUERIES, SQL = queries.QUERIES, queries.SQL
__all__ = ["QUERIES", "SQL", "composed", "governed", "intake", "memory", "registered"]
