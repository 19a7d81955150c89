"""Connected components of a graph given as a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import materialise


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the least node that each linked node reaches.

    ``links`` (a, b) are long pairs in either order; loops and repeats do no
    harm.  Each round links every node's larger neighbours to its least one,
    then its smaller ones, until every link points at a root; the links are
    written to the shared folder after each, so no lineage builds up.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = materialise(small.unionByName(root.select("a", F.col("m").alias("b"))).distinct())
        pairs = after
        # done when nothing is both a child and a parent, and no child has two parents
        ends = after.select(F.col("a").alias("n"), F.lit(1).alias("child")).unionByName(after.select(F.col("b").alias("n"), F.lit(0).alias("child")))
        per = ends.groupBy("n").agg(F.sum("child").alias("children"), F.min("child").alias("least"))
        if not per.where("children > 1 or (children = 1 and least = 0)").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
