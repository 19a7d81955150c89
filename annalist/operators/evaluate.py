"""Retrieval and answer quality over tables of hits and golds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, golds: DataFrame, k: int = 5) -> DataFrame:
    """V1: per question the first rank of a gold document, and whether it is within k."""
    first = hits.join(golds, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    asked = golds.select("query_id").distinct().join(first, "query_id", "left")
    return asked.withColumn("hit", F.coalesce(F.col("first_rank") <= k, F.lit(False))).withColumn("rr", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))


def recall_at(hits: DataFrame, golds: DataFrame, k: int) -> DataFrame:
    """V2: share of a question's gold documents within the first k ranks."""
    found = hits.where(F.col("rank") <= k).select("query_id", "doc_id").distinct().withColumn("_hit", F.lit(1))
    met = golds.distinct().join(found, ["query_id", "doc_id"], "left")
    return met.groupBy("query_id").agg(F.round(F.count("_hit") / F.count("*"), 6).alias("recall"))


def normalize_answer(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def token_f1(pairs: DataFrame) -> DataFrame:
    """V3: token F1 of (id, predicted, gold), tokens counted as often as they stand."""
    each = lambda c: pairs.select("id", F.explode(F.split(normalize_answer(F.col(c)), " ")).alias("t")).where("t <> ''").groupBy("id", "t").agg(F.count("*").alias(c))
    both = each("predicted").join(each("gold"), ["id", "t"], "full_outer").fillna(0, ["predicted", "gold"])
    per = both.groupBy("id").agg(F.sum(F.least("predicted", "gold")).alias("same"), F.sum("predicted").alias("p"), F.sum("gold").alias("g"))
    f1 = F.when((F.col("p") + F.col("g")) > 0, 2 * F.col("same") / (F.col("p") + F.col("g"))).otherwise(0.0)
    return pairs.select("id").join(per.select("id", F.round(f1, 6).alias("f1")), "id", "left").fillna(0.0, ["f1"])


def compare_runs(rows: DataFrame) -> DataFrame:
    """V6: accuracy of each run over the questions that all runs answered."""
    n = rows.select(F.countDistinct("run")).scalar()
    shared = rows.groupBy("id").agg(F.countDistinct("run").alias("_runs")).where(F.col("_runs") == n).select("id")
    return rows.join(shared, "id").groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


def ablation(rows: DataFrame) -> DataFrame:
    """V9: per arm the upper median of the cost, and the share correct."""
    ordered = F.array_sort(F.collect_list("cost"))
    return rows.groupBy("arm").agg(F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")).alias("median_cost"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))
