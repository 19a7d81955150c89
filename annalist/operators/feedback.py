"""Usage, trust, run statistics, fleet and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASSES, FAILS = ("success",), ("error", "max_turns", "cancelled")
LATENCY_BUCKETS = (5, 10, 25, 50, 100, 250, 500, 1000)


def consequences(served: DataFrame, verdicts: DataFrame) -> DataFrame:
    """passes, fails and runs of each node served; runs without a verdict count nothing."""
    each = served.select("run_id", F.explode(F.array_distinct("node_ids")).alias("node_id")).distinct()
    met = each.join(verdicts.select("run_id", "run_result"), "run_id")
    return met.groupBy("node_id").agg(
        F.count_if(F.col("run_result").isin(*PASSES)).alias("passes"), F.count_if(F.col("run_result").isin(*FAILS)).alias("fails"), F.countDistinct("run_id").alias("runs")
    )


def usage(served: DataFrame) -> DataFrame:
    """Times served and last time of each node."""
    return served.select("served_at", F.explode("node_ids").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("served_count"), F.max("served_at").alias("last_served_at"))


def gc_report(nodes: DataFrame, now: Column, old_days: int = 30, hot: int = 3) -> DataFrame:
    """Totals, ever served, hot, and old ones never served."""
    old = F.col("created_at") < now - F.make_interval(days=F.lit(old_days))
    count = F.coalesce("served_count", F.lit(0))
    return nodes.agg(F.count("*").alias("total"), F.count_if(count > 0).alias("ever_served"), F.count_if(count >= hot).alias("hot"), F.count_if((count == 0) & old).alias("unserved_old"))


def run_stats(runs: DataFrame, grain: list[str], least: int = 30) -> DataFrame:
    """Counts of a grain with at least ``least`` runs: successes, stalls, share of stalls, median turns."""
    stats = runs.groupBy(*grain).agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("run_result") == "success").alias("n_success"), F.count_if(F.col("run_result") == "max_turns").alias("n_stalls"), F.median("turns").alias("median_turns")
    )
    return stats.where(F.col("n_runs") >= least).withColumn("stall_share", F.round(F.col("n_stalls") / F.col("n_runs"), 6))


def deviations(df: DataFrame) -> DataFrame:
    """Count of each (hop, kind) with its first five slugs."""
    return df.groupBy("hop", "kind").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("slug")), 1, 5).alias("slugs"))


def propose_stalls(stats: DataFrame, share: float = 0.2) -> DataFrame:
    """A10: a proposal for each grain whose share of stalls reaches the threshold."""
    return stats.where(F.col("stall_share") >= share).withColumn("proposal", F.lit("raise_turn_budget"))


def fleet(runs: DataFrame, least_tenants: int = 2, top: int = 3) -> DataFrame:
    """The commonest results of each task over tenants, where enough of them contribute."""
    counts = runs.groupBy("task", "run_result").agg(F.count("*").alias("n"), F.countDistinct("org_id").alias("tenants")).where(F.col("tenants") >= least_tenants)
    order = Window.partitionBy("task").orderBy(F.desc("n"), "run_result")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def latency_histogram(requests: DataFrame, key: list[str], value: str, buckets: tuple[int, ...] = LATENCY_BUCKETS) -> DataFrame:
    """Requests of each key by the least bucket that holds them; null: beyond the last."""
    bucket = F.coalesce(*[F.when(F.col(value) <= b, b) for b in buckets])
    return requests.groupBy(*key, bucket.alias("le")).agg(F.count("*").alias("n"))


def nearest_rank(requests: DataFrame, key: list[str], value: str, quantile: float) -> DataFrame:
    """The value at place round-half-even(q * (n - 1)) of each key, in order."""
    order = Window.partitionBy(*key).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*key))
    placed = requests.select(*key, value, (F.row_number().over(order) - 1).alias("_at"), F.bround(quantile * (n - 1)).cast("long").alias("_want"))
    return placed.where("_at = _want").select(*key, F.col(value).alias("value"))


def tune_due(runs: DataFrame, turns: DataFrame, now: Column, least_runs: int = 30, least_days: int = 28) -> DataFrame:
    """Hops with enough runs since their last turn that is old enough (or that never had one)."""
    last = turns.groupBy("hop").agg(F.max("at").alias("last_at"))
    met = runs.join(last, "hop", "left").where(F.col("last_at").isNull() | (F.col("at") > F.col("last_at")))
    per = met.groupBy("hop", "last_at").agg(F.count("*").alias("n_runs"))
    old = F.col("last_at").isNull() | (F.col("last_at") <= now - F.make_interval(days=F.lit(least_days)))
    return per.withColumn("due", (F.col("n_runs") >= least_runs) & old)


def price_tokens(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each model; cache reads at a tenth, cache writes at five quarters of the input price."""
    met = tokens.join(prices, "model")
    cost = F.col("input") * F.col("input_price") + F.col("output") * F.col("output_price") + F.col("cache_read") * F.col("input_price") * 0.1 + F.col("cache_write") * F.col("input_price") * 1.25
    return met.groupBy("model").agg(F.round(F.sum(cost), 6).alias("cost"))
