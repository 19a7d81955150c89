"""The bi-temporal core: runs of values, supersession, ends, status, history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.scores import as_of, micros


def supersede(obs: DataFrame, key: list[str], value: str = "dst") -> DataFrame:
    """The runs of each key in world time, as half-open intervals.

    ``obs``: key columns, ``value``, valid_at, ingested_at, event_id.  A run is a
    block of equal values in (valid_at, ingested_at, event_id) order; it ends
    where the next begins, and is no longer believed from the moment that one
    was told.  Equal times leave an interval of no length.
    """
    order = Window.partitionBy(*key).orderBy("valid_at", "ingested_at", "event_id")
    starts = obs.withColumn("_before", F.lag(F.struct(value)).over(order)).where(
        F.col("_before").isNull() | ~F.col(f"_before.{value}").eqNullSafe(F.col(value))
    )
    return starts.select(
        *key, value, "valid_at", F.lead("valid_at").over(order).alias("invalid_at"), "ingested_at", F.lead("ingested_at").over(order).alias("expired_at"), "event_id"
    )


def supersede_by_arrival(obs: DataFrame, key: list[str], value: str = "dst") -> DataFrame:
    """B4 in arrival order: each observation meets only the edge that is open when it arrives.

    A later one closes the open edge at its start; an earlier one is bounded by
    the open edge; the open value asserted again changes nothing.  Rows come
    sorted, and all that is kept of a key is its open edge, whatever its length.
    """
    names = [*key, value, "valid_at", "event_id"]
    kinds = {f.name: f.dataType.simpleString() for f in obs.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*key, value]), "valid_at timestamp", "invalid_at timestamp", f"event_id {kinds['event_id']}"])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: tuple | None = None  # key, value, valid_at, event_id
        for rows in frames:
            done: list[tuple] = []
            for r in rows.itertuples(index=False, name=None):
                at, same = r[-2], open_ is not None and open_[: len(key)] == r[: len(key)]
                if open_ is not None and not same:
                    done.append((*open_[:-1], None, open_[-1]))
                if same and open_[-3] == r[-3]:
                    continue
                if same and at < open_[-2]:
                    done.append((*r[:-1], open_[-2], r[-1]))
                    continue
                if same:
                    done.append((*open_[:-1], at, open_[-1]))
                open_ = r
            yield pd.DataFrame(done, columns=[*names[:-1], "invalid_at", "event_id"])
        if open_ is not None:
            yield pd.DataFrame([(*open_[:-1], None, open_[-1])], columns=[*names[:-1], "invalid_at", "event_id"])

    n = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = obs.withColumn("valid_at", F.col("valid_at").cast("timestamp")).repartition(n, *key).sortWithinPartitions(*key, "ingested_at", "event_id")
    return dealt.select(*names).mapInPandas(fold, schema)


def at_time(edges: DataFrame, at: Column, mode: str = "valid") -> DataFrame:
    """The edges that held (mode valid), or were believed (mode system), at an instant."""
    start, end = {"valid": ("valid_at", "invalid_at"), "system": ("ingested_at", "expired_at")}[mode]
    return edges.where(as_of(F.col(start), F.col(end), at))


def end_edges(edges: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """Open edges closed at the earliest end told for their key that is not before their start."""
    met = edges.join(ends.select(*key, F.col("ended_at").alias("_end")), key, "left")
    names = [c for c in edges.columns]
    due = F.min(F.when(F.col("_end") >= F.col("valid_at"), F.col("_end"))).alias("_due")
    return met.groupBy(*names).agg(due).withColumn("invalid_at", F.coalesce("invalid_at", "_due")).select(*names)


def value_status(edges: DataFrame, value: str = "dst") -> DataFrame:
    """A value is committed while any of its edges is open, else superseded."""
    return edges.groupBy(value).agg(F.when(F.bool_or(F.col("invalid_at").isNull()), "committed").otherwise("superseded").alias("status"))


def metric_history(edges: DataFrame, key: list[str], value: str = "dst") -> DataFrame:
    """A4: number of values, how many are current, and the last one, of each key."""
    return edges.groupBy(*key).agg(
        F.count("*").alias("n_values"), F.count_if(F.col("invalid_at").isNull()).alias("n_current"), F.max_by(value, F.struct("valid_at", "ingested_at", "event_id")).alias("last_value"), F.min("valid_at").alias("first_at")
    )


def freshness(values: DataFrame, key: list[str], now: Column, multiple: float = 2.0, default_days: float = 30.0) -> DataFrame:
    """Is a key stale: older than ``multiple`` median gaps (of an hour or more) between its values?"""
    order = Window.partitionBy(*key).orderBy("valid_at")
    hours = (micros(F.col("valid_at")) - micros(F.lag("valid_at").over(order))) / F.lit(3_600_000_000.0)
    gaps = values.withColumn("_gap", hours)
    cadence = F.median(F.when(F.col("_gap") >= 1, F.col("_gap")))
    per = gaps.groupBy(*key).agg(F.max("valid_at").alias("last_at"), cadence.alias("cadence_hours"))
    age = (micros(now) - micros(F.col("last_at"))) / F.lit(3_600_000_000.0)
    limit = F.coalesce(F.col("cadence_hours") * multiple, F.lit(default_days * 24))
    return per.withColumn("age_hours", age).withColumn("stale", age > limit)


def contradiction_backlog(edges: DataFrame, key: list[str]) -> DataFrame:
    """A3: keys with more than one open edge."""
    return edges.where("invalid_at is null").groupBy(*key).agg(F.count("*").alias("n_open")).where("n_open > 1")


def replay_equal(a: DataFrame, b: DataFrame) -> bool:
    """V8: do two rebuilds hold the same rows?"""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


