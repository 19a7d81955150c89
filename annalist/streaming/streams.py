"""Structured Streaming forms of the ledger's jobs; each ends at the same rows as its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.temporal import supersede


def read_files(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A file stream; its checkpoint is the tail cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def dedup_stream(stream: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """S1 on a stream: one row for each event_id within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["event_id"])


def metrics_stream(stream: DataFrame, key: str, at: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and sum of values of each key in tumbling windows."""
    windowed = stream.withWatermark(at, late).groupBy(F.window(at, width), key)
    return windowed.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")


def current_value(rows: pd.DataFrame) -> pd.Series:
    return rows.sort_values(["valid_at", "event_id"]).iloc[-1]


def current_value_stream(stream: DataFrame) -> DataFrame:
    """Z3: the current value of each anchor, told again whenever it changes.

    State is one row for each anchor: its greatest (valid_at, event_id) so far,
    so a backfilled older row changes nothing.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.getOption
        best = (had[0], had[1], had[2]) if had is not None else None
        for rows in frames:
            last = current_value(rows)
            one = (int(last["valid_at"].value // 1000), int(last["event_id"]), str(last["dst"]))
            if best is None or one[:2] > best[:2]:
                best = one
        changed = had is None or best[2] != had[2]
        state.update(best)
        if changed:
            yield pd.DataFrame({"user_id": [key[0]], "dst": [best[2]], "valid_at": [pd.Timestamp(best[0] * 1000)]})

    return stream.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, dst string, valid_at timestamp", "at bigint, event_id bigint, dst string", "append", GroupStateTimeout.NoTimeout
    )


def run_fold(stream: DataFrame, table: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame]):
    """Every micro-batch folded and appended; a batch that is tried again replaces its own rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intervals_of(table: DataFrame) -> DataFrame:
    """Intervals over all rows that have come, in world time: late rows take their place, none is dropped."""
    return supersede(table, ["user_id"])
