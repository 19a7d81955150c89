"""Working memories live for a fortnight of event time, unless something lasting says the same before.

A memory's life begins with its first observation.  An observation that is
committed, at that moment or before the life's time is over, promotes it for
good; else it expires, and what is observed from then on begins a new life.
Nothing but event time counts: observations wait in state until the watermark
has passed them and are taken in their order, so rows that come in any order
within the watermark's delay give the same lives as ``working_lives`` in batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annalist.sources.shared import keep

TTL = timedelta(days=14)
LIFE = "key string, began_at timestamp, status string, decided_at timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WorkingMemory(StatefulProcessor):
    """State of a key: the observations that the watermark has not passed, and the life that is not decided."""

    def __init__(self, ttl: timedelta = TTL):
        self.ttl = int(ttl.total_seconds() * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "at bigint, committed boolean")
        self.life = handle.getValueState("life", "began bigint, promoted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 N803
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            # one timer, for the first of these: it takes all that are due and sets the next
            self.handle.registerTimer(-(-int(at.min()) // 1000))
            self.ahead.appendList([(int(t), bool(c)) for t, c in zip(at, frame["committed"], strict=True)])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802 N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.ahead.get()) if self.ahead.exists() else []
        due, later = [x for x in waiting if x[0] <= passed], [x for x in waiting if x[0] > passed]
        if due:
            self.ahead.put(later) if later else self.ahead.clear()
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        began, promoted = self.life.get() if self.life.exists() else (None, False)
        told = []
        for at, committed in due:
            if promoted:
                break
            if began is not None and at >= began + self.ttl:
                told.append((began, "expired", began + self.ttl))
                began = None
            began = at if began is None else began
            if committed:
                promoted = True
                told.append((began, "committed", at))
        if began is not None and not promoted and began + self.ttl <= passed:
            told.append((began, "expired", began + self.ttl))
            began = None
        if began is None:
            self.life.clear()
        else:
            self.life.update((began, promoted))
            if not promoted:
                self.handle.registerTimer(-(-(began + self.ttl) // 1000))
        if told:
            at = lambda i: pd.to_datetime([t[i] for t in told], unit="us")
            yield pd.DataFrame({"key": [str(key[0])] * len(told), "began_at": at(0), "status": [t[1] for t in told], "decided_at": at(2)})

    def close(self) -> None:
        pass


def working_stream(stream: DataFrame, ttl: timedelta = TTL, late: str = "1 hour") -> DataFrame:
    """``LIFE`` rows of a stream of observations (key string, at, committed), each told when it is decided."""
    dated = stream.select("key", "at", "committed").withWatermark("at", late)
    return dated.groupBy("key").transformWithStateInPandas(WorkingMemory(ttl), LIFE, "append", "eventTime")


@contextmanager
def state_with_timers(spark: SparkSession):
    """The state store that timers need, for the queries started within; the session's own afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def working_lives(observations: DataFrame, until, ttl: timedelta = TTL) -> DataFrame:
    """The same lives in batch, as of the instant ``until``; those not decided by then have status working.

    A round settles the first life of each key and leaves the observations after
    its end to the next, so there are as many rounds as a key has lives.
    """
    length = F.expr(f"INTERVAL {int(ttl.total_seconds())} SECOND")
    rest = observations.where(F.col("at") <= until).select("key", "at", "committed")
    out = None
    while True:
        first = rest.groupBy("key").agg(F.min("at").alias("began_at"))
        met = rest.join(first, "key")
        within = F.col("committed") & (F.col("at") < F.col("began_at") + length)
        lives = met.groupBy("key", "began_at").agg(F.min(F.when(within, F.col("at"))).alias("_promoted"))
        over = F.col("began_at") + length
        status = F.when(F.col("_promoted").isNotNull(), "committed").when(over <= until, "expired").otherwise("working")
        lives = keep(lives.withColumn("status", status).withColumn("decided_at", F.coalesce("_promoted", F.when(over <= until, over))).drop("_promoted"))
        out = lives if out is None else out.unionByName(lives)
        expired = lives.where("status = 'expired'").select("key", F.col("decided_at").alias("_from"))
        rest = keep(rest.join(expired, "key").where(F.col("at") >= F.col("_from")).drop("_from"))
        if not rest.limit(1).count():
            return out
