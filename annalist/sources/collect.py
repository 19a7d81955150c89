"""Collector runs: what changed is landed segment by segment, and an item is marked once all of it has landed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.sources.shared import keep


@dataclass
class Run:
    """``marks``: (key, sha) of everything that has landed whole so far; ``landed``: documents that this run added; ``report``: counts of items."""

    marks: DataFrame
    landed: DataFrame
    report: DataFrame


def hashed(items: DataFrame) -> DataFrame:
    """(key, sha, n_segments, segments): the hash of an item over its segments in order; one without segments has the hash of nothing.

    ``items``: key, segment (null for an item without any), text.
    """
    each = F.when(F.col("segment").isNotNull(), F.struct("segment", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h")))
    parts = F.array_sort(F.collect_set(each))
    told = F.transform("p", lambda x: F.concat_ws(":", x["segment"].cast("string"), F.lower(F.hex(x["h"]))))
    segments = F.array_distinct(F.transform("p", lambda x: x["segment"]))
    return items.groupBy("key").agg(parts.alias("p")).select("key", F.sha2(F.array_join(told, "\n"), 256).alias("sha"), F.size("p").alias("n_segments"), segments.alias("segments"))


def with_texts(asked: DataFrame, items: DataFrame) -> DataFrame:
    """event_id, key, segment, sha and the text of the ``asked`` segments (sha as bytes, h); each once, however often ``items`` tells it."""
    met = asked.join(items.select("key", "segment", "text"), ["key", "segment"])
    once = met.groupBy("key", "segment", "h", "event_id").agg(F.min("text").alias("text"))
    return once.select("event_id", "key", "segment", F.lower(F.hex("h")).alias("sha"), "text")


def collect(items: DataFrame, marks: DataFrame, documents: DataFrame, land: Callable[[DataFrame], DataFrame]) -> Run:
    """One run over ``items`` (key, segment, text), which is read several times.

    ``marks`` (key, sha) says what is known, ``documents`` (event_id) what earlier
    runs landed.  Items whose hash is marked are skipped.  Of the others the
    segments that have not landed under this hash are given to ``land``, which
    returns the event ids that went in.  Where one is missing the item stays
    unmarked, and the next run asks for that one alone.  An item that comes back
    with another text is another hash, whose segments all are new.

    What is asked for is settled by ids, without texts; a text is met as ``land``
    or a reader of ``landed`` takes it (of a segment told twice, the least).
    """
    state = keep(hashed(items))
    fresh = keep(state.join(marks.select("key", "sha"), ["key", "sha"], "left_anti"))
    event = F.concat_ws("#", "key", F.col("segment").cast("string"), F.substring("sha", 1, 12))
    wanted = fresh.select("key", "sha", F.explode("segments").alias("segment")).select("key", "segment", F.unhex("sha").alias("h"), event.alias("event_id"))
    known = documents.select("event_id").distinct()
    asked = keep(wanted.join(known, "event_id", "left_anti"))
    done = keep(land(with_texts(asked, items)).select("event_id").distinct())
    landed = with_texts(asked.join(done, "event_id", "left_semi"), items)
    named = F.lower(F.hex("h")).alias("sha")
    there = wanted.join(known.unionByName(done).distinct(), "event_id", "left_semi").groupBy("key", named).agg(F.count("*").alias("n"))
    whole = keep(fresh.join(there, ["key", "sha"], "left").where(F.coalesce("n", F.lit(0)) == F.col("n_segments")).select("key", "sha"))
    every = marks.select("key", "sha").unionByName(whole)
    counts = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n")
    report = counts(state.join(marks.select("key", "sha"), ["key", "sha"], "left_semi"), "unchanged").unionByName(counts(whole, "marked")).unionByName(counts(fresh.join(whole, ["key", "sha"], "left_anti"), "unfinished"))
    return Run(keep(every), landed, report)
