"""The append-only ledger: idempotent append, normalization, tails, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_episodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with ``status`` accepted or duplicate; the first of an event_id by arrival is accepted."""
    first = Window.partitionBy("event_id").orderBy("ingested_at", F.xxhash64(*incoming.columns))
    ranked = incoming.withColumn("_n", F.row_number().over(first))
    known = existing.select("event_id").distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNotNull() | (F.col("_n") > 1), "duplicate").otherwise("accepted")
    return ranked.join(known, "event_id", "left").withColumn("status", status).drop("_n", "_known")


def normalize_envelope(df: DataFrame, capture_content: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): defaults filled; an org row takes its org as scope_id; others but global need one."""
    scope = F.coalesce("scope", F.lit("user"))
    filled = df.withColumn("scope", scope).withColumn("scope_id", F.when(scope == "org", F.coalesce("scope_id", "org_id")).otherwise(F.col("scope_id")))
    filled = filled.withColumn("content", F.col("content") if capture_content else F.lit(None).cast("string"))
    bad = (F.col("scope") != "global") & F.col("scope_id").isNull()
    return filled.where(~bad), filled.where(bad).withColumn("reject_reason", F.lit("scope_id_missing"))


def tail(df: DataFrame, cursor: tuple | None, limit: int, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The next ``limit`` rows after the composite cursor (ts, key); rows of one timestamp are never skipped."""
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast(df.schema[ts].dataType), F.lit(cursor[1]).cast(df.schema[key].dataType)
        df = df.where((F.col(ts) > at) | ((F.col(ts) == at) & (F.col(key) > last)))
    return df.orderBy(ts, key).limit(limit)


def watermarks(df: DataFrame, source: str = "source", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The cursor of each source: its greatest (ts, key)."""
    top = F.max(F.struct(ts, key)).alias("top")
    return df.groupBy(source).agg(top).select(source, F.col(f"top.{ts}").alias("cursor_ts"), F.col(f"top.{key}").alias("cursor_id"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or an error that names what is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def scope_for(org: Column, user: Column) -> Column:
    """(scope, scope_id): the org's if there is one, else the user's, else an error."""
    return F.when(org.isNotNull(), F.struct(F.lit("org").alias("scope"), org.cast("string").alias("scope_id"))).when(
        user.isNotNull(), F.struct(F.lit("user").alias("scope"), user.cast("string").alias("scope_id"))
    ).otherwise(F.raise_error(F.lit("neither org nor user")).cast("struct<scope:string,scope_id:string>"))


def items_to_envelopes(df: DataFrame, source_type: str, default_scope: str = "org") -> DataFrame:
    """S3: source items (source_id, content, occurred_at, metadata map) as envelopes."""
    meta = lambda k, d: F.coalesce(F.col("metadata")[k], F.lit(d))
    return df.select(
        F.concat_ws(":", F.lit(source_type), "source_id").alias("event_id"), "occurred_at", meta("scope", default_scope).alias("scope"),
        F.col("metadata")["scope_id"].alias("scope_id"), meta("action_type", "document.observed").alias("action_type"),
        F.to_json(F.struct(F.col("content").alias("statement"))).alias("payload"), F.lit(source_type).alias("source"),
    )


def changed_only(df: DataFrame, state: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose (key, hash of content) is not in ``state``, with that hash."""
    hashed = df.withColumn("content_hash", F.substring(F.sha2(F.col(content).cast("binary"), 256), 1, 32))
    return hashed.join(state.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def sync_catalogue(tree: DataFrame, items: DataFrame, pattern: str, most_bytes: int) -> DataFrame:
    """Ref, sha and status (new, changed, same, gone) of text files that match and are small enough."""
    listed = tree.where(F.col("ref").rlike(pattern) & (F.col("size") <= most_bytes)).select("ref", F.col("sha").alias("new_sha"))
    known = items.select("ref", F.col("sha").alias("old_sha"))
    status = F.when(F.col("old_sha").isNull(), "new").when(F.col("new_sha").isNull(), "gone").when(F.col("old_sha") != F.col("new_sha"), "changed").otherwise("same")
    return listed.join(known, "ref", "full_outer").select("ref", F.coalesce("new_sha", "old_sha").alias("sha"), status.alias("status"))


def list_episodes(df: DataFrame, status: str | None, offset: int, limit: int) -> DataFrame:
    """Newest first, with the derived status dead > dropped > processed > pending."""
    derived = F.when(F.col("dead_at").isNotNull(), "dead").when(F.col("dropped_reason").isNotNull(), "dropped").when(F.col("processed"), "processed").otherwise("pending")
    found = df.withColumn("status", derived)
    found = found if status is None else found.where(F.col("status") == status)
    return found.orderBy(F.desc("occurred_at"), "event_id").offset(offset).limit(limit)


def route_failures(batch: DataFrame, attempts: DataFrame, most: int = 5) -> DataFrame:
    """Status ok, retry or dead for each row: ``error`` is null when it is well, ``attempts`` lists failures so far."""
    before = attempts.groupBy("event_id").agg(F.count("*").alias("failed"))
    count = F.coalesce("failed", F.lit(0)) + F.col("error").isNotNull().cast("long")
    status = F.when(F.col("error").isNull(), "ok").when(count >= most, "dead").otherwise("retry")
    return batch.join(before, "event_id", "left").withColumn("error_count", count).withColumn("status", status).drop("failed")
