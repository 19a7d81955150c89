"""Ranked compositions: facts, passages, packets, projections, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.scores import decay, recency_factor
from annalist.functions.text import excerpt

TIERS = {"endorsed": 0.0, "corroborated": 1.0, "probation": 2.0}
NOTE_SECTIONS = ("summary", "decisions", "open threads", "conventions", "links")


def rank_facts(facts: DataFrame, now: Column, most: int = 8) -> DataFrame:
    """K3: score times decay (of typed kinds), observations on ties; superseded, retracted and expired ones leave."""
    live = facts.where(~F.col("status").isin("superseded", "retracted", "expired"))
    factor = F.when(F.col("kind").isNull(), 1.0).otherwise(decay(F.col("kind"), F.col("half_life"), F.col("stamp"), now))
    scored = live.withColumn("final", F.round(F.col("score") * factor, 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc("observed_count"), "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def rank_passages(passages: DataFrame, now: Column, drop_failed: bool = False, most: int = 5) -> DataFrame:
    """K4: score times recency, times 0.6 where the run failed; agents can have those dropped."""
    kept = passages.where(~F.col("failed")) if drop_failed else passages
    scored = kept.withColumn("final", F.round(F.col("score") * recency_factor(F.col("valid_at"), now) * F.when(F.col("failed"), 0.6).otherwise(1.0), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "doc_id", "ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def packet(facts: DataFrame, passages: DataFrame) -> DataFrame:
    """K8: (query_id, body, node_ids, doc_ids): Facts, then Evidence, as ordered lines."""
    head = lambda df, n, title: df.select("query_id").distinct().select("query_id", F.lit(n).alias("section"), F.lit(0).alias("line"), F.lit(title).alias("text"))
    said = facts.select("query_id", F.lit(1).alias("section"), F.col("rank").alias("line"), F.concat(F.lit("- "), "fact").alias("text"))
    shown = passages.select("query_id", F.lit(2).alias("section"), F.col("rank").alias("line"), F.concat(F.lit("> "), excerpt(F.col("content"))).alias("text"))
    lines = head(facts, 1, "## Facts").unionByName(said).unionByName(head(passages, 2, "## Evidence")).unionByName(shown)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "line", "text"))), lambda x: x["text"]), "\n")
    served = facts.groupBy("query_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    read = passages.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    return lines.groupBy("query_id").agg(body.alias("body")).join(served, "query_id", "left").join(read, "query_id", "left")


def enforce_citations(answers: DataFrame, packets: DataFrame) -> DataFrame:
    """K9: answers without the [id] citations that their packet does not hold, and how many those were."""
    met = answers.join(packets.select("query_id", F.col("node_ids").alias("_ids")), "query_id", "left")
    cited = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[([A-Za-z0-9:_-]+)\]"), 1))
    false = F.array_except(cited, F.transform(F.coalesce("_ids", F.array().cast("array<string>")), lambda x: x.cast("string")))
    clean = F.aggregate(false, F.col("answer"), lambda t, c: F.replace(t, F.concat(F.lit("["), c, F.lit("]")), F.lit("")))
    return met.withColumn("n_false", F.size(false)).withColumn("answer", clean).drop("_ids")


def projection(items: DataFrame, budget_tokens: int = 5_000, chars_per_token: int = 4) -> DataFrame:
    """Items by section, trust tier and recency, up to the first that overflows the caller's budget.

    ``items``: caller_id, section (0 first), tier, unprompted, stamp, item_id, text;
    the same text once for a caller; at most three unprompted ones.
    """
    tier = F.coalesce(*[F.when(F.col("tier") == k, v) for k, v in TIERS.items()], F.lit(3.0)) + F.when(F.col("unprompted"), 0.5).otherwise(0.0)
    ranked = items.withColumn("_tier", tier)
    order = ["section", "_tier", F.desc("stamp"), "item_id"]
    once = ranked.withColumn("_same", F.row_number().over(Window.partitionBy("caller_id", "text").orderBy(*order))).where("_same = 1")
    few = once.withColumn("_own", F.row_number().over(Window.partitionBy("caller_id", "unprompted").orderBy(*order))).where(~F.col("unprompted") | (F.col("_own") <= 3))
    running = Window.partitionBy("caller_id").orderBy(*order)
    placed = few.withColumn("rank", F.row_number().over(running)).withColumn("used", F.sum(F.char_length("text")).over(running.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where(F.col("used") <= budget_tokens * chars_per_token).select("caller_id", "rank", "item_id", "used")


def parse_sections(notes: DataFrame, sections: tuple[str, ...] = NOTE_SECTIONS, most: int = 8_000) -> DataFrame:
    """(note_id, section, body, error): second-level headings open sections; unknown, repeated and oversize ones err."""
    lines = notes.select("note_id", F.char_length("body").alias("size"), F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    heading = F.nullif(F.trim(F.regexp_extract("line", r"^##\s+(.*)$", 1)), F.lit(""))
    order = Window.partitionBy("note_id").orderBy("pos")
    placed = lines.withColumn("heading", heading).withColumn("part", F.sum(F.col("heading").isNotNull().cast("int")).over(order)).withColumn("section", F.lower(F.last("heading", ignorenulls=True).over(order)))
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n"))
    parts = placed.groupBy("note_id", "part", "section").agg(body.alias("body"), F.max("size").alias("size"))
    seen = F.row_number().over(Window.partitionBy("note_id", "section").orderBy("part"))
    error = (
        F.when(F.col("size") > most, "too_long").when(F.col("section").isNull() & (F.col("body") != ""), "text_before_heading")
        .when(F.col("section").isNotNull() & ~F.col("section").isin(*sections), "unknown_section").when(F.col("section").isNotNull() & (F.col("_seen") > 1), "repeated_section")
    )
    return parts.withColumn("_seen", seen).withColumn("error", error).where(F.col("section").isNotNull() | F.col("error").isNotNull()).select("note_id", "section", "body", "error")


def note_as_of(versions: DataFrame, at: Column) -> DataFrame:
    """The last version of each note at an instant."""
    return versions.where(F.col("created_at") <= at).groupBy("note_id").agg(F.max_by("body", "version").alias("body"), F.max("version").alias("version"))


def stale_citations(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(note_id, edge_id): cited edges that are missing or closed."""
    cited = notes.select("note_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[edge:([A-Za-z0-9_-]+)\]"), 1))).alias("edge_id"))
    met = cited.join(edges.select("edge_id", F.lit(True).alias("_known"), "invalid_at"), "edge_id", "left")
    return met.where("_known is null or invalid_at is not null").select("note_id", "edge_id")
