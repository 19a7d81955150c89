"""Consent, policy, budgets, salience, hygiene and retention."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.scores import recency
from annalist.functions.text import STOP_TERMS, pii_kinds
from annalist.sources.shared import told_once

WORD = re.compile("[a-zA-Z][a-zA-Z0-9_-]{3,}")
SCOPE_RANK = {"global": 0, "org": 1, "team": 2, "service": 3, "repo": 4, "agent": 5, "user": 6}


def scope_rank(scope: Column) -> Column:
    return F.coalesce(*[F.when(scope == k, v) for k, v in SCOPE_RANK.items()], F.lit(0))


def classification(scope: Column) -> Column:
    """P5."""
    return F.when(scope == "global", "public").when(scope == "user", "personal").otherwise("internal")


def scope_filter(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows in one of the scopes; global ones whatever the tenant; no scopes, no rows."""
    everyone = F.col("scope") == "global"
    key = F.struct("scope", *[F.when(~everyone, F.col(c).cast("string")).alias(c) for c in ("org_id", "scope_id")])
    known = (F.col("scope") == "global") | F.col("org_id").isNotNull()
    # the hash spreads the rows; the columns it is made of decide
    keyed = lambda d: d.where(known).withColumn("_key", key).withColumn("_hash", F.xxhash64("_key"))
    wanted = keyed(scopes).select("_hash", F.col("_key").alias("_wanted")).distinct()
    rows = keyed(df)
    return rows.join(wanted, (rows["_hash"] == wanted["_hash"]) & rows["_key"].eqNullSafe(wanted["_wanted"]), "left_semi").select(df.columns)


def accessible_scopes(callers: DataFrame) -> DataFrame:
    """(caller_id, scope, scope_id, pos): user, teams, org and global, narrowest first."""
    one = lambda s, i: F.struct(F.lit(s).alias("scope"), i.cast("string").alias("scope_id"))
    listed = F.concat(
        F.array(one("user", F.col("caller_id"))), F.transform(F.coalesce("team_ids", F.array().cast("array<string>")), lambda t: one("team", t)), F.array(one("org", F.col("org_id")), one("global", F.lit(None)))
    )
    return callers.select("caller_id", F.posexplode(F.array_distinct(listed)).alias("pos", "s")).select("caller_id", "s.scope", "s.scope_id", "pos")


def resolve_consent(episodes: DataFrame, consent: DataFrame) -> DataFrame:
    """``consent_reason`` of each episode: the broadest scope of its chain that is off or paused."""
    chain = F.array_distinct(F.array(F.struct(F.lit("org").alias("scope"), F.col("org_id").cast("string").alias("scope_id")), F.struct("scope", F.col("scope_id").cast("string").alias("scope_id"))))
    links = episodes.select("event_id", F.posexplode(chain).alias("pos", "c")).select("event_id", "pos", "c.scope", "c.scope_id")
    blocked = links.join(consent.where("state in ('off', 'pause')"), ["scope", "scope_id"])
    first = blocked.groupBy("event_id").agg(F.min_by("state", F.struct("pos", "state")).alias("_state"))
    return episodes.join(first, "event_id", "left").withColumn("consent_reason", F.when(F.col("_state").isNotNull(), F.concat(F.lit("consent:"), "_state"))).drop("_state")


def resolve_policy(targets: DataFrame, policies: DataFrame) -> DataFrame:
    """Per target: union of denied sources, intersection of allow lists, greatest floor, least budget.

    ``targets`` (target, scope, scope_id) lists the chain; ``policies`` has
    deny_sources, allow_sources (null: no list), min_salience, budget.
    """
    met = targets.join(policies, ["scope", "scope_id"])
    lists = F.filter(F.collect_list("allow_sources"), lambda a: a.isNotNull())
    shared = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists), F.lit(1))), F.get(lists, 0), lambda a, b: F.array_intersect(a, b))
    return met.groupBy("target").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("deny_sources", F.array().cast("array<string>")))))).alias("deny_sources"),
        F.when(F.size(lists) > 0, F.array_sort(shared)).alias("allow_sources"), F.max("min_salience").alias("min_salience"), F.min("budget").alias("budget"),
    )


def drop_reason(source: Column, deny: Column, allow: Column) -> Column:
    """The first reason of policy, null if none."""
    return F.coalesce(
        F.when(F.array_contains(deny, source), F.concat(F.lit("deny_source:"), source)), F.when(allow.isNotNull() & ~F.array_contains(allow, source), F.concat(F.lit("not_allowed_source:"), source))
    )


def daily_budget(docs: DataFrame, key: list[str], cap: Column, at: str = "ingested_at", tie: str = "event_id") -> DataFrame:
    """Admitted within the day's cap of each key; the reason says where the rest stood."""
    order = Window.partitionBy(*key, F.to_date(at)).orderBy(at, tie)
    n = F.row_number().over(order)
    ranked = docs.withColumn("_n", n)
    reason = F.when(F.col("_n") > cap, F.concat_ws("", F.lit("budget:"), F.col(key[0]).cast("string"), F.lit(":"), cap.cast("string"), F.lit("/"), cap.cast("string")))
    return ranked.withColumn("drop_reason", reason).drop("_n")


def leading_terms(docs: DataFrame, n: int = 24) -> DataFrame:
    """(doc_id, term, times, pos): the commonest terms of a text, ties by first appearance.

    A text is counted where it lies; only ids told in several rows are grouped.
    """
    once, several = told_once(docs.select("doc_id", "text"), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    lead = once.mapInArrow(lambda b: told_leading(b, n), f"doc_id {kind}, term string, times long, pos int, rank int")
    return lead if several is None else lead.unionByName(leading_of_groups(several, n))


def told_leading(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, told = [], []
        for row, text in enumerate(batch.column("text")):
            words = [w.lower() for w in WORD.findall(text.as_py() or "")]
            counts = Counter(words)  # in order of first appearance, which sorting keeps among equals
            for t in STOP_TERMS:
                counts.pop(t, None)
            lead = sorted(counts.items(), key=lambda c: -c[1])[:n]
            rows += [row] * len(lead)
            told += [(t, times, words.index(t), i + 1) for i, (t, times) in enumerate(lead)]
        term, times, pos, rank = zip(*told, strict=True) if told else ((), (), (), ())
        arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(term, pa.string()), pa.array(times, pa.int64()), pa.array(pos, pa.int32()), pa.array(rank, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "term", "times", "pos", "rank"])


def leading_of_groups(docs: DataFrame, n: int) -> DataFrame:
    """The same where a doc_id has several rows, which count together."""
    words = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD.pattern), 0), F.lower)
    each = docs.select("doc_id", F.posexplode(words).alias("pos", "term")).where(~F.col("term").isin(*STOP_TERMS))
    counts = each.groupBy("doc_id", "term").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("times"), "pos")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def distinctiveness(new: DataFrame, stored: DataFrame, n: int = 24) -> DataFrame:
    """Share of a text's leading terms that no stored text has.

    Stored texts are met through their terms, not as substrings: an equi-join
    that scales, at the price of missing a term inside a longer one.  A task
    hashes its share of the different stored terms, and sorts neither side.
    """
    lead = leading_terms(new, n)
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD.pattern), 0), F.lower))
    known = stored.select(F.explode(words).alias("term")).distinct().withColumn("_known", F.lit(1))
    met = lead.join(known.hint("shuffle_hash"), "term", "left")
    return met.groupBy("doc_id").agg((F.count_if(F.col("_known").isNull()) / F.count("*")).alias("distinctiveness"))


def salience(docs: DataFrame, now: Column) -> DataFrame:
    """0.5 * recency + 0.5 * distinctiveness, to three decimals."""
    return docs.withColumn("salience", F.bround(0.5 * recency(F.col("valid_at"), now) + 0.5 * F.coalesce("distinctiveness", F.lit(1.0)), 3))


def pii_in_node(nodes: DataFrame) -> DataFrame:
    """Personal data in a node's name, summary and string properties."""
    return nodes.withColumn("pii", pii_kinds(F.concat_ws("\n", "name", "summary", F.array_join(F.map_values("props"), "\n"))))


def purge(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """What remains once the rows of ``gone`` are removed."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def apply_retention(df: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """Rows from the cutoff on; rows without a time stay."""
    return df.where(F.col(at).isNull() | (F.col(at) >= cutoff))


def sweep_working(df: DataFrame, now: Column) -> DataFrame:
    """Working rows past their expiry leave."""
    return df.where(~((F.col("status") == "working") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)))


def close_expired(nodes: DataFrame, edges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Expired nodes, and the open edges that touch them closed at the earliest expiry."""
    due = (F.col("status") != "working") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)
    ended = nodes.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))
    gone = nodes.where(due).select("node_id", "expires_at")
    met = edges.join(gone.select(F.col("node_id").alias("src_id"), F.col("expires_at").alias("_a")), "src_id", "left").join(gone.select(F.col("node_id").alias("dst_id"), F.col("expires_at").alias("_b")), "dst_id", "left")
    at = F.least("_a", "_b")
    open_ = F.col("invalid_at").isNull() & at.isNotNull()
    return ended, met.withColumn("expired_at", F.when(open_, now).otherwise(F.col("expired_at"))).withColumn("invalid_at", F.when(open_, at).otherwise(F.col("invalid_at"))).select(*edges.columns)


def retract(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested nodes become retracted, with the reason."""
    return nodes.join(requests.select("node_id", "reason"), "node_id", "left").withColumn("status", F.when(F.col("reason").isNotNull(), "retracted").otherwise(F.col("status")))


def ingest_status(reason: Column) -> Column:
    """G26."""
    return F.when(reason.isNull(), "processed").when(reason == "duplicate", "duplicate").when(reason.startswith("consent:"), "consent_blocked").when(reason.startswith("salience:") | reason.startswith("budget:"), "declined").otherwise("policy_dropped")


def endorse(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Endorsers added and withdrawn as a set; the last request of a user on a node counts."""
    last = requests.groupBy("node_id", "user_id").agg(F.max_by("op", F.struct("at", "op")).alias("op"))
    per = last.groupBy("node_id").agg(F.collect_set(F.when(F.col("op") == "endorse", F.col("user_id"))).alias("_in"), F.collect_set(F.when(F.col("op") == "withdraw", F.col("user_id"))).alias("_out"))
    none = F.array().cast("array<string>")
    merged = F.array_sort(F.array_except(F.array_union(F.coalesce("endorsed_by", none), F.coalesce("_in", none)), F.coalesce("_out", none)))
    return nodes.join(per, "node_id", "left").withColumn("endorsed_by", merged).drop("_in", "_out")


def publish(personal: DataFrame, shared: DataFrame) -> DataFrame:
    """What becomes of each personal node: refused for personal data, merged into equal content, or published,
    beside a conflicting one under its own key."""
    target = shared.select("type", "key", F.col("name").alias("_name"))
    met = personal.join(target, ["type", "key"], "left")
    bare = F.size(pii_kinds(F.concat_ws("\n", "name", "summary"))) == 0
    outcome = F.when(~bare, "refused").when(F.col("_name").isNull(), "published").when(F.col("_name") == F.col("name"), "merged").otherwise("contested")
    key = F.when(outcome == "contested", F.concat_ws("~", "key", "user_id")).otherwise(F.col("key"))
    return met.withColumn("outcome", outcome).withColumn("shared_key", F.when(outcome != "refused", key)).drop("_name")


def depart(tables: dict[str, DataFrame], user: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the user's own rows, and a certificate: rows removed of each, with a digest over them."""
    mine = (F.col("scope") == "user") & (F.col("scope_id") == user)
    counts = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count_if(F.coalesce(mine, F.lit(False))).alias("removed")).select(F.lit(name).alias("table"), "removed")
        counts = one if counts is None else counts.unionByName(one)
    lines = F.array_sort(F.collect_list(F.struct("table", "removed")))
    certificate = counts.agg(F.to_json(lines).alias("counts")).withColumn("sha256", F.sha2("counts", 256))
    return {name: df.where(~F.coalesce(mine, F.lit(False))) for name, df in tables.items()}, certificate


def apply_dim_changes(dim: DataFrame, changes: DataFrame, key: list[str], value: str) -> DataFrame:
    """The last change of each key wins, a null value removes it; ``version`` counts the changes."""
    every = dim.select(*key, value, F.lit(None).cast("timestamp").alias("at")).unionByName(changes.select(*key, value, "at"))
    last = every.groupBy(*key).agg(F.max_by(F.struct(value), F.struct(F.col("at").isNotNull(), "at")).alias("_v"), F.count("*").alias("version"))
    return last.select(*key, F.col(f"_v.{value}").alias(value), "version").where(F.col(value).isNotNull())


def curation_listing(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with the most that any of their passages was served."""
    return docs.join(chunks.groupBy("doc_id").agg(F.max("served_count").alias("max_served")), "doc_id", "left").fillna(0, ["max_served"])
