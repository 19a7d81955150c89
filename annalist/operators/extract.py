"""Entities, edges, claims, turns, insights and tallies out of episodes and texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.text import ASKS_ASSISTANT, normalize_fact, sentences, slug
from annalist.functions.turns import turns

# Closed word sets and rule tables.
ABSENCE = ("absent", "ended", "deleted", "gone", "terminated", "removed")
PRESENCE = ("present", "ready", "running", "available", "ok", "healthy")
INSIGHT_MARKERS = {"always": "convention", "never": "convention", "must": "convention", "decided": "decision", "gotcha": "gotcha", "beware": "gotcha", "run": "howto", "prefer": "preference"}
AUTHORED = ("agent.created", "agent.updated", "mcp.created", "skill.created", "skill.published")
DEPLOYED = ("agent.deployed", "mcp.deployed")
STATUS = {"agent.deployed": "running", "agent.stopped": "stopped", "mcp.deployed": "running", "mcp.started": "running", "mcp.stopped": "stopped"}
USED = ("skill.installed", "skill.loaded", "skill.used")
TOOK_PART = ("chat.message", "chat.trace")
JOINED = ("org.member_added", "org.role_changed")


def split_turns(docs: DataFrame) -> DataFrame:
    """(doc_id, turn, speaker, body): turns from 1 on, opened by a role or, without roles, by a name that recurs."""
    each = docs.select("doc_id", F.posexplode(turns(F.col("text"))).alias("turn", "t"))
    return each.select("doc_id", (F.col("turn") + 1).alias("turn"), F.col("t.speaker").alias("speaker"), F.array_join("t.lines", "\n").alias("body"))


def question_speaker(question: Column) -> Column:
    """Whose words a question asks about: the assistant's where it says so, else the user's."""
    return F.when(F.coalesce(question.rlike(ASKS_ASSISTANT), F.lit(False)), "assistant").otherwise("user")


def hash_embed(texts: DataFrame, dim: int = 64, key: str = "id") -> DataFrame:
    """(key, embedding): counts of tokens by sha1 modulo ``dim``, as a unit vector."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                v = np.zeros(dim)
                for w in (t or "").lower().split():
                    v[int(hashlib.sha1(w.encode()).hexdigest(), 16) % dim] += 1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pa.record_batch([batch[key], pa.array(out, pa.list_(pa.float64()))], [key, "embedding"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, embedding array<double>")


def extract_rules(episodes: DataFrame, keep: tuple[str, ...] = ("event_id", "occurred_at")) -> DataFrame:
    """(keep..., type, src, dst) edges by action; an edge needs both of its ends.

    ``episodes``: event_id, occurred_at, action_type, org_id, user_id, agent_id,
    server_id, skill_id, chat_id, target_user_id, statement.
    """
    a = F.col("action_type")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    user, target = node("User", "user_id"), node("User", "target_user_id")
    thing = F.coalesce(F.when(a.startswith("agent."), node("Agent", "agent_id")), F.when(a.startswith("mcp."), node("MCPServer", "server_id")), F.when(a.startswith("skill."), node("Skill", "skill_id")))
    edge = lambda when, kind, src, dst: F.when(when & src.isNotNull() & dst.isNotNull(), F.struct(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst")))
    status = F.coalesce(*[F.when(a == k, f"Status:{v}") for k, v in STATUS.items()])
    fact = F.concat(F.lit("Fact:"), slug(F.col("statement")))
    edges = F.array(
        edge(F.lit(True), "MEMBER_OF", user, node("Org", "org_id")), edge(a.isin(*AUTHORED), "AUTHORED", user, thing), edge(a.isin(*DEPLOYED), "DEPLOYED", user, thing),
        edge(status.isNotNull(), "HAS_STATUS", thing, status), edge(a.isin(*USED), "USED_SKILL", user, thing), edge(a.isin(*TOOK_PART), "PARTICIPATED_IN", user, node("Chat", "chat_id")),
        edge(a.isin(*JOINED), "MEMBER_OF", F.coalesce(target, user), node("Org", "org_id")), edge((a == "fact.observed") & F.col("statement").isNotNull(), "DECIDED", user, fact),
    )
    return episodes.select(*keep, F.explode(F.array_distinct(F.array_compact(edges))).alias("e")).select(*keep, "e.*")


def extract_claims(episodes: DataFrame, most: int = 400, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Keyed claims as anchor and value; learnings of three words or more as facts.

    ``episodes``: event_id, occurred_at, user_id, kind, topic, key, value, evidence_ids.
    """
    me = F.replace(F.col("topic"), F.lit("{me}"), F.col("user_id").cast("string"))
    prefix = F.when(F.col("kind") == "state", "state").when(F.col("kind") == "preference", "pref").when(F.col("kind") == "record", "record")
    anchor = F.concat_ws(":", prefix, me, "key")
    value = F.substring(normalize_fact(F.col("value")), 1, most)
    grounded = F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) > 0
    learning = (F.col("kind") == "learning") & (F.size(F.split(value, r"\s+")) >= 3)
    kept = episodes.where((prefix.isNotNull() & value.isNotNull()) | learning)
    return kept.select(
        *keep, F.col("occurred_at").alias("valid_at"), F.when(learning, "Fact").otherwise("Metric").alias("type"), F.when(learning, slug(value)).otherwise(anchor).alias("anchor"),
        value.alias("value"), F.when(learning, F.when(grounded, 0.7).otherwise(0.4)).alias("confidence"),
    )


def presence_targets(claims: DataFrame) -> DataFrame:
    """State claims that say their key is gone, or (on watch topics) there again."""
    first = F.lower(F.regexp_replace(F.split("value", r"\s+")[0], r"[.,;:!]+$", ""))
    watched = F.col("topic").contains("/watch/")
    said = F.when(first.isin(*ABSENCE), "absent").when(first.isin(*PRESENCE) & watched, "present")
    return claims.withColumn("presence", said).where("presence is not null")


def session_insights(docs: DataFrame, most: int = 10, cut: int = 120) -> DataFrame:
    """(doc_id, n, kind, name): sentences of four words or more with a marker; the first marker listed wins."""
    each = docs.select("doc_id", F.posexplode(sentences(F.col("text"), 4)).alias("pos", "sentence"))
    kind = F.coalesce(*[F.when(F.array_contains(F.split(F.lower("sentence"), r"\s+"), m), k) for m, k in INSIGHT_MARKERS.items()])
    order = Window.partitionBy("doc_id").orderBy("pos")
    marked = each.withColumn("kind", kind).where("kind is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return marked.select("doc_id", "n", "kind", F.substring("sentence", 1, cut).alias("name"))


def grounded(facts: DataFrame, docs: DataFrame, least: int = 8) -> DataFrame:
    """Facts whose quote stands in their document, white space aside."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    met = facts.join(docs.select("doc_id", "text"), "doc_id")
    return met.where((F.length(flat(F.col("span"))) >= least) & F.contains(flat(F.col("text")), flat(F.col("span")))).drop("text")


def fold_topics(facts: DataFrame) -> DataFrame:
    """Count and sum by unit of each topic.

    A set replaces what is dated on or before it; later adds and removes count
    from there; a fact said again on its date counts once; no sum falls below 0.
    ``facts``: topic, fact, date, op (add, remove, set, none), qty, unit.

    A sum that is held at 0 whenever it would fall below is the running sum less
    the least it ever was below 0, so a topic of any length needs one window.
    """
    said = facts.groupBy("topic", "date", "fact").agg(F.min(F.struct("op", F.coalesce("qty", F.lit(0.0)).cast("double").alias("qty"), F.coalesce("unit", F.lit("")).alias("unit"))).alias("f")).select("topic", "date", "fact", "f.*")
    last = said.groupBy("topic").agg(F.max(F.when(F.col("op") == "set", F.col("date"))).alias("_set"))
    met = said.join(last, "topic")
    starts = (F.col("op") == "set") & (F.col("date") == F.col("_set"))
    moves = F.col("op").isin("add", "remove") & (F.col("_set").isNull() | (F.col("date") > F.col("_set")))
    kept = met.where(starts | moves)
    change = F.when(F.col("op") == "add", F.col("qty")).when(F.col("op") == "remove", -F.col("qty"))
    order = Window.partitionBy("topic", "unit").orderBy("date", F.col("op") != "set", "fact")
    first = F.last(F.when(F.col("op") == "set", F.col("qty")), ignorenulls=True).over(order)
    running = kept.withColumn("_start", F.coalesce(first, F.lit(0.0))).withColumn("_run", F.sum(change).over(order)).withColumn("_level", F.col("_start") + F.col("_run"))
    level = F.when(F.count("_run") > 0, F.max_by("_level", F.struct("date", "fact")) - F.least(F.lit(0.0), F.min("_level"))).otherwise(F.max_by("_start", F.struct("date", "fact")))
    sums = running.groupBy("topic", "unit").agg(level.alias("total"))
    counts = met.groupBy("topic").agg(F.count_if(starts | moves).alias("n"))
    return counts.join(sums, "topic", "left").select("topic", F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("total", F.lit(0.0)).alias("total"), "n")
