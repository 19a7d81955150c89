"""The whole fold of episodes into memory, at once or micro-batch by micro-batch, with the same end.

Gate, hygiene, passages, extraction, resolution by key and the edges' history
are one plan.  What an episode says does not depend on others, so it is taken
out once, when it comes; two things do depend on others, and both are settled
in an order that is not that of arrival at the fold: which documents a day's
budget admits (by their stamps), and an edge's history (by world time).

``fold_all`` gives the tables of all episodes.  ``Fold.step`` adds a batch to
tables that are kept: it settles the budgets of the days that the batch touches
anew, then the edges and nodes of whatever changed, and appends these under the
batch's number; of a key the rows of its last number hold.  Nothing is rewritten
in place, a batch that is tried again writes the same files again, and readers
see the batches that are finished.  Any split and any order of the same
episodes end in the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.text import chunk_paragraphs, pii_kinds, redact
from annalist.operators.extract import extract_claims, extract_rules, presence_targets
from annalist.operators.governance import daily_budget, drop_reason, resolve_consent
from annalist.operators.temporal import end_edges, supersede
from annalist.operators.values import DEFAULT, Watched, extract_values
from annalist.sources.shared import keep

EPISODE = (
    "event_id", "occurred_at", "ingested_at", "org_id", "scope", "scope_id", "user_id", "source", "action_type", "lifecycle", "content", "salience", "agent_id", "server_id", "skill_id", "chat_id",
    "target_user_id", "statement", "kind", "topic", "key", "value", "evidence_ids",
)
#: Types of which a source has one edge at a time.
FUNCTIONAL = ("HAS_VALUE", "HAS_STATUS")
DOCUMENT, CLAIM, REMOVED = "document.ingested", "memory.claim", "org.member_removed"
STAMP = ("event_id", "occurred_at", "ingested_at", "scope", "scope_id", "lifecycle")
#: What an edge's history belongs to: ``slot`` is the other end where a source may have many.
KEY = ("scope", "scope_id", "type", "src", "slot")
NODE = ("scope", "scope_id", "node")


@dataclass
class Rules:
    """``consent``: scope, scope_id, state; ``deny`` and ``allow``: lists of sources; ``floor`` of salience; ``cap`` of documents of a source in a day."""

    consent: DataFrame
    deny: Column
    allow: Column
    floor: float
    cap: int
    watched: Sequence[Watched] = field(default=DEFAULT)


def prepare(episodes: DataFrame, rules: Rules) -> DataFrame:
    """Episodes with secrets replaced, and the reasons to drop them that go before the budget (``early``) and after it (``late``)."""
    judged = resolve_consent(episodes.select(*EPISODE), rules.consent).withColumn("early", F.coalesce("consent_reason", drop_reason(F.col("source"), rules.deny, rules.allow)))
    low = F.when((F.col("action_type") == DOCUMENT) & (F.col("salience") < rules.floor), F.concat(F.lit("salience:"), F.col("salience").cast("string")))
    kinds = pii_kinds(F.coalesce("content", F.lit("")))
    personal = F.when((F.col("action_type") == CLAIM) & (F.col("scope") != "user") & (F.size(kinds) > 0), F.concat(F.lit("pii:"), F.array_join(kinds, "+")))
    clean = lambda c: F.when(F.col(c).isNotNull(), redact(F.col(c))[0])
    marked = judged.withColumn("late", F.coalesce(low, personal)).drop("consent_reason")
    filled = {"lifecycle": F.coalesce("lifecycle", F.lit("committed")), "scope_id": F.coalesce(F.col("scope_id").cast("string"), F.lit(""))}
    return marked.withColumns({c: clean(c) for c in ("content", "statement", "value")} | filled)


def over_budget(prepared: DataFrame, cap: int) -> DataFrame:
    """(event_id, reason) of all documents that the day's budget has to judge; the reason is null for those admitted."""
    docs = prepared.where(F.col("early").isNull() & (F.col("action_type") == DOCUMENT))
    return daily_budget(docs.select("event_id", "source", "ingested_at"), ["source"], F.lit(cap)).select("event_id", F.col("drop_reason").alias("reason"))


def observe(prepared: DataFrame, watched: Sequence[Watched] = DEFAULT) -> DataFrame:
    """What each episode says, budget aside: (STAMP..., type, src, slot, value, dst): rules, claims, watched values, ends.

    Of a functional type the value is the other end; of others it is open or
    ended.  A state claim that says its key is gone, or back, is PRESENCE.
    """
    kept = prepared.where("early is null and late is null")
    said = lambda df, slot, value: df.select(*STAMP, "type", "src", slot.alias("slot"), value.alias("value"), "dst")
    functional = F.col("type").isin(*FUNCTIONAL)
    rules = extract_rules(kept.where(F.col("action_type") != CLAIM), STAMP)
    rules = said(rules, F.when(functional, "").otherwise(F.col("dst")), F.when(functional, F.col("dst")).otherwise("open"))
    claims = extract_claims(kept.where(F.col("action_type") == CLAIM), keep=STAMP)
    keyed = claims.where("type = 'Metric'").select(*STAMP, F.lit("HAS_VALUE").alias("type"), F.col("anchor").alias("src"), F.concat_ws("=", "anchor", "value").alias("dst"))
    facts = claims.where("type = 'Fact'").select(*STAMP, F.lit("STATES").alias("type"), F.lit("claims").alias("src"), F.concat(F.lit("Fact:"), "anchor").alias("dst"))
    texts = kept.where((F.col("action_type") != CLAIM) & F.col("content").isNotNull()).withColumn("text", F.col("content"))
    seen = extract_values(texts, watched, STAMP).select(*STAMP, F.lit("HAS_VALUE").alias("type"), F.col("key").alias("src"), F.concat_ws("=", "key", "value").alias("dst"))
    who = F.concat(F.lit("User:"), F.coalesce("target_user_id", "user_id").cast("string"))
    gone = kept.where(F.col("action_type") == REMOVED).select(*STAMP, F.lit("MEMBER_OF").alias("type"), who.alias("src"), F.concat(F.lit("Org:"), F.col("org_id").cast("string")).alias("dst"))
    there = presence_targets(kept.where((F.col("action_type") == CLAIM) & (F.col("kind") == "state"))).select(*STAMP, F.lit("PRESENCE").alias("type"), F.col("key").alias("src"), F.col("presence").alias("dst"))
    parts = [rules, said(keyed.unionByName(seen), F.lit(""), F.col("dst")), said(facts, F.col("dst"), F.lit("open")), said(gone, F.col("dst"), F.lit("ended")), said(there, F.lit(""), F.col("dst"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("src is not null and dst is not null").distinct()


def edges_of(observations: DataFrame) -> DataFrame:
    """(KEY..., dst, valid_at, invalid_at, event_id): the intervals of each key, as half-open ones in world time."""
    obs = observations.where("type <> 'PRESENCE'").withColumnRenamed("occurred_at", "valid_at")
    runs = supersede(obs.select(*KEY, "value", "valid_at", "ingested_at", "event_id"), list(KEY), "value")
    other = F.when(F.col("type").isin(*FUNCTIONAL), F.col("value")).otherwise(F.col("slot"))
    return runs.where(F.col("type").isin(*FUNCTIONAL) | (F.col("value") == "open")).select(*KEY, other.alias("dst"), "valid_at", "invalid_at", "event_id")


def nodes_of(observations: DataFrame) -> DataFrame:
    """(NODE..., first_at, last_at, observed_count, lifecycle): ends of edges; one committed observation promotes a node."""
    obs = observations.where("type <> 'PRESENCE' and value <> 'ended'")
    ends = obs.select("scope", "scope_id", "event_id", "occurred_at", "lifecycle", F.explode(F.array("src", "dst")).alias("node")).distinct()
    committed = F.when(F.bool_or(F.col("lifecycle") == "committed"), "committed").otherwise("working")
    return ends.groupBy(*NODE).agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count("*").alias("observed_count"), committed.alias("lifecycle"))


def views(edges: DataFrame, nodes: DataFrame, presence: DataFrame, ledger: DataFrame, budget: DataFrame, chunk: int = 1000) -> dict[str, DataFrame]:
    """The tables that readers use.

    ``edges`` end where an entity at either end was said to be gone after they
    began; ``nodes`` have their status (ended, superseded, working, committed);
    ``episodes`` why each was dropped; ``chunks`` the passages of those that were not.
    """
    gone = presence.where("dst = 'absent'").select("scope", "scope_id", F.col("src").alias("key"), F.col("occurred_at").alias("ended_at"))
    entity = lambda end: F.element_at(F.split(F.col(end), ":", 2), -1)
    closed = edges.withColumns({"_src": entity("src"), "_dst": entity("dst")})
    for end in ("_src", "_dst"):
        closed = end_edges(closed, gone.withColumnRenamed("key", end), ["scope", "scope_id", end])
    closed = closed.drop("_src", "_dst")
    last = presence.groupBy("scope", "scope_id", F.col("src").alias("_key")).agg(F.max_by("dst", F.struct("occurred_at", "dst")).alias("_last"))
    values = closed.where("type = 'HAS_VALUE'").groupBy("scope", "scope_id", F.col("dst").alias("node")).agg(F.bool_or(F.col("invalid_at").isNull()).alias("_open"))
    met = nodes.withColumn("_key", entity("node")).join(last, ["scope", "scope_id", "_key"], "left").join(values, list(NODE), "left")
    status = F.when(F.col("_last") == "absent", "ended").when(~F.col("_open"), "superseded").otherwise(F.col("lifecycle"))
    judged = ledger.join(budget, "event_id", "left").withColumn("dropped_reason", F.coalesce("early", "reason", "late"))
    chunks = judged.where("dropped_reason is null and content is not null").select("event_id", F.posexplode(chunk_paragraphs(F.col("content"), chunk)).alias("ordinal", "content"))
    return {
        "edges": closed, "nodes": met.withColumn("status", status).drop("_key", "_last", "_open", "lifecycle"),
        "episodes": judged.select("event_id", "dropped_reason"), "chunks": chunks,
    }


def fold_all(episodes: DataFrame, rules: Rules) -> dict[str, DataFrame]:
    """All tables from nothing; of an event_id that comes twice the first by its stamp counts."""
    first = F.min_by(F.struct(*EPISODE), F.struct("ingested_at", F.xxhash64(*EPISODE)))
    ledger = keep(prepare(episodes.groupBy("event_id").agg(first.alias("e")).select("e.*"), rules))
    budget = over_budget(ledger, rules.cap)
    dropped = budget.where("reason is not null").select("event_id")
    admitted = keep(observe(ledger, rules.watched).join(dropped, "event_id", "left_anti"))
    return views(edges_of(admitted), nodes_of(admitted), admitted.where("type = 'PRESENCE'"), ledger, budget)


class Fold:
    """Tables below ``base`` that batches are added to."""

    TABLES = ("ledger", "observations", "budget", "edges", "nodes")

    def __init__(self, spark: SparkSession, base: str, rules: Rules):
        self.spark, self.base, self.rules = spark, base.rstrip("/"), rules

    def step(self, batch: DataFrame, epoch: int) -> None:
        """Add a batch; for ``foreachBatch``.  The same epoch again replaces what it wrote."""
        first = F.min_by(F.struct(*EPISODE), F.struct("ingested_at", F.xxhash64(*EPISODE)))
        new = batch.groupBy("event_id").agg(first.alias("e")).select("e.*")
        old = self.before("ledger", epoch)
        if old is not None:
            new = new.join(old.select("event_id"), "event_id", "left_anti")
        prepared = self.write("ledger", epoch, prepare(new, self.rules))
        said = self.write("observations", epoch, observe(prepared, self.rules.watched))
        ledger, observations = self.with_old("ledger", epoch, prepared), self.with_old("observations", epoch, said)

        days = prepared.where(F.col("early").isNull() & (F.col("action_type") == DOCUMENT)).select("source", F.to_date("ingested_at").alias("_day")).distinct()
        judged = over_budget(ledger.withColumn("_day", F.to_date("ingested_at")).join(days, ["source", "_day"], "left_semi").drop("_day"), self.rules.cap)
        known = self.last("budget", ["event_id"], epoch - 1)
        if known is not None:
            was = known.select("event_id", F.col("reason").alias("_was"), F.lit(True).alias("_known"))
            judged = judged.join(was, "event_id", "left").where(F.col("_known").isNull() | ~F.col("reason").eqNullSafe(F.col("_was"))).select("event_id", "reason")
        changed = self.write("budget", epoch, judged)
        dropped = self.last("budget", ["event_id"], epoch).where("reason is not null").select("event_id")

        moved = prepared.select("event_id").unionByName(changed.select("event_id")).distinct()
        touched = observations.join(moved, "event_id", "left_semi").where("type <> 'PRESENCE'")
        keys = touched.select(*KEY).distinct()
        admitted = observations.join(dropped, "event_id", "left_anti")
        edges = edges_of(admitted.join(keys, list(KEY), "left_semi"))
        self.write("edges", epoch, keys.join(edges, list(KEY), "left"))
        nodes = touched.select("scope", "scope_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
        met = admitted.where("type <> 'PRESENCE'").withColumn("node", F.explode(F.array("src", "dst"))).join(nodes, list(NODE), "left_semi").drop("node").distinct()
        found = nodes_of(met).join(nodes, list(NODE), "left_semi")
        self.write("nodes", epoch, nodes.join(found, list(NODE), "left"))
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.base}/marks/epoch={epoch}")

    def write(self, table: str, epoch: int, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{table}/epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def epochs(self, below: int | None = None) -> list[int]:
        """Numbers of finished batches."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/marks")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [int(f.getPath().getName().removeprefix("epoch=")) for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if below is None or n < below)

    def before(self, table: str, epoch: int | None = None) -> DataFrame | None:
        """All rows of finished batches before ``epoch``, with their number."""
        paths = [f"{self.base}/{table}/epoch={n}" for n in self.epochs(epoch)]
        return self.spark.read.option("basePath", f"{self.base}/{table}").parquet(*paths) if paths else None

    def with_old(self, table: str, epoch: int, new: DataFrame) -> DataFrame:
        old = self.before(table, epoch)
        return new if old is None else old.drop("epoch").unionByName(new)

    def last(self, table: str, key: Sequence[str], epoch: int | None = None) -> DataFrame | None:
        """Of each key the rows of its last batch, up to ``epoch`` (which need not be finished)."""
        numbers = self.epochs(None if epoch is None else epoch + 1)
        numbers = numbers if epoch is None or epoch < 0 else sorted({*numbers, *self._written(table, epoch)})
        if not numbers:
            return None
        rows = self.spark.read.option("basePath", f"{self.base}/{table}").parquet(*[f"{self.base}/{table}/epoch={n}" for n in numbers])
        newest = rows.groupBy(*key).agg(F.max("epoch").alias("epoch"))
        return rows.join(newest, [*key, "epoch"], "left_semi").drop("epoch")

    def _written(self, table: str, epoch: int) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{table}/epoch={epoch}/_SUCCESS")
        return [epoch] if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else []

    def tables(self) -> dict[str, DataFrame]:
        """The tables over all finished batches."""
        ledger, observations = (self.before(t).drop("epoch") for t in ("ledger", "observations"))
        budget = self.last("budget", ["event_id"])
        dropped = budget.where("reason is not null").select("event_id")
        presence = observations.where("type = 'PRESENCE'").join(dropped, "event_id", "left_anti")
        edges = self.last("edges", KEY).where("dst is not null")
        nodes = self.last("nodes", NODE).where("observed_count is not null")
        return views(edges, nodes, presence, ledger, budget)
