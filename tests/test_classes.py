"""Rankings by shared words over classes of equal rows, passages scored inside tasks, briefs by topics: against plain versions."""

import datetime as dt
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalist.operators import brief, fold, graph, lexical, reports, retrieve, search

WORDS = ["red", "gear", "small", "hot", "ring", "rod"]


def written(spark, made):
    """Rows that the steps of a query handed on, at most: the metrics of its executed plan."""
    made.collect()
    plan, most = made._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
        found = node.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(1)
    names = [" ".join(draw.choice(WORDS) for _ in range(draw.choice([1, 2, 3]))) for _ in range(40)]
    items = [(i, draw.choice(names), draw.choice(["B#1", "B#2"]), draw.choice([1, 2]), i % 3 == 0) for i in range(300)]
    asked = [(i, draw.choice([*names, "none of these", "Red  gear"])) for i in range(60)]
    return items, asked, spark.createDataFrame(items, "id int, name string, brand string, size int, flag boolean"), spark.createDataFrame(asked, "query_id int, question string")


def words(s, least=3):
    return {w for w in s.lower().replace("/", " ").replace("#", " ").split() if len(w) >= least}


def best(asked, items, key, k):
    out = set()
    for q, text in asked:
        hits = sorted(x for i in items if (x := key(text, i)) is not None)
        out |= {(q, n, *h) for n, h in enumerate(hits[:k], 1)}
    return out


def test_cold_candidates_over_classes(spark, tables):
    items, asked, df, q = tables
    made = retrieve.cold_candidates(q, df.select(F.col("id").alias("item_id"), F.col("name").alias("title"), F.lit(None).cast("string").alias("path"), F.col("size").alias("modified_at"), F.when(F.col("flag"), "admitted").otherwise("listed").alias("status")), 4)
    key = lambda t, i: (-len(words(t) & words(i[1])), -i[3], i[0]) if words(t) & words(i[1]) and not i[4] else None
    assert {(r["query_id"], r["rank"], -r["overlap"], -r["modified_at"], r["item_id"]) for r in made.collect()} == best(asked, items, key, 4)


def test_copies_are_not_compared(spark):
    """A thousand equal questions against a thousand equal items, of which each gets five: a million pairs before."""
    q = spark.range(1000).select(F.col("id").alias("query_id"), F.lit("hot ring").alias("question"))
    items = spark.range(1000).select(F.col("id").alias("item_id"), F.lit("hot rod").alias("title"), F.lit("x").alias("path"), F.lit(1).alias("modified_at"), F.lit("listed").alias("status"))
    made = retrieve.cold_candidates(q, items)
    assert made.count() == 5000 and written(spark, made) <= 5000


def test_title_leg_over_classes(spark, tables):
    items, asked, df, q = tables
    twice = df.select(F.col("id").alias("doc_id"), F.col("name").alias("title")).unionByName(df.where("id = 7").select(F.col("id").alias("doc_id"), F.lit("red gear hot").alias("title")))
    more = [(7, "red gear hot " + next(i[1] for i in items if i[0] == 7)), *((i[0], i[1]) for i in items if i[0] != 7)]
    key = lambda t, i: (i[0],) if words(t) & words(i[1]) else None
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in retrieve.title_leg(q, twice, 6).collect()} == best(asked, more, key, 6)


def test_leading_value_over_classes(spark, tables):
    items, asked, df, q = tables
    facts = df.select(F.col("id").alias("fact_id"), F.col("size").alias("rank"), F.col("flag").alias("keyed"), F.concat_ws("/", "name", "brand").alias("anchor"))

    def key(t, i):
        n = len(words(t) & (words(i[1]) | {i[2].lower()}))
        return (-n, i[3], i[0]) if n >= (1 if i[4] else 2) else None

    assert {(r["query_id"], 1, -r["overlap"], r["fact_id"]) for r in search.leading_value(q, facts).collect()} == {(a, b, c, e) for a, b, c, _, e in best(asked, items, key, 1)}


def test_node_lexical_over_classes(spark, tables):
    items, asked, df, q = tables
    nodes = df.select(F.col("id").alias("node_id"), "name", F.lit(None).cast("string").alias("summary"), F.col("brand").alias("key"))

    def key(t, i):
        a, b = set(t.lower().split()), set(i[1].split()) | set(i[2].lower().split("#"))
        t = t.lower().strip()
        return (-round(len(a & b) / len(a) + (0.5 if i[2].lower().startswith(t) or t in i[1] else 0), 6), i[0]) if a & b else None

    assert {(r["query_id"], r["rank"], -r["score"], r["node_id"]) for r in search.node_lexical(q, nodes, 7).collect()} == best(asked, items, key, 7)


def test_inject_values_over_classes(spark, tables):
    items, asked, df, q = tables
    got = graph.inject_values(q, df.select(F.col("id").alias("anchor_id"), F.col("name").alias("anchor_key"))).collect()
    want = {(a, i[0], n) for a, t in asked for i in items if (n := len(words(t) & words(i[1]))) >= 2}
    assert len(got) == len(want) and {(r["query_id"], r["anchor_id"], r["overlap"]) for r in got} == want


def test_known_subjects_asks_each_subject_once(spark):
    """Subjects that are told a thousand times meet the anchors once."""
    states = spark.range(1000).select(F.col("id").alias("state_id"), F.when(F.col("id") % 2 == 0, "hot ring").when(F.col("id") == 1, F.lit(None)).otherwise("blue").alias("subject"))
    anchors = spark.createDataFrame([("hot",), ("hot rod",), ("ring",)], "anchor string")
    made = fold.known_subjects(states, anchors)
    assert made.columns == ["state_id", "subject", "anchor"] and {(r["subject"], r["anchor"]) for r in made.collect()} == {("hot ring", "hot"), (None, "fact"), ("blue", "blue")} and written(spark, made) <= 1000


def test_run_pointers_are_not_met_by_id(spark):
    """A thousand bullets cite one run: its id is no join key."""
    now = F.lit(dt.datetime(2024, 2, 1))
    cite = lambda kind, i, at: F.struct(F.lit(kind).alias("kind"), i.alias("id"), at.alias("at"))
    none = F.lit(None).cast("timestamp")
    odd = F.when(F.col("id") % 2 == 1, now)
    bullets = spark.range(1000).select(F.col("id").alias("note_id"), F.lit(0).alias("bullet"), F.array(cite("edge", F.col("id").cast("string"), none), cite("run", F.lit("r"), odd)).alias("citations"))
    stale = spark.range(0, 1000, 4).select(F.col("id").cast("string").alias("id")).unionByName(spark.createDataFrame([("r",)], "id string"))
    made = reports.close_threads(bullets, stale, now)
    assert {r["note_id"] for r in made.where("closed").collect()} == set(range(0, 1000, 4))
    assert "kind" in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Join LeftOuter") == 2 and "Union" in plan


def test_briefs_by_topics(spark):
    hops = spark.createDataFrame([(1, f"h{i}", "w", [(f"t{i % 2}*", "build")]) for i in range(6)] + [(1, "bare", "w", [])], "org_id int, hop string, workspace string, topics array<struct<id:string,phase:string>>")
    values = spark.createDataFrame([(1, f"state:t{i % 3}/x:{i}", f"t{i % 3}/x", str(i), "v", None, None) for i in range(9)], "org_id int, key string, topic string, claim_key string, value string, valid_at timestamp, invalid_at timestamp")
    facts = spark.createDataFrame([(i, 1, "org", None, "build" if i == 8 else None, f"t{i % 3}", "f", "endorsed", None) for i in range(9)], "fact_id int, org_id int, scope string, workspace string, phase string, topic string, fact string, tier string, hops array<string>")
    episodes = spark.createDataFrame([], "event_id int, org_id int, occurred_at timestamp, action_type string, hop string, version string, score double, runs int, decision string, run_result string, kind string, value string")
    at = F.lit(dt.datetime(2024, 1, 10))
    grouped, each = brief.builder_briefs(hops, values, facts, episodes, at, 5, grouped=True), brief.builder_briefs(hops, values, facts, episodes, at, 5)
    assert grouped["members"].count() == 7 and grouped["state"].count() == 6 and grouped["learnings"].count() == 9
    for name, of in (("state", "claim_key"), ("learnings", "fact_id")):
        dealt = grouped[name].join(grouped["members"], ["org_id", "topics"])
        assert sorted((r["hop"], r[of]) for r in dealt.collect()) == sorted((r["hop"], r[of]) for r in each[name].collect())
    assert {r["fact_id"] for r in each["learnings"].where("hop = 'bare'").collect()} == {8}


@pytest.mark.parametrize("k", [1, 3, 60])
def test_passages_are_scored_in_tasks_as_by_joins(spark, k, monkeypatch):
    draw = random.Random(2)
    pool = ["red", "gear", "Small", "hot_1", "ab", "ring", "éclair", "the", "K"]
    docs = [(i, " ".join(draw.choice(pool) for _ in range(draw.choice([0, 1, 5, 400])))) for i in range(60)] + [(100 + i, "red gear ring") for i in range(30)] + [(200, None)]
    chunks = retrieve.chunks_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    q = spark.createDataFrame([(i, " ".join(draw.choice(pool) for _ in range(4))) for i in range(12)] + [(90, "absent"), (91, "")], "query_id int, question string")
    monkeypatch.setattr(lexical, "QUERIES", 5)
    monkeypatch.setattr(lexical, "ROWS", 7)
    told = retrieve.lexical_topk(q, chunks, k)
    assert lexical.best_passages(retrieve.terms_of_queries(q), chunks, k).count() <= chunks.rdd.getNumPartitions() * 14 * k
    monkeypatch.setattr(retrieve, "BROADCAST_BYTES", -1)
    joined = retrieve.lexical_topk(q, chunks, k)
    assert told.schema.simpleString() == joined.schema.simpleString()
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, joined.collect())) != []


def test_best_of_a_task_keeps_ties_in_order():
    import numpy as np

    batch = lambda ids: pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * len(ids), pa.int32()), pa.array([[0]] * len(ids), pa.list_(pa.int32()))], ["doc_id", "ordinal", "terms"])
    told = list(lexical.told_best(iter([batch([9, 8, 7]), batch([]), batch([3, 12])]), (np.array([0]), np.array([0]), np.array([0.5])), 1, 1, 2))
    assert [t.column("doc_id").to_pylist() for t in told] == [[3, 7]] and list(itertools.chain(*(t.column("score").to_pylist() for t in told))) == [0.5, 0.5]


def test_one_timer_for_all_that_waits():
    """A memory's observations set one timer and not one each; what the watermark has not passed sets the next."""
    import pandas as pd

    from annalist.streaming.working import WorkingMemory

    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        put = update = lambda self, x: setattr(self, "value", x)
        clear = lambda self: setattr(self, "value", None)
        appendList = lambda self, x: setattr(self, "value", [*(self.value or []), *x])  # noqa: E731, N815

    class Handle:
        timers: list = []
        registerTimer = lambda self, t: self.timers.append(t)  # noqa: E731, N815
        getListState = getValueState = lambda self, *a: Held()  # noqa: E731, N815

    class At:
        getCurrentWatermarkInMs = lambda self: 86_400_000 * 4  # noqa: E731, N815

    memory, handle = WorkingMemory(), Handle()
    memory.init(handle)
    at = pd.to_datetime([3, 5, 1, 2, 6], unit="D")
    assert list(memory.handleInputRows(("k",), iter([pd.DataFrame({"at": at, "committed": [False] * 5})]), None)) == []
    assert handle.timers == [86_400_000]
    assert list(memory.handleExpiredTimer(("k",), At(), None)) == []
    assert handle.timers[1] == 86_400_000 * 5 and memory.life.get() == (86_400_000_000, False) and len(memory.ahead.get()) == 2
