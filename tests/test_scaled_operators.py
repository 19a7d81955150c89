"""Vector search by lists, folds with bounded state, contradictions by shared words: against plain versions."""

import datetime as dt
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalist.functions.text import NEGATIONS
from annalist.operators import extract, governance, graph, search, temporal, vectors
from annalist.plans import queries
from annalist.plans.queries import load
from annalist.sources.shared import keep

DAY = dt.datetime(2024, 1, 1)


def plain_topk(asked, table, k):
    out = []
    for q, a in asked:
        scored = []
        for i, v in table:
            if v is None or a is None:
                continue
            n = min(len(a), len(v))
            x, y = np.array([0.0 if c is None else c for c in a]), np.array([0.0 if c is None else c for c in v])
            scale = np.linalg.norm(x) * np.linalg.norm(y)
            scored.append((-round(float(x[:n] @ y[:n]) / scale, 6) if scale else 0.0, i))
        out += [(q, i, -s + 0.0, n) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_exact_search(spark, monkeypatch):
    draw = np.random.default_rng(0)
    table = [(i, draw.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(400, 420)] + [(500, None), (501, []), (502, [0.0] * 8), (503, [None, 1.0]), (504, [1.0] * 12)]
    asked = [(i, table[i][1]) for i in range(0, 300, 30)] + [(900, [1.0] * 8), (901, None), (902, [0.0] * 8), (903, [2.0, 1.0])]
    monkeypatch.setattr(vectors, "ROWS", 50)
    df = spark.createDataFrame(table, "vec_id int, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    got = {(r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in vectors.exact_topk(q, df, 7).collect()}
    assert got == {(a, b, round(c, 6), d) for a, b, c, d in plain_topk(asked, table, 7)}
    assert vectors.exact_topk(q.limit(0), df).count() == 0 and vectors.exact_topk(q, df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [vectors.BUCKET, 40])
def test_recall_of_the_index(spark, bucket):
    sf = "/root/testdata/sf0.1"
    e = load(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vectors.build_index(e, bucket=bucket)
    assert index.rows.count() == e.where("embedding is not null").count()
    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.select("query_id", "vec_id").collect()}
    exact = pairs(queries.QUERIES["R2_vector_topk"](spark, sf))
    got = pairs(vectors.index_topk(q, index))
    assert len(got & exact) >= 0.9 * len(exact)
    assert pairs(vectors.index_topk(q, index, probes=len(index.centroids))) == exact


def plain_arrivals(rows):
    out, open_ = [], {}
    for key, value, at, told, event in sorted(rows, key=lambda r: (r[0], r[3], r[4])):
        mine = open_.get(key)
        if mine and mine[1] == value:
            continue
        edge = [key, value, at, None, event]
        if mine is None or at >= mine[2]:
            if mine:
                mine[3] = at
            open_[key] = edge
        else:
            edge[3] = mine[2]
        out.append(edge)
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_supersession_by_arrival(spark, batch):
    draw = np.random.default_rng(1)
    rows = [(int(draw.integers(0, 5)), "abc"[draw.integers(0, 3)], DAY + dt.timedelta(int(draw.integers(0, 40))), DAY + dt.timedelta(int(draw.integers(0, 20))), i) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, dst string, valid_at timestamp, ingested_at timestamp, event_id long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(r["user_id"], r["dst"], r["valid_at"], r["invalid_at"], r["event_id"]) for r in temporal.supersede_by_arrival(df, ["user_id"]).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got, key=repr) == plain_arrivals(rows)
    assert temporal.supersede_by_arrival(df.limit(0), ["user_id"]).count() == 0


def plain_tallies(rows):
    topics = {}
    for topic, fact, date, op, qty, unit in rows:
        topics.setdefault(topic, {}).setdefault((date, fact), (op, qty or 0.0, unit or ""))
    out = []
    for topic, said in topics.items():
        order = sorted(((d, op != "set", f, op, q, u) for (d, f), (op, q, u) in said.items()))
        last = max((d for d, *_, op, _, _ in order if op == "set"), default=None)
        sums, n = {}, 0
        for d, _, _, op, q, u in order:
            if op == "set" and d == last:
                sums[u], n = q, n + 1
            elif op in ("add", "remove") and (last is None or d > last):
                sums[u], n = max(0.0, sums.get(u, 0.0) + (q if op == "add" else -q)), n + 1
        out += [(topic, u, t, n) for u, t in sums.items()] or [(topic, "", 0.0, n)]
    return sorted(out)


def test_tallies_of_topics(spark):
    draw = np.random.default_rng(2)
    ops = ["add", "add", "remove", "remove", "set", "none"]
    rows = [(f"t{draw.integers(0, 12)}", f"f{i}", f"2024-01-{draw.integers(10, 30)}", ops[draw.integers(0, 6 if i % 3 else 4)], float(draw.integers(0, 9)), ["usd", None, "h"][draw.integers(0, 3)]) for i in range(400)]
    rows += [("only none", "x", "2024-01-01", "none", 5.0, "usd"), ("below", "a", "2024-01-01", "remove", 9.0, "x"), ("below", "b", "2024-01-02", "add", 2.0, "x"), ("nulls", "a", "2024-01-01", "add", None, None)]
    rows += [("one date", f"f{i}", "2024-01-05", "set" if i < 3 else "add", float(i), "usd") for i in range(6)] + [rows[0]] * 2
    df = spark.createDataFrame(rows, "topic string, fact string, date string, op string, qty double, unit string")
    got = sorted((r["topic"], r["unit"], round(r["total"], 9), r["n"]) for r in extract.fold_topics(df).collect())
    assert got == plain_tallies(rows)


def plain_contradictions(edges, most=5):
    def words(t):
        return set(re.findall("[a-z0-9]+", t.lower()))

    closed = {}
    for e in edges:
        fit = [f for f in edges if f[1:3] == e[1:3] and f[3] != e[3] and f[5] < e[5] and f[6] is None and e[6] is None and len(words(e[4]) & words(f[4])) >= 2 and bool(words(e[4]) & set(NEGATIONS)) != bool(words(f[4]) & set(NEGATIONS))]
        for f in sorted(fit, key=lambda f: (-f[5].timestamp(), f[0]))[:most]:
            closed[f[0]] = min(closed.get(f[0], e[5]), e[5])
    return sorted((e[0], e[6] or closed.get(e[0])) for e in edges)


@pytest.mark.parametrize("seed", range(3))
def test_contradictions_by_shared_words(spark, seed):
    draw = np.random.default_rng(seed)
    vocabulary = ["not", "never", "the", "server", "runs", "cache", "on", "fast"]
    edges = []
    for i in range(150):
        fact = " ".join(vocabulary[j] for j in draw.integers(0, 8, draw.integers(0, 6)))
        edges.append((i, int(draw.integers(0, 3)), "SAYS" if draw.random() < 0.8 else "HAS", i + 1000, fact, DAY + dt.timedelta(int(draw.integers(0, 25))), DAY if draw.random() < 0.1 else None))
    df = keep(spark.createDataFrame(edges, "edge_id long, src_id long, type string, dst_id long, fact string, valid_at timestamp, invalid_at timestamp"))
    got = sorted((r["edge_id"], r["invalid_at"]) for r in graph.invalidate_contradictions(df).collect())
    assert got == plain_contradictions(edges)
    assert not any(a == b for a, b in itertools.pairwise(got))


def test_golds_meet_without_comparing_all(spark):
    """Questions of any number of words find the documents that hold them; none takes a nested loop."""
    plan = queries.golds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


ODD = [(1, "beta Alpha beta-x this Beta alpha\nalpha gamma"), (2, None), (3, ""), (4, "delta\nDELTA alpha"), (4, "beta alpha\ngamma\ngamma"), (None, "alpha \u212aelvin"), (None, "alpha")]


def test_leading_terms_are_counted_where_a_text_lies(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): (r["times"], r["pos"], r["rank"]) for r in governance.leading_terms(docs, 2).collect()}
    assert got == {(1, "alpha"): (3, 1, 1), (1, "beta"): (2, 0, 2), (4, "delta"): (2, 0, 1), (4, "alpha"): (2, 1, 2), (None, "alpha"): (2, 0, 1), (None, "elvin"): (1, 1, 2)}
    assert exchanges(governance.leading_terms(docs.where("doc_id < 4"))) == 0


def test_distinctiveness_deals_leading_terms_alone(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    new, stored = docs.where("doc_id = 1"), docs.where("doc_id = 4")
    told = governance.distinctiveness(new, stored)
    assert exchanges(told) <= 3
    assert [(r["doc_id"], round(r["distinctiveness"], 6)) for r in told.collect()] == [(1, 0.25)]  # beta-x alone


def test_distinctiveness_sorts_neither_side(spark):
    """A task holds different stored terms and counts, not the leading terms that meet them."""
    docs = spark.createDataFrame([*ODD, (5, "gamma gamma epsilon alpha"), (6, None), (7, "the of")], "doc_id long, text string")
    told = governance.distinctiveness(docs.where("doc_id in (1, 5, 6, 7)"), docs.where("doc_id is null or doc_id = 4"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
    assert {r["doc_id"]: round(r["distinctiveness"], 6) for r in told.collect()} == {1: 0.25, 5: 0.333333}


def test_grep_counts_lines_where_a_file_lies(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    asked = spark.createDataFrame([("a", "alpha beta"), ("g", "gamma"), ("n", "nothing here"), ("a", "alpha delta")], "query_id string, question string")
    got = lambda df: sorted(((r["query_id"], r["doc_id"], r["n_lines"], r["rank"]) for r in df.collect()), key=str)
    plain = got(search.top(search.files_by_joins(asked.selectExpr("query_id", "explode(split(question, ' ')) as term"), docs), "query_id", [F.desc("n_lines"), "doc_id"], 2))
    assert got(search.grep_files(asked, docs, most=2)) == plain
    assert plain == sorted([("a", 1, 2, 1), ("a", 4, 2, 2), ("g", 4, 2, 1), ("g", 1, 1, 2)], key=str)
    assert exchanges(search.grep_files(asked, docs.where("doc_id < 4"))) == 1
    by, k = {"alpha": [0], "beta": [0, 1]}, 1
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": ["alpha\nbeta"] * 9})
    told = [{q: b[0] for q, b in held.items()} for held in search.told_files([batch], by, k, most=1)]
    assert {0: (-2, True, 0), 1: (-1, True, 0)} in told  # told early, where more than one is held
