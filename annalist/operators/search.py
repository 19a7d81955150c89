"""Search over nodes, edge facts and passages: filters, legs, boosts, and the searches composed of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from annalist.functions.scores import as_of
from annalist.functions.text import tokens
from annalist.operators.classes import ranked_by_words
from annalist.operators.lexical import WORD
from annalist.operators.retrieve import BROADCAST_BYTES, bytes_of, cap_per_doc, rrf, terms_of_queries, top, vector_topk
from annalist.sources.shared import keep, told_once

#: Files that a task holds for all questions of ``grep_files``.
HELD = 500_000
# Statuses that a search, and that a merge, leaves out.
NOT_SEARCHED = ("superseded", "ended")
NOT_MERGED = ("ended", "retracted", "expired")


def live(nodes: DataFrame, at: Column, hidden: tuple[str, ...] = NOT_SEARCHED) -> DataFrame:
    """Rows that have not expired at the instant and whose status is none of ``hidden``."""
    return nodes.where((F.col("expires_at").isNull() | (F.col("expires_at") > at)) & ~F.col("status").isin(*hidden))


def in_workspace(nodes: DataFrame, edges: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a workspace, and the edges that keep an end there."""
    kept = nodes.where(F.col("workspace") == workspace)
    ends = kept.select("node_id")
    touched = edges.join(ends.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").unionByName(edges.join(ends.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi"))
    return kept, touched.distinct()


def node_vectors(queries: DataFrame, nodes: DataFrame, at: Column, types: tuple[str, ...] | None = None, k: int = 30) -> DataFrame:
    """As R2, over live nodes of the given types: filtered first, so that nothing is missed."""
    kept = live(nodes, at)
    kept = kept if types is None else kept.where(F.col("type").isin(*types))
    return vector_topk(queries, kept.select(F.col("node_id").alias("vec_id"), "embedding"), k).withColumnRenamed("vec_id", "node_id")


def edge_vectors(queries: DataFrame, edges: DataFrame, at: Column, k: int = 30) -> DataFrame:
    """As R2, over the facts of edges that hold at the instant."""
    held = edges.where(as_of(F.col("valid_at"), F.col("invalid_at"), at))
    return vector_topk(queries, held.select(F.col("edge_id").alias("vec_id"), "embedding"), k).withColumnRenamed("vec_id", "edge_id")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def node_lexical(queries: DataFrame, nodes: DataFrame, k: int = 30) -> DataFrame:
    """Share of the question's words that a node has, and half a point more where
    its key begins with the question or its name holds it; met through words they share."""
    asked = queries.select("query_id", F.lower(F.trim("question")).alias("_q"), words_of(F.col("question")).alias("_words"))
    hay = nodes.select(F.col("node_id").alias("_id"), F.lower("name").alias("_name"), F.lower("key").alias("_key"), words_of(F.concat_ws(" ", "name", "summary", "key")).alias("_words"))
    exact = F.col("_key").startswith(F.col("_q")) | F.contains(F.col("_name"), F.col("_q"))
    score = F.round(F.col("_both") / F.col("_n_words") + F.when(exact, 0.5).otherwise(0.0), 6)
    return ranked_by_words(asked, hay, k, ["_q"], ["_name", "_key"], told={"score": score}, order=[F.desc("score")]).withColumnRenamed("_id", "node_id")


def speaker_boost(hits: DataFrame, factor: float = 1.3) -> DataFrame:
    """Times ``factor`` where the passage has a turn of the speaker (``speaker``) that the question is about."""
    said = F.when(F.col("speaker") == "assistant", F.col("content").rlike(r"(?im)^\s*(assistant|ai|bot)\s*:")).otherwise(F.col("content").rlike(r"(?im)^\s*(user|human)\s*:"))
    return hits.withColumn("score", F.when(said, F.col("score") * factor).otherwise(F.col("score")))


def caller_anchors(callers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller_id, node_id): a caller's user node and the agents activated for them."""
    wanted = callers.select("caller_id", F.explode(F.concat(F.array(F.concat(F.lit("User:"), F.col("caller_id").cast("string"))), F.transform("agent_ids", lambda a: F.concat(F.lit("Agent:"), a.cast("string"))))).alias("key"))
    return wanted.join(nodes.select("node_id", "key"), "key").select("caller_id", "node_id")


def ranked(df: DataFrame) -> DataFrame:
    return top(df.drop("rank"), "query_id", [F.desc("score"), "node_id"], 1 << 30)


def derived_search(legs: DataFrame, nodes: DataFrame, distances: DataFrame, at: Column, limit: int = 10) -> DataFrame:
    """Node legs fused (R10), live nodes only (P8), nearer ones first (R12), best ``limit`` of each question."""
    fused = rrf(legs, {"vector": 1.0, "lexical": 1.0}, ["node_id"]).join(live(nodes, at).select("node_id"), "node_id", "left_semi")
    near = fused.join(distances.select("query_id", "node_id", "hops"), ["query_id", "node_id"], "left")
    boosted = near.withColumn("score", F.round(F.col("score") * F.coalesce(1 + 0.5 / (1 + F.col("hops")), F.lit(1.0)), 9)).drop("hops")
    return ranked(boosted).where(F.col("rank") <= limit)


def direct_search(legs: DataFrame, chunks: DataFrame, most: int = 2, limit: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Passage legs fused (R10), the asked speaker's passages boosted (R13), few of a document.

    ``legs``: query_id, speaker, doc_id, ordinal, leg, rank; ``weights`` of 0 switch a leg off.
    """
    weights = weights or {"vector": 1.0, "lexical": 1.0, "title": 0.7}
    off = [k for k, w in weights.items() if not w]
    fused = rrf(legs.where(~F.col("leg").isin(*off)) if off else legs, weights, ["doc_id", "ordinal", "speaker"])
    boosted = speaker_boost(fused.join(chunks.select("doc_id", "ordinal", "content"), ["doc_id", "ordinal"])).drop("content")
    return cap_per_doc(boosted.withColumn("score", F.round("score", 9)), most, limit)


def across_tiers(nodes: DataFrame, passages: DataFrame, limit: int = 20) -> DataFrame:
    """One list of both tiers, each by its own rank: (query_id, tier, item, score, rank)."""
    both = nodes.select("query_id", F.lit("node").alias("leg"), F.concat(F.lit("node:"), "node_id").alias("node_id"), "rank").unionByName(
        passages.select("query_id", F.lit("passage").alias("leg"), F.concat_ws(":", F.lit("passage"), "doc_id", "ordinal").alias("node_id"), "rank")
    )
    return ranked(rrf(both, {}, ["node_id"])).where(F.col("rank") <= limit).withColumnRenamed("node_id", "item")


def explain(hits: DataFrame, merged: DataFrame) -> DataFrame:
    """Per question the hits of each scope, how many were merged, and how many lie hidden behind a narrower scope."""
    per = hits.groupBy("query_id").pivot("scope", ["global", "org", "team", "user"]).agg(F.count(F.lit(1))).fillna(0)
    total = hits.groupBy("query_id").agg(F.count("*").alias("candidates")).join(merged.groupBy("query_id").agg(F.count("*").alias("merged")), "query_id", "left").fillna(0)
    return per.join(total.withColumn("shadowed", F.col("candidates") - F.col("merged")), "query_id")


def topic_routing(queries: DataFrame, topics: DataFrame, keys: DataFrame, most: int = 5) -> DataFrame:
    """Topics by the question's words in their name and in the keys they hold, half a point more for states."""
    words = topics.select("topic", F.explode(words_of(F.concat_ws(" ", "topic", "kind", "workspace"))).alias("word")).unionByName(keys.select("topic", F.explode(words_of(F.col("key"))).alias("word"))).distinct()
    asked = queries.select("query_id", F.explode(words_of(F.col("question"))).alias("word"))
    met = words.join(asked, "word").groupBy("query_id", "topic").agg(F.count("*").alias("overlap")).join(topics.select("topic", "kind"), "topic")
    scored = met.withColumn("score", F.col("overlap") + F.when(F.col("kind") == "state", 0.5).otherwise(0.0))
    return top(scored.select("query_id", "topic", "score"), "query_id", [F.desc("score"), "topic"], most)


def grep_files(queries: DataFrame, docs: DataFrame, terms: int = 4, most: int = 10) -> DataFrame:
    """Files by the number of their lines that hold one of a question's first terms, as whole words.

    Lines are counted where they lie and a task tells the best of each question,
    if the asked terms are few bytes; otherwise, and for ids told in several
    rows, all matches are joined and counted.
    """
    asked = keep(queries.select("query_id", F.explode(F.array_distinct(F.slice(F.transform(F.regexp_extract_all("question", F.lit(WORD.pattern), 0), F.lower), 1, terms))).alias("term")).distinct())
    if bytes_of(asked, ["term"]) > BROADCAST_BYTES:
        return top(files_by_joins(asked, docs), "query_id", [F.desc("n_lines"), "doc_id"], most)
    once, several = told_once(docs.select("doc_id", "text"), "doc_id")
    found = best_files(asked, once, most)
    found = found if several is None else found.unionByName(files_by_joins(asked, several))
    return top(found, "query_id", [F.desc("n_lines"), "doc_id"], most)


def files_by_joins(asked: DataFrame, docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body")).select("doc_id", "line", F.explode(tokens(F.col("body"))).alias("term"))
    return lines.join(asked, "term").groupBy("query_id", "doc_id").agg(F.countDistinct("line").alias("n_lines"))


def best_files(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, n_lines: of each task the best ``k`` for each question; ``asked`` is small enough to be sent to every task."""
    rows = asked.collect()
    queries = list(dict.fromkeys(r["query_id"] for r in rows))
    slot, by = {q: i for i, q in enumerate(queries)}, {}
    for r in rows:
        by.setdefault(r["term"], []).append(slot[r["query_id"]])
    kinds = [(c, df.schema[c].dataType) for c, df in (("query_id", asked), ("doc_id", docs))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in told_files(batches, by, k):
            named = [(queries[q], doc, n) for q, best in held.items() for n, _, doc in best]
            arrays = [pa.array([x[i] for x in named], to_arrow_type(kind)) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([-x[2] for x in named], pa.int64())], ["query_id", "doc_id", "n_lines"])

    return docs.mapInArrow(each, ", ".join(f"{c} {kind.simpleString()}" for c, kind in kinds) + ", n_lines long")


def told_files(batches: Iterator[pa.RecordBatch], by: dict[str, list[int]], k: int, most: int = HELD) -> Iterator[dict[int, list[tuple]]]:
    """For each question the best (minus lines, doc_id is told, doc_id); told early where more than ``most`` are held."""
    held: dict[int, list[tuple]] = {}
    n = 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            lines = Counter(frozenset(by.keys() & {w.lower() for w in WORD.findall(line)}) for line in (text.as_py() or "").split("\n"))
            counts: Counter[int] = Counter()
            for met, times in lines.items():
                for q in {q for t in met for q in by[t]}:
                    counts[q] += times
            doc = doc.as_py()
            for q, c in counts.items():
                best = held.setdefault(q, [])
                best.append((-c, doc is not None, doc))
                n += 1
                if len(best) >= 2 * k:
                    n -= len(best)
                    best.sort()
                    del best[k:]
                    n += len(best)
            if n > most:
                yield held
                held, n = {}, 0
    yield {q: sorted(best)[:k] for q, best in held.items()}


def leading_value(queries: DataFrame, facts: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """K5: the current value whose anchor shares most words with the question: one for keyed anchors, two for free ones."""
    words = facts.select(F.col("fact_id").alias("_id"), "rank", "keyed", F.array_distinct(F.filter(F.split(F.lower("anchor"), r"[/:=\s\-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))).alias("_words"))
    asked = queries.select("query_id", F.array_distinct(F.filter(F.split(F.lower("question"), r"[/:=\s\-]+"), lambda w: F.length(w) >= 3)).alias("_words"))
    enough = F.col("_both") >= F.when(F.col("keyed"), 1).otherwise(2)
    told = {"overlap": F.col("_both"), "rank": F.col("rank")}
    best = ranked_by_words(asked, words, 1, traits=["rank", "keyed"], enough=enough, told=told, order=[F.desc("overlap"), F.asc("rank")], rank="_n")
    return best.select("query_id", F.col("_id").alias("fact_id"), "overlap")


def predates(passages: DataFrame, values: DataFrame) -> DataFrame:
    """K6: passages with a flag: dated before the current value began?"""
    return passages.join(values.select("query_id", "since"), "query_id", "left").withColumn("predates", F.coalesce(F.col("valid_at") < F.col("since"), F.lit(False))).drop("since")


def answer_again(queries: DataFrame, hits: DataFrame, items: DataFrame, search) -> DataFrame:
    """The hits, and for questions without any those of one more ``search`` over the items that fit them."""
    missed = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    asked = terms_of_queries(missed).select("query_id", "term")
    admitted = items.join(items.select("doc_id", F.explode(tokens(F.concat_ws(" ", "title", "path"))).alias("term")).join(asked, "term").select("doc_id").distinct(), "doc_id", "left_semi")
    return hits.unionByName(search(missed, admitted))


def focused(hits: DataFrame, queries: DataFrame, factor: float = 1.4) -> DataFrame:
    """Hits of questions that have an active workspace: bound to it (mode filter), or its own times ``factor`` (mode boost)."""
    met = hits.join(queries.select("query_id", F.col("workspace").alias("_active"), F.col("workspace_mode").alias("_mode")), "query_id")
    same = F.coalesce(F.col("workspace") == F.col("_active"), F.lit(False))
    kept = met.where(F.col("_active").isNull() | (F.col("_mode") != "filter") | same)
    return kept.withColumn("score", F.round(F.when(same & (F.col("_mode") != "filter"), F.col("score") * factor).otherwise(F.col("score")), 9)).drop("_active", "_mode")


def of_kind(kind: Column) -> Column:
    """P13's test for a question's own kind: null takes all; states, preferences and records are metrics by key; any other kind is a fact."""
    prefix = F.when(kind == "state", "state:").when(kind == "preference", "pref:").when(kind == "record", "record:")
    return kind.isNull() | F.when(prefix.isNull(), F.col("type") == "Fact").otherwise((F.col("type") == "Metric") & F.col("key").startswith(prefix))


def search_all(queries: DataFrame, nodes: DataFrame, passages: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What a search gives with all its switches together, each question with its own.

    ``queries``: query_id, origin (direct, derived or null for both), kind,
    workspace, workspace_mode (boost, filter), depth (0 to 3), limit, per_document.
    ``nodes``: fused hits with type, key, workspace; ``passages``: fused hits with
    doc_id, ordinal, workspace; ``edges``: edge_id, src_id, dst_id, those that hold.
    Gives nodes, passages, the edges around the nodes as far as ``depth`` goes,
    and one list of both tiers.
    """
    from annalist.operators.graph import hops

    asked = lambda tier: queries.where(F.col("origin").isNull() | (F.col("origin") == tier))
    cut = lambda df, order: top(df, "query_id", order, 1 << 30).where(F.col("rank") <= F.col("_limit")).drop("_limit")
    derived = focused(nodes.join(asked("derived").select("query_id", F.col("kind").alias("_kind"), F.col("limit").alias("_limit")), "query_id").where(of_kind(F.col("_kind"))).drop("_kind"), queries)
    found = keep(cut(derived, [F.desc("score"), "node_id"]))
    direct = focused(passages.join(asked("direct").select("query_id", F.col("limit").alias("_limit"), F.col("per_document").alias("_per")), "query_id"), queries)
    own = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "ordinal")
    read = keep(cut(direct.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= F.col("_per")).drop("_n", "_per"), [F.desc("score"), "doc_id", "ordinal"]))
    deep = queries.where("depth > 0").select("query_id", "depth")
    near = hops(found.join(deep, "query_id").select("query_id", "node_id"), edges, 2).join(deep, "query_id").where("hops < depth")
    ends = near.select("query_id", "node_id").distinct()
    touched = edges.select("edge_id", F.explode(F.array("src_id", "dst_id")).alias("node_id")).join(ends, "node_id").select("query_id", "edge_id").distinct()
    both = across_tiers(found, read, 1 << 30).join(queries.select("query_id", F.col("limit").alias("_limit")), "query_id").where(F.col("rank") <= F.col("_limit")).drop("_limit")
    return {"nodes": found, "passages": read, "edges": touched, "fused": both}
