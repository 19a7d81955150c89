"""Retrieval for a table of questions: lexical, title and vector legs, fusion, caps, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.scores import rrf_weight
from annalist.functions.text import chunk_fixed, query_terms, tokens
from annalist.operators.classes import ranked_by_words
from annalist.operators.lexical import best_passages
from annalist.operators.vectors import exact_topk
from annalist.sources.shared import keep

#: Bytes of asked terms up to which they are sent to every task.
BROADCAST_BYTES = 16_000_000


def chunks_of(docs: DataFrame, size: int = 1000) -> DataFrame:
    """doc_id, ordinal, content of the passages of each text (the fixed cut)."""
    return docs.select("doc_id", F.posexplode(chunk_fixed(F.coalesce("text", F.lit("")), size)).alias("ordinal", "content"))


def inverted_index(chunks: DataFrame) -> DataFrame:
    """R6's index: doc_id, ordinal, term, each term once for a passage."""
    return chunks.select("doc_id", "ordinal", F.explode(tokens(F.col("content"))).alias("term"))


def idf(index: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """Term, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); ``n_chunks`` has one row with N."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    n = n_chunks.scalar()
    return df.select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def terms_of_queries(queries: DataFrame) -> DataFrame:
    """query_id, term, times: repeated terms count as often as they are asked."""
    found = queries.select("query_id", F.explode(query_terms(F.col("question"))).alias("term"))
    return found.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def asked_words(queries: DataFrame) -> DataFrame:
    """query_id, _words: the terms of R5 as one list a question."""
    return terms_of_queries(queries).groupBy("query_id").agg(F.collect_set("term").alias("_words"))


def small(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, to be broadcast if its texts are known to be few bytes; otherwise joins shuffle it."""
    return F.broadcast(df) if bytes_of(df, columns) <= BROADCAST_BYTES else df


def bytes_of(df: DataFrame, columns: list[str]) -> int:
    """Bytes of the texts, and 32 a row."""
    size = F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(32)))
    return df.agg(size).first()[0] or 0


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int = 60) -> DataFrame:
    """query_id, doc_id, ordinal, score, rank: the sum of idf over question terms present.

    Passages are scored where they lie and a task tells the best of each question,
    if the asked terms are few bytes; otherwise all matches are joined and added up.
    """
    asked = keep(terms_of_queries(queries))
    best = best_passages(asked, chunks, k) if bytes_of(asked, ["term"]) <= BROADCAST_BYTES else scored_by_joins(asked, chunks)
    return top(best, "query_id", [F.desc("score"), "doc_id", "ordinal"], k)


def scored_by_joins(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every match of R7 for any number of questions; the index is cut to the asked terms as it is made, and written once."""
    terms = small(keep(asked.select("term").distinct()), ["term"])
    index = keep(inverted_index(chunks).join(terms, "term"))
    weights = idf(index, chunks.agg(F.count("*")))
    hits = index.join(asked.join(weights.select("term", "idf"), "term"), "term")
    return hits.groupBy("query_id", "doc_id", "ordinal").agg(F.round(F.sum(F.col("times") * F.col("idf")), 6).alias("score"))


def top(df: DataFrame, key: str, order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= k)


def title_leg(queries: DataFrame, docs: DataFrame, most: int = 20) -> DataFrame:
    """Documents whose title holds a term of the question, the least ids first."""
    titles = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("title"))))).alias("_words"))
    return ranked_by_words(asked_words(queries), titles, most).withColumnRenamed("_id", "doc_id")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 30) -> DataFrame:
    """R2: query_id, vec_id, score, rank: exact cosine of each question with every vector."""
    return exact_topk(queries, vectors, k)


def rrf(legs: DataFrame, weights: dict[str, float], item: list[str], k: int = 60) -> DataFrame:
    """query_id, item, score: the sum of weight / (k + rank) over legs; ``legs`` has leg and rank."""
    weight = F.coalesce(*[F.when(F.col("leg") == name, w) for name, w in weights.items()], F.lit(1.0))
    return legs.groupBy("query_id", *item).agg(F.round(F.sum(rrf_weight(F.col("rank"), weight, k)), 9).alias("score"))


def cap_per_doc(ranked: DataFrame, most: int, limit: int) -> DataFrame:
    """At most ``most`` passages of a document, then the best ``limit`` of each question."""
    own = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "ordinal")
    kept = ranked.drop("rank").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).drop("_n")
    return top(kept, "query_id", [F.desc("score"), "doc_id", "ordinal"], limit)


def workspace_boost(hits: DataFrame, factor: float = 1.4) -> DataFrame:
    """Times ``factor`` where the hit's workspace is the question's."""
    same = F.col("workspace") == F.col("query_workspace")
    return hits.withColumn("score", F.when(same, F.col("score") * factor).otherwise(F.col("score")))


def distance_boost(hits: DataFrame, distances: DataFrame) -> DataFrame:
    """Times 1 + 0.5 / (1 + hops); unreachable is times 1."""
    met = hits.join(distances.select("query_id", "node_id", "hops"), ["query_id", "node_id"], "left")
    return met.withColumn("score", F.col("score") * F.coalesce(1 + 0.5 / (1 + F.col("hops")), F.lit(1.0))).drop("hops")


def merge_scopes(hits: DataFrame) -> DataFrame:
    """One hit for each (query, type, key): the narrowest scope's, with the best score and the scopes it hides."""
    narrow = F.struct("scope_rank", "score", "node_id")
    return hits.groupBy("query_id", "type", "key").agg(
        F.max_by("node_id", narrow).alias("node_id"), F.max_by("scope", narrow).alias("scope"), F.max("score").alias("score"),
        F.size(F.collect_set("scope")).alias("n_scopes"),
    )


def cold_candidates(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """Unadmitted items by the number of question terms in their title and path, newest first on ties."""
    words = items.where("status <> 'admitted'").select(F.col("item_id").alias("_id"), "modified_at", tokens(F.concat_ws(" ", "title", "path")).alias("_words"))
    told = {"modified_at": F.col("modified_at"), "overlap": F.col("_both")}
    return ranked_by_words(asked_words(queries), words, k, traits=["modified_at"], told=told, order=[F.desc("overlap"), F.desc("modified_at")]).withColumnRenamed("_id", "item_id")


def context_block(items: DataFrame, key: str, budget: int, size: str = "size", rank: str = "rank") -> DataFrame:
    """Items in rank order up to the first that overflows the budget; later ones stay out."""
    before = Window.partitionBy(key).orderBy(rank)
    return items.withColumn("running", F.sum(size).over(before)).where(F.col("running") <= budget)
