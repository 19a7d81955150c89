"""R2: nearest vectors for a table of questions, exactly or through an index of lists.

Rows lie in buckets of a bounded size and questions are dealt to buckets; a
task holds one bucket's rows and lets its questions stream past, so neither
table goes through the driver or is broadcast.  Exactly: every question to
every bucket.  By the index: a bucket is (a part of) the list of a centroid, and
a question goes to the lists of the centroids nearest to it.  The scores of
whatever is looked at are exact; only the choice of lists can miss a neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.sources.shared import keep

#: Rows of a bucket on average; questions and rows that are compared at once.
BUCKET, ROWS, QUERIES = 131_072, 8_192, 512
#: Rows that centroids are fitted on, at most.
SAMPLE = 20_000
#: Share of the lists that a question goes to, where no number is named.  On vectors without clusters
#: half of them hold 0.84 of the true neighbours; clustered ones need far fewer.
SHARE = 0.7
FOUND = "query_id bigint, vec_id bigint, score double"


def stacked(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of a matrix, from their buffer; nulls in them are 0, short ones are filled up."""
    n = np.diff(np.asarray(vectors.offsets)).astype(np.int64)
    n[~np.asarray(vectors.is_valid())] = 0
    values = np.asarray(vectors.flatten().fill_null(0.0), np.float64)
    width = int(n.max(initial=0)) if width is None else width
    if (n == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))))
    owner = np.repeat(np.arange(len(n)), n)
    out[owner, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out[:, :width]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """To six places, over the common components; 0 where a vector has no length."""
    width = min(a.shape[1], b.shape[1])
    scale = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.where(scale > 0, a[:, :width] @ b[:, :width].T / np.where(scale > 0, scale, 1), 0.0).round(6)


def best_rows(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k of each slot: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, slot))
    slots = slot[order]
    at = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, int)
    return order[np.arange(len(slots)) - np.repeat(at, np.diff(np.append(at, len(slots)))) < k]


def answer(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``FOUND`` rows, k for each question and bucket, of rows (bucket, asks, id, embedding) that come by bucket, questions last."""
    bucket, held, ids, rows = None, [], None, None
    for batch in batches:
        keys, asks = (np.asarray(batch.column(c)) for c in ("bucket", "asks"))
        edge = (np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist()
        for s, e in zip([0, *edge], [*edge, batch.num_rows], strict=True):
            if s == e:
                continue
            part = batch.slice(s, e - s)
            if keys[s] != bucket:
                bucket, held, rows = keys[s], [], None
            if not asks[s]:
                held.append(part)
                continue
            if not held:
                continue
            if rows is None:
                whole = pa.Table.from_batches(held).combine_chunks()
                ids, rows = whole.column("id").to_numpy(), stacked(whole.column("embedding").chunk(0))
            for at in range(0, part.num_rows, QUERIES):
                chunk = part.slice(at, QUERIES)
                asked = stacked(chunk.column("embedding"))
                slot, score, found = np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)
                for r in range(0, len(ids), ROWS):
                    scores = cosines(asked, rows[r : r + ROWS])
                    if scores.shape[1] > k:  # the k-th best of a question, ties with it stay
                        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                        i, j = np.nonzero(scores >= least[:, None])
                    else:
                        i, j = (x.ravel() for x in np.indices(scores.shape))
                    slot, score, found = np.concatenate([slot, i]), np.concatenate([score, scores[i, j]]), np.concatenate([found, ids[r + j]])
                    top = best_rows(slot, score, found, k)
                    slot, score, found = slot[top], score[top], found[top]
                yield pa.record_batch([chunk.column("id").take(pa.array(slot)), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])


def asked_in(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each question over its buckets; both tables are (bucket, id, embedding)."""
    both = rows.select("bucket", F.lit(False).alias("asks"), "id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(
        queries.select("bucket", F.lit(True).alias("asks"), "id", F.col("embedding").cast("array<double>").alias("embedding"))
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(n, "bucket").sortWithinPartitions("bucket", "asks").mapInArrow(lambda b: answer(b, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int = 30) -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors of the greatest cosine; null embeddings take no part."""
    rows = vectors.where(F.col("embedding").isNotNull())
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(buckets)).alias("bucket"), F.col("vec_id").cast("long").alias("id"), "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), F.col("query_id").cast("long").alias("id"), "embedding")
    return asked_in(dealt, asked, k)


def fit_centroids(vectors: DataFrame, lists: int, rounds: int = 12, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by spherical k-means over at most ``sample`` vectors, those of the least hash."""
    rows = vectors.select("embedding").where(F.size("embedding") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("embedding").combine_chunks()
    x = stacked(rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((1, 1))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[np.random.default_rng(0).permutation(len(x))[:lists]]
    for _ in range(rounds):
        nearest = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centre)
    return centre


@dataclass
class ListIndex:
    """``rows``: (bucket, list, id, embedding), every vector in the list of its nearest centroid; ``parts``: buckets of each list."""

    centroids: np.ndarray
    rows: DataFrame
    parts: DataFrame


def nearest_lists(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Adds ``lists``: the ``probes`` nearest centroids, nearest first."""
    schema = df.schema.simpleString()[7:-1] + ",lists:array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = cosines(stacked(batch.column("embedding")), centroids)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * order.shape[1], pa.int32()), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "lists"])

    return df.mapInArrow(run, schema)


def build_index(vectors: DataFrame, lists: int | None = None, bucket: int = BUCKET) -> ListIndex:
    """Index every vector with an embedding; lists of more than ``bucket`` rows are cut into parts, by id."""
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    lists = lists or int(min(4096, max(4, rows.count() ** 0.5)))
    centroids = fit_centroids(rows, lists)
    placed = keep(nearest_lists(rows, centroids, 1).select(F.col("lists")[0].alias("list"), F.col("vec_id").alias("id"), "embedding"))
    parts = keep(placed.groupBy("list").agg(F.ceil(F.count("*") / bucket).alias("parts")))
    named = placed.join(parts, "list").withColumn("bucket", F.xxhash64("list", F.pmod(F.xxhash64("id"), F.col("parts"))))
    return ListIndex(centroids, keep(named.select("bucket", "list", "id", "embedding")), parts)


def index_topk(queries: DataFrame, index: ListIndex, k: int = 30, probes: int | None = None) -> DataFrame:
    """As ``exact_topk``, over the ``probes`` lists nearest to a question (``SHARE`` of all, if no number is named)."""
    probes = probes or max(1, math.ceil(SHARE * len(index.centroids)))
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    each = nearest_lists(asked, index.centroids, probes).select("id", "embedding", F.explode("lists").alias("list")).join(index.parts, "list")
    dealt = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).withColumn("bucket", F.xxhash64("list", "part"))
    return asked_in(index.rows, dealt, k)
