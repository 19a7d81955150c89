"""Hard negatives by segment summaries.

A vector is cut into segments, and of each its mean and its deviation are
stored.  The scalar product of two segments of n components is n times the
product of their means plus what their deviations add, which is between minus
and plus n times the product of the deviations.  Summed over all segments that
bounds the score of two vectors; finer segments bound it closer.  Scores are
refined level by level, from a few long segments to many short ones, and only
the pairs that the last bounds leave open are multiplied out.

Anchors are the queries, and they are asked of all rows in blocks: every row
goes to one bucket of at most about ``BUCKET`` rows, every anchor to all
buckets.  A task holds its bucket's rows and lets anchors stream past.  First
each bucket gives an anchor's best rows of its own label, as many as it may
have positives; of all buckets' the best are the positives.  They settle the
bands in which negatives may lie, and in a second pass each bucket gives the
best rows within each band.  Anchors are never sent to the driver or broadcast.

Nulls and oddities: rows with a null label or vector, or with a component that
is null or not finite, take no part.  A null id is no multiple of anything and
comes last among ties.  Each row stands for itself; rows of an anchor's own id
are not its partners.  Vectors of different lengths are multiplied over their
common components, an empty one scores 0.  Scores are whole numbers, exact up
to 2**56; an anchor without positives, or a positive without negatives, gives no
row.  Columns other than those named play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import materialise, shuffle_partitions

SCALE = 256
#: Ids of anchors; ids whose label moves on, and labels there are.
ANCHORS, MOVED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Hundredths of the positive's score between which a negative's lies.
LEAST, MOST = 50, 95
#: Rows of a bucket on average; rows and anchors that are compared at once.
BUCKET, ROWS, QUERIES = 131_072, 2_048, 512
#: Segments of a vector, level by level.
SEGMENTS = (4, 16)
#: Pairs that are gathered at once.
PAIRS = 1 << 16
#: Share of open pairs from which all are multiplied out.
DENSE = 0.05

MATCH = "anchor long, slot int, vec_id long, score long"
BANDS = "array<struct<least:bigint,most:bigint>>"


def items(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec): the rows that take part, components as whole numbers."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    kept = F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))
    return embeddings.where(kept).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vec"))


class Vectors:
    """Rows of one batch or bucket: ids, labels, components, and summaries of their segments at each level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels, self.values = ids, labels, values
        self.most = int(np.abs(values).max(initial=0))
        self.levels = [self.summary(min(s, max(1, values.shape[1]))) for s in SEGMENTS]

    def summary(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations, each times the root of its segment's length."""
        edges = np.linspace(0, self.values.shape[1], segments + 1).astype(int)
        if self.values.shape[1] == 0:
            return np.zeros((len(self.ids), 1)), np.zeros((len(self.ids), 1))
        n, x = np.diff(edges), self.values.astype(np.float64)
        means = np.add.reduceat(x, edges[:-1], axis=1) / n
        off = np.add.reduceat((x - np.repeat(means, n, axis=1)) ** 2, edges[:-1], axis=1)
        return means * np.sqrt(n), np.sqrt(off)

    def part(self, at: slice) -> "Vectors":
        out = object.__new__(Vectors)
        out.ids, out.labels, out.values, out.most = self.ids[at], self.labels[at], self.values[at], self.most
        out.levels = [(m[at], d[at]) for m, d in self.levels]
        return out


def stacked(columns: list[pa.Array], width: int) -> np.ndarray:
    """Lists of numbers as rows of one matrix, filled up with zeros."""
    rows = sum(map(len, columns))
    out, at = np.zeros((rows, width), np.int64), 0
    for c in columns:
        n = np.asarray(pc.list_value_length(c)).astype(np.int64)
        owner = np.repeat(np.arange(len(c)) + at, n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        out[owner, place] = np.asarray(c.flatten())
        at += len(c)
    return out


def bounds(q: Vectors, x: Vectors, level: int, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that scores can be: of all pairs as matrices, or of the given pairs."""
    (qm, qd), (xm, xd) = q.levels[level], x.levels[level]
    if pairs is None:
        centre, spread = qm @ xm.T, qd @ xd.T
    else:
        centre = np.einsum("ij,ij->i", qm[pairs[0]], xm[pairs[1]])
        spread = np.einsum("ij,ij->i", qd[pairs[0]], xd[pairs[1]])
    spread = spread + 1e-9 * (np.abs(centre) + spread) + 1e-6
    return centre - spread, centre + spread


def exact(q: Vectors, x: Vectors, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the pairs (a, b) as whole numbers."""
    safe = q.most * x.most * max(1, q.values.shape[1]) < 1 << 53
    kind = np.float64 if safe else np.int64
    if len(a) > DENSE * len(q.ids) * len(x.ids):
        return (q.values.astype(kind) @ x.values.astype(kind).T)[a, b].astype(np.int64)
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = np.einsum("ij,ij->i", q.values[a[part]].astype(kind), x.values[b[part]].astype(kind)).astype(np.int64)
    return out


def open_pairs(q: Vectors, x: Vectors, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, score) of all allowed pairs whose score is within the anchor's least and most."""
    lower, upper = bounds(q, x, 0)
    a, b = np.nonzero(allowed & (upper >= least[:, None]) & (lower <= most[:, None]))
    for level in range(1, len(SEGMENTS)):
        left = [np.zeros(0, bool)]
        for at in range(0, len(a), PAIRS):
            i, k = a[at : at + PAIRS], b[at : at + PAIRS]
            lower, upper = bounds(q, x, level, (i, k))
            left.append((upper >= least[i]) & (lower <= most[i]))
        a, b = a[np.concatenate(left)], b[np.concatenate(left)]
    scores = exact(q, x, a, b)
    within = (scores >= least[a]) & (scores <= most[a])
    return a[within], b[within], scores[within]


def first_of_each(slot: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k rows of each slot: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, slot))
    slots = slot[order]
    start = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, int)
    rank = np.arange(len(slots)) - np.repeat(start, np.diff(np.append(start, len(slots))))
    return order[rank < k]


#: Stands for a null id, which comes last.
NO_ID = np.iinfo(np.int64).max


def best_of_own_label(q: Vectors, x: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, slot 0, id, score) of each anchor's best ``POSITIVES`` rows of its label; what is found raises the bar for the rows that follow."""
    low = np.full(len(q.ids), np.iinfo(np.int64).min)
    high = np.full(len(q.ids), np.iinfo(np.int64).max)
    a, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(x.ids), ROWS):
        p = x.part(slice(at, at + ROWS))
        allowed = (q.labels[:, None] == p.labels[None, :]) & (q.ids[:, None] != p.ids[None, :])
        i, k, s = open_pairs(q, p, allowed, low, high)
        a, ids, scores = np.concatenate([a, i]), np.concatenate([ids, p.ids[k]]), np.concatenate([scores, s])
        keep = first_of_each(a, scores, ids, POSITIVES)
        a, ids, scores = a[keep], ids[keep], scores[keep]
        full = np.bincount(a, minlength=len(low)) >= POSITIVES
        worst = np.full(len(low), np.iinfo(np.int64).max)
        np.minimum.at(worst, a, scores)
        low[full] = worst[full]
    return a, np.zeros(len(a), np.int64), ids, scores


def best_in_bands(q: Vectors, x: Vectors, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, slot, id, score) of the best ``NEGATIVES`` rows of other labels in each of an anchor's bands (a band without room is none)."""
    room = lows <= highs
    least = np.where(room, lows, np.iinfo(np.int64).max).min(axis=1)
    most = np.where(room, highs, np.iinfo(np.int64).min).max(axis=1)
    slots = lows.shape[1]
    key, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(x.ids), ROWS):
        p = x.part(slice(at, at + ROWS))
        allowed = (q.labels[:, None] != p.labels[None, :]) & (q.ids[:, None] != p.ids[None, :])
        i, k, s = open_pairs(q, p, allowed, least, most)
        for slot in range(slots):
            into = (s >= lows[i, slot]) & (s <= highs[i, slot])
            key, ids, scores = np.concatenate([key, i[into] * slots + slot]), np.concatenate([ids, p.ids[k[into]]]), np.concatenate([scores, s[into]])
        keep = first_of_each(key, scores, ids, NEGATIVES)
        key, ids, scores = key[keep], ids[keep], scores[keep]
    return key // slots, key % slots, ids, scores


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``MATCH`` rows of batches (bucket, query, anchor, vec_id, label, vec, positives) that come by bucket, rows before queries."""
    bucket, rows, held = None, [], None
    for batch in batches:
        keys, query = (np.asarray(batch.column(k)) for k in (0, 1))
        edge = np.flatnonzero((keys[1:] != keys[:-1]) | (query[1:] != query[:-1])) + 1
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            if s == e:
                continue
            part = batch.slice(s, e - s)
            if keys[s] != bucket:
                bucket, rows, held = keys[s], [], None
            if not query[s]:
                rows.append(part)
                continue
            width = int(max(pc.max(pc.list_value_length(p.column("vec"))).as_py() or 0 for p in [*rows, part]))
            if rows and (held is None or held.values.shape[1] < width):
                held = vectors(rows, width)
            if held is None:
                continue
            for at in range(0, part.num_rows, QUERIES):
                chunk = part.slice(at, QUERIES)
                q = vectors([chunk], held.values.shape[1])
                bands = chunk.column("bands")
                if bands.null_count == len(bands):
                    a, slot, ids, scores = best_of_own_label(q, held)
                else:
                    lows, highs = (band_edges(bands, k) for k in ("least", "most"))
                    a, slot, ids, scores = best_in_bands(q, held, lows, highs)
                anchor = np.asarray(chunk.column("anchor"))[a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(slot.astype(np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["anchor", "slot", "vec_id", "score"]
                )


def vectors(parts: list[pa.RecordBatch], width: int) -> Vectors:
    ids = np.concatenate([np.asarray(p.column("vec_id").fill_null(NO_ID)) for p in parts])
    labels = np.concatenate([np.asarray(p.column("label")) for p in parts])
    return Vectors(ids, labels, stacked([p.column("vec") for p in parts], width))


def band_edges(bands: pa.Array, field: str) -> np.ndarray:
    """A row of ``POSITIVES`` edges for each anchor; bands that it lacks have no room."""
    out = np.full((len(bands), POSITIVES), 1 if field == "least" else 0, np.int64)
    n = np.asarray(pc.list_value_length(bands))
    owner = np.repeat(np.arange(len(bands)), n)
    out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(bands.flatten().field(field))
    return out


def ask(rows: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """``MATCH`` rows: what each bucket gives for each of ``anchors`` (anchor, vec_id, label, vec, bands)."""
    bucket = F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = rows.select(bucket, F.lit(False).alias("query"), F.lit(None).cast("long").alias("anchor"), "vec_id", "label", "vec", F.lit(None).cast(BANDS).alias("bands"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    asked = anchors.select(everywhere, F.lit(True).alias("query"), "anchor", "vec_id", "label", "vec", "bands")
    both = dealt.unionByName(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", "query")
    return both.mapInArrow(answer, MATCH)


def best(matches: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return matches.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def floor_of(x: Column) -> Column:
    """x / 100 in whole numbers, downwards."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def mine(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``embeddings`` (vec_id, embedding, label)."""
    rows = materialise(items(embeddings).withColumn("row", F.monotonically_increasing_id()))
    buckets = max(shuffle_partitions(rows.sparkSession), -(-rows.count() // BUCKET))
    anchors = rows.where(F.col("vec_id") % ANCHORS == 0).select(F.col("row").alias("anchor"), "vec_id", "label", "vec")
    found = ask(rows, anchors.withColumn("bands", F.lit(None).cast(BANDS)), buckets)
    ranked = best(found, ["anchor"], POSITIVES, "place")
    positives = materialise(ranked.select("anchor", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score")
    # the least and the most whole number s with LEAST * p <= 100 * s <= MOST * p
    band = F.struct("slot", (-floor_of(-LEAST * p)).alias("least"), floor_of(MOST * p).alias("most"))
    bands = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(band)).alias("b")).select("anchor", F.transform("b", lambda x: F.struct(x["least"].alias("least"), x["most"].alias("most"))).alias("bands"))
    negatives = best(ask(rows, anchors.join(bands, "anchor"), buckets), ["anchor", "slot"], NEGATIVES, "rank")
    named = positives.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    told = negatives.join(named, ["anchor", "slot"])
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
