"""Statements that mean the same become one, found through an index of random hyperplanes.

Statements come in order of arrival.  One that is near an earlier representative
of its group (cosine of ``threshold`` or more) joins the nearest of these, the
earlier one among equals; any other is a representative itself.  Equal vectors
are one statement: it goes where it went the first time.

Candidates are those that share a bucket: the signs of a vector on some random
hyperplanes, in each of several tables.  Their number follows from the count of
vectors of a group (buckets stay small, but large enough that few tables do) and
from the share of near pairs that is to be met (``RECALL``, for pairs just at
the threshold).  No bucket is cut: one of more than ``LARGE`` rows is dealt out
in cells, which together compare each row with all others of its bucket.  A
group whose buckets hold more pairs than the group itself is one bucket.

Who is a representative depends on who came before, so it is settled in rounds,
in each for all that have no undecided earlier candidate nearby; those near one
of the new representatives are settled as well.  Every similarity is computed
exactly.  What a task tells is two flags a row, or one best representative,
never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.sources.shared import keep

THRESHOLD, RECALL = 0.86, 0.99
#: Vectors of a row's bucket on average, and the most rows of a bucket, or of a cell of one, that a task compares.
BUCKET, LARGE = 512, 50_000
#: Rows that are compared with as many at once.
BLOCK = 1024


def table_sizes(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(hyperplanes of a table, tables) for ``n`` vectors of a group."""
    planes = min(40, max(6, math.ceil(math.log2(max(n, 1) / BUCKET + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - same))


def vectors_of_a_group(vectors: DataFrame) -> int:
    """How many vectors the group of a vector has on average, itself included: what buckets are made of."""
    of_groups = vectors.groupBy("group").count()
    return math.ceil(of_groups.agg(F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).first()[0] or 0)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of equal length as rows, straight from their buffer, of length one."""
    x = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hyperplanes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(7).normal(size=(dim, count))


def with_buckets(vectors: DataFrame, dim: int, planes: int, tables: int) -> DataFrame:
    """Adds ``buckets``, the row's bucket in each table; ``vectors`` has vec and a long ``group``."""
    schema = vectors.schema.simpleString()[7:-1] + ",buckets:array<bigint>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = hyperplanes(dim, tables * planes)
        weights = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = (matrix(batch.column("vec")) @ random > 0).reshape(batch.num_rows, tables, planes) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "buckets"])

    return vectors.mapInArrow(each, schema).withColumn("buckets", F.transform("buckets", lambda b, i: F.xxhash64("group", i, b)))


def buckets_of_groups(placed: DataFrame, tables: int, large: int) -> DataFrame:
    """(group, whole, most, cell): whole if the group's buckets hold more pairs than all of it; rows of its largest bucket, which is the group then, and of a cell.

    A whole group has cells of half its rows, not to be in one task.
    """
    sizes = placed.select("group", F.explode("buckets").alias("bucket")).groupBy("group", "bucket").agg(F.count("*").cast("double").alias("n"))
    rows = F.sum("n") / tables
    whole = F.sum(F.col("n") * F.col("n")) > rows * rows
    cell = F.when(whole, F.least(F.lit(large), F.greatest(F.lit(2 * BUCKET), F.ceil(rows / 2)))).otherwise(large)
    return keep(sizes.groupBy("group").agg(whole.alias("whole"), F.when(whole, rows).otherwise(F.max("n")).alias("most"), cell.alias("cell")))


def crowded_buckets(rows: DataFrame) -> DataFrame | None:
    """(bucket, asked, met) of buckets with more rows than their ``cell``: in how many parts these ask, and are met; none where there is none."""
    parts = lambda flag: F.greatest(F.ceil(F.count_if(flag) * 2 / F.max("cell")), F.lit(1))
    sizes = rows.select(F.explode("buckets").alias("bucket"), "asks", "meets", "cell").groupBy("bucket").agg((F.count("*") > F.max("cell")).alias("crowded"), parts("asks").alias("asked"), parts("meets").alias("met"))
    found = keep(sizes.where("crowded").select("bucket", "asked", "met"))
    return found if found.limit(1).count() else None


def in_buckets(rows: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """A row for each bucket of ``rows``, sorted by bucket and arrival within partitions.

    A crowded bucket has a cell for each part that asks and each part that is
    met, so each two of its rows come together in one.  A row that does both is
    told once for each; the one that asks comes first, and so doesn't meet itself.
    ``crowded`` is small: a row of it stands for more than a cell of ``rows``.
    """
    each = rows.select(F.explode("buckets").alias("bucket"), "at", "id", "asks", "meets", "leads", "vec")
    if crowded is not None:
        each = each.join(F.broadcast(crowded), "bucket", "left")
        part = lambda of: F.pmod(F.xxhash64("id"), of)
        cell = lambda a, m, asks: F.struct(F.xxhash64("bucket", a, m).alias("bucket"), F.lit(asks).alias("asks"), F.lit(not asks).alias("meets"))
        asking = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("met") - 1), lambda m: cell(part(F.col("asked")), m, True))).otherwise(F.array())
        meeting = F.when(F.col("meets"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("asked") - 1), lambda a: cell(a, part(F.col("met")), False))).otherwise(F.array())
        cells = F.when(F.col("asked").isNull(), F.array(F.struct("bucket", "asks", "meets"))).otherwise(F.concat(asking, meeting))
        each = each.select(F.inline(cells), "at", "id", "leads", "vec")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.select("bucket", "at", "id", "asks", "meets", "leads", "vec").repartition(n, "bucket").sortWithinPartitions("bucket", "at", "id", "meets")


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, numbers of the rows that ask, of those that are met, leads, unit vectors) of each bucket with two rows or more, from batches that come sorted."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        if sum(b.num_rows for b in held) > 1:
            t = pa.Table.from_batches(held).combine_chunks()
            asks, meets, leads = (t.column(c).to_numpy() for c in ("asks", "meets", "leads"))
            yield t.column("id").chunk(0), np.flatnonzero(asks), np.flatnonzero(meets), leads, matrix(t.column("vec").chunk(0))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column("bucket"))
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if keys[s] != last:
                yield from whole()
                held, last = [], keys[s]
            held.append(batch.slice(s, e - s))
    yield from whole()


def blocks(numbers: np.ndarray, before: int | None = None) -> Iterator[np.ndarray]:
    """Ascending ``numbers`` in blocks; those below ``before`` alone, if it is given."""
    end = len(numbers) if before is None else int(np.searchsorted(numbers, before))
    for at in range(0, end, BLOCK):
        yield numbers[at : min(at + BLOCK, end)]


def told_flags(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, follows, waits): near an earlier representative; else, near an earlier row that is not decided.  One such row is enough."""
    for ids, asked, met, leads, x in buckets_of(batches):
        kinds = met[leads[met]], met[~leads[met]]
        for rows in blocks(asked):
            flags = np.zeros((2, len(rows)), bool)
            for flag, kind in zip(flags, kinds, strict=True):
                for others in blocks(kind, rows[-1]):
                    left = np.flatnonzero(~flags.any(0))
                    if not len(left):
                        break
                    near = x[rows[left]] @ x[others].T >= threshold - 1e-12
                    flag[left] = (near & (others[None, :] < rows[left][:, None])).any(1)
            told = np.flatnonzero(flags.any(0))
            if len(told):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[told])), pa.array(flags[0][told]), pa.array(flags[1][told])], ["id", "follows", "waits"])


def told_best(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, representative, similarity): the nearest earlier representative of each other row, the first among equals."""
    for ids, asked, met, _, x in buckets_of(batches):
        for rows in blocks(asked):
            score, best = np.full(len(rows), -2.0), np.zeros(len(rows), np.int64)
            for others in blocks(met, rows[-1]):
                s = np.round(x[rows] @ x[others].T, 12)
                s[others[None, :] > rows[:, None]] = -2
                first = s.argmax(1)
                found = s[np.arange(len(rows)), first]
                better = found > score
                score[better], best[better] = found[better], others[first[better]]
            good = score >= threshold - 1e-12
            if good.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[good])), ids.take(pa.array(best[good])), pa.array(score[good])], ["id", "representative", "similarity"])


def usable(vec: Column) -> Column:
    """Vectors that have a direction: neither null nor empty, every component finite, not all zero."""
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(vec, lambda c: c != 0), F.lit(False))


def resolve_semantic(facts: DataFrame, groups: Sequence[str] = (), threshold: float = THRESHOLD, recall: float = RECALL, large: int = LARGE) -> DataFrame:
    """``facts`` (id, at, embedding, group columns) with representative, similarity and is_new.

    Facts without a usable vector stand for themselves; vectors of different
    lengths are never near.  A null in a group column is a group of its own.
    """
    kind = facts.schema["id"].dataType.simpleString()
    names = list(groups)
    firm = facts.where(usable(F.col("embedding")))
    key = F.xxhash64(F.size("embedding"), *names)
    first = F.min(F.struct("at", "id"))
    vectors = keep(firm.groupBy(key.alias("group"), F.col("embedding").alias("vec")).agg(first.alias("f")).select(F.col("f.id").alias("id"), F.col("f.at").alias("at"), "group", "vec"))
    dims = [r[0] for r in vectors.select(F.size("vec")).distinct().collect()]
    planes, tables = table_sizes(vectors_of_a_group(vectors), threshold, recall)
    parts = [with_buckets(vectors.where(F.size("vec") == d), d, planes, tables) for d in dims]
    if not parts:
        return facts.select("*", F.col("id").alias("representative"), F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("is_new"))
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    placed = keep(placed)
    of_groups = buckets_of_groups(placed, tables, large)
    any_whole, any_crowded = of_groups.agg(F.bool_or("whole"), F.bool_or(F.col("most") > F.col("cell"))).first()
    if any_whole:
        one = F.when(F.col("whole"), F.array(F.xxhash64("group"))).otherwise(F.col("buckets"))
        placed = keep(placed.join(of_groups.where("whole"), "group", "left").select(*vectors.columns, one.alias("buckets"), F.coalesce("cell", F.lit(large)).alias("cell")))
    else:
        placed = placed.withColumn("cell", F.lit(large))
    open_, new = placed, placed.limit(0)
    leaders, split = None, any_crowded
    while True:
        both = open_.withColumn("leads", F.lit(False)).unionByName(new.withColumn("leads", F.lit(True))).withColumn("asks", ~F.col("leads")).withColumn("meets", F.lit(True))
        crowded = crowded_buckets(both) if split else None
        split = crowded is not None  # the rounds after have fewer rows
        flags = in_buckets(both, crowded).mapInArrow(lambda b: told_flags(b, threshold), f"id {kind}, follows boolean, waits boolean")
        told = flags.groupBy("id").agg(F.bool_or("follows").alias("follows"), F.bool_or("waits").alias("waits"))
        judged = keep(open_.join(told, "id", "left").withColumn("follows", F.coalesce("follows", F.lit(False))).withColumn("waits", F.coalesce("waits", F.lit(False))))
        new = judged.where("not follows and not waits").select(*placed.columns)
        leaders = new if leaders is None else leaders.unionByName(new)
        open_ = judged.where("not follows and waits").select(*placed.columns)
        if not open_.limit(1).count():
            break
    led = leaders.select("id").withColumn("leads", F.lit(True))
    every = placed.join(led, "id", "left").withColumn("leads", F.coalesce("leads", F.lit(False))).withColumn("asks", ~F.col("leads")).withColumn("meets", F.col("leads"))
    crowded = crowded_buckets(every) if any_crowded else None
    matches = in_buckets(every, crowded).mapInArrow(lambda b: told_best(b, threshold), f"id {kind}, representative {kind}, similarity double")
    order = matches.join(leaders.select(F.col("id").alias("representative"), F.col("at").alias("_at")), "representative")
    best = order.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "_at", "representative")).alias("b"))
    chosen = vectors.join(best, "id", "left").select("group", "vec", F.col("id").alias("_first"), F.coalesce("b.representative", "id").alias("representative"), (-F.col("b.minus")).alias("similarity"))
    met = facts.withColumn("_g", key).join(chosen.withColumnsRenamed({"group": "_g", "vec": "embedding"}), ["_g", "embedding"], "left")
    own = F.col("representative").isNull() | (F.col("representative") == F.col("id"))
    return met.select(*facts.columns, F.coalesce("representative", "id").alias("representative"), F.when(~own, F.coalesce("similarity", F.lit(1.0))).alias("similarity"), own.alias("is_new"))
