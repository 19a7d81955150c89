"""N-gram Jaccard self-join by PartEnum signatures, and its components.

A text is the set of its distinct shingles of five words.  Sizes fall into
bands; a pair that is similar enough lies in one band, or the larger set just
above the smaller one's.  In the instance of a band the domain of shingles is
dealt into groups of ``SECOND`` partitions.  Two such sets can differ in so few
partitions that in one group at least they differ in ``DIFFER`` or fewer; so
they hold the same shingles in all others of that group.  Every subset of
``SECOND - DIFFER`` partitions of a group that is not empty is a signature: its
content.  Whether the partitions are even enough for that (each group counts
for as many differences as it takes to spoil its subsets) is checked for every
set; where one fails, its instance is run again with more partitions, at last
with one for each shingle, each a signature by itself.

There is more: from the differences that are possible follows how many
signatures a set shares with any partner at least.  It may leave out all of
these but one, its commonest ones, in one order for all sets, and still shares
one with every partner.  Signatures of many sets, such as those of a passage
that stands everywhere, are left out so, and need no comparisons.

Equal sets are one node from the start.  Sets that share a signature are
compared to one of them (a star), which links nearly all that are linked.  Then
components are taken, and only sets in different ones that share a signature
are compared with each other, in blocks, by a bound first: sketches of the
parity of shingles on each of many bits differ by no more than the sets do.  Every link that is reported or
used is checked on the sets themselves.

Nulls and oddities: a null or wordless text has no shingles and is linked with
nothing; a text of one to four words is one shingle; repeated rows are copies;
a null doc_id takes part but never names a component unless nothing else can.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import materialise, shuffle_partitions, text_slices, utf8_of
from annalist.llm.components import connected_components
from annalist.llm.textkit import NOT_SPACE, U, Words, mix

SHINGLE, PERCENT = 5, 75
#: Growth of the bands of set sizes.
BAND = 1.6
#: Partitions of a group, and how many of them may differ.  (3, 1) gives longer signatures, but 1.5 times as many.
SECOND, DIFFER = 2, 1
#: Groups for each DIFFER + 1 differences that are possible, from the first try on.
TRIES = (1.1, 1.2, 1.35, 1.6, 2.0, 3.0, 6.0, 20.0, math.inf)
#: Low bits of a signature that hold its band.
BAND_BITS = 63
#: Signatures in a bucket on average; a task holds one bucket's at a time.
BUCKET = 1_000_000
#: Sets of a group that are compared in one block.
BLOCK = 512
#: Pairs of sketches that are subtracted at once.
COMPARED = 20_000
#: Sets that share a signature beyond which it is a common one.
COMMON = 32
#: What a set is told of a common signature of its own: how many sets have it, and the signatures it shares at least.
MEMBER = np.dtype([("node", "<i8"), ("sign", "<u8"), ("size", "<u4"), ("shared", "<u2")])
#: Pairs that a task remembers having told, so as to tell them once.
TOLD = 200_000
#: Partners of a set that are tried in the rounds before all that are left.
LIKELIEST = (1,)
#: Common groups of a set up to which its rows carry them all, so that a pair is told in the first it shares alone.
LISTED = 128
#: Members of a pivot that are checked by one task.
STAR = 256


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): hashes[first[d]:first[d+1]] is the sorted set of text d."""
    words = Words(*utf8_of(texts), NOT_SPACE)
    at, hashes = words.ngrams(size)
    owner = np.searchsorted(words.first, at, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        from annalist.llm.textkit import between

        whole = between(words.sums(), words.first[short], words.first[short + 1])
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[fresh], hashes[fresh]
    return np.searchsorted(owner, np.arange(len(words.counts) + 1)), hashes


def set_keys(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, the same for equal sets."""
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix(hashes), out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) ^ (np.diff(first).astype(U) << U(40))).view(np.int64)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of n shingles: a power of two from 4 n on, 256 at least."""
    return (1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) * 4)), 8, 20).astype(int)).astype(np.int64)


def sketches(first: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """For each set, whether an odd number of its shingles falls on each bit of a hash.

    Two sets differ in at least as many shingles as their sketches do in bits.
    """
    bits = sketch_bits(np.diff(first))
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(bits)), np.diff(first))
    place = base[owner] + (mix(hashes ^ U(0xA5A5A5A5)) & (bits[owner] - 1).astype(U)).astype(np.int64)
    odd = np.packbits((np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes that the shingles of this longer one would have: its parts, bit by bit exclusive."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, U).reshape(-1, size // 8), axis=0)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def most_apart(n: int | np.ndarray, m: int | np.ndarray):
    """Shingles in just one of two sets of n and m that are linked, at most."""
    return (n + m) * (100 - PERCENT) // (100 + PERCENT)


def bands(largest: int) -> np.ndarray:
    """Upper sizes of the bands, up to the one that holds ``largest``."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


def groups_for(apart: int | np.ndarray, tries: float | np.ndarray):
    """Groups of partitions of an instance; 0 where each shingle is a partition by itself."""
    return np.where(np.isfinite(tries), np.ceil(np.where(np.isfinite(tries), tries, 0) * (apart + 1) / (DIFFER + 1)), 0).astype(np.int64)


def first_try(upper: int) -> int:
    """The try whose partitions are expected to be even enough, by eight standard deviations."""
    apart = int(most_apart(upper, 100 * upper // PERCENT))
    for i, f in enumerate(TRIES[:-1]):
        n = int(groups_for(apart, f))
        full = 1 - math.exp(-upper / (n * SECOND))
        chance = [math.comb(SECOND, e) * full**e * (1 - full) ** (SECOND - e) for e in range(SECOND + 1)]
        counts = sum(p * min(e, DIFFER + 1) for e, p in enumerate(chance))
        square = sum(p * min(e, DIFFER + 1) ** 2 for e, p in enumerate(chance))
        if n * counts - 8 * math.sqrt(max(n * (square - counts**2), 0.25)) > apart:
            return i
    return len(TRIES) - 1


def subsets() -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(SECOND), SECOND - DIFFER))


def spoilt() -> list[list[int]]:
    """[e]: how many signatures a first, second ... difference can spoil in a group with e partitions in use, most first."""
    clean = lambda e, d: math.comb(SECOND - d, SECOND - DIFFER) - math.comb(SECOND - d - max(e - d, 0), SECOND - DIFFER)
    left = [[clean(e, d) for d in range(SECOND + 1)] for e in range(SECOND + 1)]
    return [sorted((a - b for a, b in itertools.pairwise(row)), reverse=True) for row in left]


def least_shared(tally: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Signatures left at least after ``apart`` differences, of sets with tally[:, e] groups with e partitions in use."""
    losses = spoilt()
    total = sum(tally[:, e] * sum(losses[e]) for e in range(SECOND + 1))
    left = apart.copy()
    for worth, e in sorted(((x, e) for e in range(SECOND + 1) for x in losses[e] if x), reverse=True):
        spent = np.minimum(left, tally[:, e])
        total, left = total - worth * spent, left - spent
    return total


def signatures(first: np.ndarray, hashes: np.ndarray, uppers: np.ndarray, tries: dict[int, int]) -> tuple[np.ndarray, ...]:
    """(set, signature, shared, failed) over the instances in ``tries``.

    A signature's low bits are its band; ``shared`` is how many signatures its
    set shares with any partner at least; ``failed`` has the band of each set
    that needs another try.
    """
    sizes = np.diff(first)
    band = np.searchsorted(uppers, sizes)
    owners, signs, shared, failed = [], [], [], []
    owner_of = np.repeat(np.arange(len(sizes)), sizes)
    for shift in (0, 1):
        # its own band's instance, and that of the band below if a linked set may lie there
        instance = band - shift
        takes = (sizes > 0) & (instance >= 0)
        if shift:
            takes &= PERCENT * sizes <= 100 * uppers[np.maximum(instance, 0)]
        choice = np.array([tries.get(b, -1) for b in range(len(uppers) + 1)])[np.where(takes, instance, len(uppers))]
        takes &= choice >= 0
        if not takes.any():
            continue
        upper = uppers[np.where(takes, instance, 0)]
        groups = groups_for(most_apart(upper, 100 * upper // PERCENT), np.array(TRIES)[np.maximum(choice, 0)])
        partner = np.where(shift == 1, upper, np.minimum(100 * sizes // PERCENT, 100 * upper // PERCENT))
        apart = most_apart(sizes, partner)
        pick = takes[owner_of]
        owner, values = owner_of[pick], hashes[pick]
        salt = (instance * len(TRIES) + choice + 1).astype(U)
        spread = mix(values + salt[owner] * U(0x9E3779B97F4A7C15))
        parts = groups[owner] * SECOND
        part = np.where(parts > 0, ((spread >> U(32)) * np.maximum(parts, 1).astype(U)) >> U(32), spread)
        order = np.lexsort((part, owner))
        owner, part, content = owner[order], part[order], mix(spread)[order]
        new = np.ones(len(owner), bool)
        new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            continue
        owner, part, sums = owner[at], part[at], np.add.reduceat(content, at)
        single = groups[owner] == 0
        # one row for each group that has a partition in use; rows of single partitions have but one subset
        group = np.where(single, part, part // U(SECOND))
        new = np.ones(len(owner), bool)
        new[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
        row, at = np.cumsum(new) - 1, np.flatnonzero(new)
        place = np.where(single, 0, part % U(SECOND)).astype(np.int64)
        held, used = np.zeros((len(at), SECOND), U), np.zeros((len(at), SECOND), bool)
        held[row, place], used[row, place] = sums, True
        owner, group, single = owner[at], group[at], single[at]
        chosen = subsets()
        grid, real = np.zeros((len(at), len(chosen)), U), np.zeros((len(at), len(chosen)), bool)
        for k, own in enumerate(chosen):
            real[:, k] = np.where(single, k == 0, used[:, own].any(axis=1))
            grid[:, k] = mix(np.where(single, held[:, 0], held[:, own].sum(axis=1)) ^ mix(group * U(len(chosen)) + U(k) + salt[owner]))
        mine = np.repeat(owner, len(chosen))[real.ravel()]
        owners.append(mine)
        signs.append((grid.ravel()[real.ravel()] & ~U(BAND_BITS)) | instance[mine].astype(U))
        n_used = used.sum(axis=1)
        tally = np.bincount(owner * (SECOND + 1) + n_used, minlength=len(sizes) * (SECOND + 1)).reshape(-1, SECOND + 1)
        short = takes & (groups > 0) & ((tally * np.minimum(np.arange(SECOND + 1), DIFFER + 1)).sum(axis=1) <= apart)
        failed.append(instance[short])
        left = np.where(groups > 0, least_shared(tally, apart), tally[:, 1] - apart)
        shared.append(np.clip(left, 0, 65535)[mine])
    if not owners:
        return np.zeros(0, int), np.zeros(0, U), np.zeros(0, int), np.zeros(0, int)
    return tuple(map(np.concatenate, (owners, signs, shared, failed)))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, sketch) of each document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            first, hashes = shingle_sets(part["text"])
            yield pa.record_batch(
                [part["doc_id"], part["text_key"], pa.array(np.diff(first)), pa.array(set_keys(first, hashes)), pa.array(sketches(first, hashes), pa.binary())],
                ["doc_id", "text_key", "n_shingles", "node", "sketch"],
            )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, f"doc_id {id_type}, text_key bigint, n_shingles bigint, node bigint, sketch binary")


def shared_signatures(docs: DataFrame, uppers: np.ndarray, tries: dict[int, int], total: int) -> DataFrame:
    """(kind, a, b, members, data): what sharing signatures gives.

    kind 0: a candidate pair of nodes; kind 1: the nodes (members) of a group of
    three or more, named a; kind 2: band a needs another try; kind 3: rows of
    ``MEMBER`` for nodes of common signatures whose hash falls into bucket a.
    """
    buckets = max(1, math.ceil(total / BUCKET))
    bits = U(64 - max(1, (buckets - 1).bit_length()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            first, hashes = shingle_sets(part["text"])
            nodes, once = np.unique(set_keys(first, hashes), return_index=True)
            owner, signs, shared, failed = signatures(first, hashes, uppers, tries)
            keep = np.zeros(len(first) - 1, bool)
            keep[once] = True
            chosen = keep[owner]
            keys = set_keys(first, hashes)[owner[chosen]]
            signs, shared = signs[chosen], shared[chosen].astype(np.uint16)
            bucket = (signs >> bits).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, *columns = (c[order] for c in (bucket, signs, keys, shared))
            cut = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])
            rows = [(int(bucket[a]), b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(starts, ends, strict=True) if b > a]
            rows += [(-1 - int(b), b"") for b in np.unique(failed)]
            if rows:
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "a", "b", "members", "data"])

    def groups(signs: np.ndarray, keys: np.ndarray, shared: np.ndarray, told: set[tuple[int, int]]) -> pa.RecordBatch | None:
        order = np.lexsort((keys, signs))
        signs, keys, shared = signs[order], keys[order], shared[order]
        new = np.ones(len(signs), bool)
        new[1:] = (signs[1:] != signs[:-1]) | (keys[1:] != keys[:-1])
        signs, keys, shared = signs[new], keys[new], shared[new]
        start = np.ones(len(signs), bool)
        start[1:] = signs[1:] != signs[:-1]
        at = np.flatnonzero(start)
        sizes = np.diff(np.append(at, len(signs)))
        several = np.repeat(sizes > 1, sizes)
        pivot = np.repeat(keys[at], sizes)
        pairs = np.unique(np.stack([pivot, keys], axis=1)[several & ~start], axis=0)
        members: dict[int, np.ndarray] = {}
        # a task has several buckets, and tells a pair once
        fresh = [p for p in map(tuple, pairs.tolist()) if p not in told]
        if len(told) > TOLD:
            told.clear()
        told.update(fresh)
        rows = [(0, x, y, None, None) for x, y in fresh]
        small = (sizes > 2) & (sizes <= COMMON)
        for a, n in zip(at[small].tolist(), sizes[small].tolist(), strict=True):
            mine = keys[a : a + n]
            members[int(mix(np.array([mix(mine.view(U)).sum()], U)).view(np.int64)[0])] = mine
        rows += [(1, k, 0, m, None) for k, m in members.items()]
        of = np.repeat(sizes, sizes)
        many = of > COMMON
        told_to = np.zeros(int(many.sum()), MEMBER)
        for name, values in (("node", keys), ("sign", signs), ("size", of), ("shared", shared)):
            told_to[name] = values[many]
        home = (mix(keys[many].view(U)) >> bits).astype(np.int64)
        order = np.argsort(home, kind="stable")
        home, told_to = home[order], told_to[order]
        cut = np.flatnonzero(np.diff(home, prepend=-1))
        rows += [(3, int(home[a]), 0, None, part.tobytes()) for a, part in zip(cut, np.split(told_to, cut[1:]), strict=False)]
        return batch_of(rows) if rows else None

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        told: set[tuple[int, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                n = [len(x) // 18 for x in held]
                column = lambda kind, at: np.concatenate([np.frombuffer(x, kind, k, at * k) for x, k in zip(held, n, strict=True)])  # noqa: B023, E731
                columns = column(U, 0), column(np.int64, 8), column(np.uint16, 16)
                held.clear()
                out = groups(*columns, told)
                if out is not None:
                    yield out

        for batch in batches:
            for bucket, data in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if bucket != now:
                    yield from flush()
                    now = bucket
                    if bucket < 0:
                        yield batch_of([(2, -1 - bucket, 0, None, None)])
                if data:
                    held.append(data)
        yield from flush()

    spark = docs.sparkSession
    dealt = docs.select("doc_id", "text").mapInArrow(emit, "bucket bigint, data binary").repartition(max(shuffle_partitions(spark), 1), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(reduce, "kind int, a bigint, b bigint, members array<bigint>, data binary")


def may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches do not rule a link out."""
    for k in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")), k)
    sized = pairs.where(F.least("n_a", "n_b") * 100 >= PERCENT * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for n, m, s, t in zip(*(part[c].to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True):
                size = min(len(s), len(t))
                keep.append(int(bits_apart(folded(s, size), folded(t, size))) <= most_apart(n, m))
            yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return sized.mapInArrow(run, "a bigint, b bigint")


def check_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, nameless: bool = True) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by the sets themselves.

    Each member's set goes to its pivot's task once; members of a pivot are
    dealt over as many tasks as their number asks for.  ``nameless``: whether
    there may be sets without a doc_id.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("salts"))
    salted = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    to_pivot = salted.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("member"))
    pivots = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")).select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("member"))
    wanted = to_pivot.unionByName(pivots).join(nodes.select("node", "doc_id", "text_key"), "node")
    by_doc = wanted.groupBy("doc_id", "text_key", "node").agg(F.collect_list(F.struct("a", "salt", "member")).alias("to"))
    carried = docs.select("doc_id", "text").join(by_doc.where("doc_id is not null").drop("text_key"), "doc_id")
    if nameless:
        # sets that only documents without doc_id hold are fetched by their text
        by_text = docs.where("doc_id is null").withColumn("text_key", F.xxhash64("text")).join(by_doc.where("doc_id is null").drop("doc_id"), "text_key")
        carried = carried.unionByName(by_text.dropDuplicates(["node", "text"]).drop("text_key"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            first, hashes = shingle_sets(part["text"])
            keys = set_keys(first, hashes)
            rows = []
            for i, (node, to) in enumerate(zip(part["node"].to_pylist(), part["to"].to_pylist(), strict=True)):
                if keys[i] == node:
                    raw = hashes[first[i] : first[i + 1]].tobytes()
                    rows += [(t["a"], t["salt"], t["member"], node, raw) for t in to]
                if len(rows) > 2000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "salt", "member", "node", "data"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in batches:
            links = []
            for a, salt, member, node, data in zip(*(batch[c].to_pylist() for c in ("a", "salt", "member", "node", "data")), strict=True):
                values = np.frombuffer(data, U)
                if member == 0:
                    pivot, own = (a, salt), values
                elif pivot == (a, salt):
                    both = len(np.intersect1d(own, values, assume_unique=True))
                    if 100 * both >= PERCENT * (len(own) + len(values) - both):
                        links.append((a, node))
            if links:
                yield pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    sent = carried.mapInArrow(send, "a bigint, salt bigint, member int, node bigint, data binary")
    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(check, "a bigint, b bigint")


def groups_of(found: DataFrame) -> DataFrame:
    """(group, node, common): the sets to be compared with each other.

    Of its common signatures each set leaves out as many as it can spare,
    commonest first; small groups stay as they are, those of equal members once.
    What a set's common signatures are is told to the bucket of its hash.
    """
    small = found.where("kind = 1").groupBy("a").agg(F.first("members").alias("members")).select(F.col("a").alias("group"), F.explode("members").alias("node"), F.lit(False).alias("common"))

    def spare(parts: list[bytes]) -> pa.RecordBatch:
        told = np.frombuffer(b"".join(parts), MEMBER)
        band = told["sign"] & U(BAND_BITS)
        order = np.lexsort((told["sign"].astype(np.int64), -told["size"].astype(np.int64), band, told["node"]))
        told, band = told[order], band[order]
        new = np.ones(len(told), bool)
        new[1:] = (told["node"][1:] != told["node"][:-1]) | (band[1:] != band[:-1])
        at = np.flatnonzero(new)
        nth = np.arange(len(told)) - np.repeat(at, np.diff(np.append(at, len(told)))) + 1
        kept = told[nth >= told["shared"]]
        return pa.record_batch([pa.array(kept["sign"].astype(np.int64)), pa.array(kept["node"].astype(np.int64))], ["group", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for *key, data in zip(*(batch[c].to_pylist() for c in ("round", "a", "data")), strict=True):
                if key != now and held:
                    yield spare(held)
                    held = []
                now = key
                held.append(data)
        if held:
            yield spare(held)

    dealt = found.where("kind = 3").select("round", "a", "data").repartition(max(shuffle_partitions(found.sparkSession), 1), "round", "a")
    kept = dealt.sortWithinPartitions("round", "a").mapInArrow(run, "group bigint, node bigint")
    return small.unionByName(kept.withColumn("common", F.lit(True)))


def pairs_across(groups: DataFrame, labels: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of a group's nodes that lie in different components and may be linked.

    A group is cut into blocks by hash; every two of its blocks meet in a task.
    ``most``: only so many of the likeliest partners in a task, and only of
    each node that is still alone.  Near copies share many common groups; a pair
    of them is told in the first of these alone.
    """
    listed = groups.where("common").groupBy("node").agg(F.array_sort(F.collect_list("group")).alias("common_groups")).where(F.size("common_groups").between(2, LISTED))
    members = groups.join(listed, "node", "left").withColumn("common_groups", F.when(F.col("common"), F.col("common_groups"))).drop("common").join(labels, "node", "left").withColumn("single", F.col("root").isNull()).withColumn("root", F.coalesce("root", "node"))
    mixed = members.groupBy("group").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    blocks = F.ceil(F.col("size") / BLOCK)
    placed = members.join(mixed.select("group", blocks.alias("blocks")), "group").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    sent = placed.join(nodes.select("node", "n_shingles", "sketch"), "node").select(
        "group", "node", "root", "single", "n_shingles", "sketch", "common_groups", "mine", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    )
    keyed = sent.select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root", "n_shingles", "sketch", "single", "common_groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        seen: set[tuple[int, int]] = set()

        def fresh(rows: list) -> Iterator[pa.RecordBatch]:
            """The pairs of a block that this task has not told yet."""
            for batch in compare(rows):
                new = [p for p in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True) if p not in seen]
                if len(seen) > TOLD:
                    seen.clear()
                seen.update(new)
                if new:
                    yield pa.record_batch([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("group", "i", "j", "mine", "node", "root", "n_shingles", "sketch", "single", "common_groups")), strict=True):
                if row[:3] != now:
                    if len(held) > 1:
                        yield from fresh(held)
                    now, held = row[:3], []
                held.append(row)
        if len(held) > 1:
            yield from fresh(held)

    def compare(rows: list) -> Iterator[pa.RecordBatch]:
        mine, node, root, size = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6))
        shortest = min(len(r[7]) for r in rows)
        grid = np.stack([folded(r[7], shortest) for r in rows])
        single = np.array([r[8] for r in rows])
        x, y = np.triu_indices(len(rows), 1)
        ok = (root[x] != root[y]) & (100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y]))
        if rows[0][1] != rows[0][2]:
            ok &= mine[x] != mine[y]
        x, y = x[ok], y[ok]
        cuts = range(0, len(x), COMPARED)
        apart = np.concatenate([bits_apart(grid[x[c : c + COMPARED]], grid[y[c : c + COMPARED]]) for c in cuts] or [np.zeros(0, np.int64)])
        near = apart <= most_apart(size[x], size[y])
        x, y, apart = x[near], y[near], apart[near]
        lists = [r[9] for r in rows]
        if any(lists):
            held = [m and set(m) for m in lists]
            first = np.array([not lists[i] or not held[k] or next(g for g in lists[i] if g in held[k]) == rows[0][0] for i, k in zip(x.tolist(), y.tolist(), strict=True)], bool)
            x, y, apart = x[first], y[first], apart[first]
        if most is not None and len(x):
            x, y, apart = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([apart, apart])
            alone = single[x]
            x, y, apart = x[alone], y[alone], apart[alone]
            order = np.lexsort((apart / (size[x] + size[y]), x))
            x, y = x[order], y[order]
            nth = np.arange(len(x)) - np.searchsorted(x, x)
            x, y = x[nth < most], y[nth < most]
        if len(x):
            yield pa.record_batch([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["a", "b"])

    return keyed.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document.

    component_id is the least doc_id that links reach, its own included.
    """
    return components(docs).select("doc_id", "n_shingles", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and root (null without shingles) of each document."""
    docs = docs.select("doc_id", "text")
    profile = materialise(profiles(docs))
    nodes = profile.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"), F.min("text_key").alias("text_key"))
    row = profile.agg(F.max("n_shingles").alias("most"), F.sum("n_shingles").alias("total"), F.max(F.col("doc_id").isNull()).alias("nameless")).first()
    if not row["most"]:
        return profile.select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("root"))
    uppers = bands(row["most"])
    tries = {b: first_try(int(u)) for b, u in enumerate(uppers)}
    found, rounds = None, 0
    while tries:
        shared = materialise(shared_signatures(docs, uppers, tries, int(0.7 * row["total"])))
        again = [r["a"] for r in shared.where("kind = 2").select("a").distinct().collect()]
        tries = {b: tries[b] + 1 for b in again}
        shared = shared.withColumn("round", F.lit(rounds))
        found, rounds = shared if found is None else found.unionByName(shared), rounds + 1
    star = found.where("kind = 0").select("a", "b").distinct()
    links = materialise(check_links(may_link(star, nodes), nodes, docs, row["nameless"]))
    labels = connected_components(links)
    groups = materialise(groups_of(found))
    # the likeliest partners first, as each link found spares a whole component's pairs; then all that are left
    for most in (*LIKELIEST, None):
        across = materialise(pairs_across(groups, labels, nodes, most))
        if not across.limit(1).count():
            continue
        more = materialise(check_links(across, nodes, docs, row["nameless"]))
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = connected_components(links)
    named = nodes.select("node", F.col("doc_id").alias("least")).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = named.join(names, "root").select("node", "component_id", "root")
    linked = F.col("n_shingles") > 0
    return profile.join(by_node, "node", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("root")).alias("root")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all their columns kept: the one of the least doc_id.

    Rows without shingles are all kept.  Among rows that tie in doc_id the one
    of the least text hash stays, then any one of the rows equal in both.
    """
    found = materialise(components(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = found.where("root is not null").groupBy("root").agg(F.min(order).alias("r")).select("r.doc_id", "r.text_key")
    bare = found.where("root is null").select("doc_id", "text_key").distinct().withColumn("bare", F.lit(True))
    kept = least.withColumn("bare", F.lit(False)).unionByName(bare)
    copies = found.groupBy("doc_id", "text_key").count()
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_key"] == y["text_key"])
    wanted = kept.join(copies, same(kept, copies)).select(kept["doc_id"].alias("_annalist_id"), kept["text_key"].alias("_annalist_key"), (F.col("bare") | (F.col("count") == 1)).alias("_annalist_all"))
    keyed = docs.withColumn("_annalist_text_key", F.xxhash64("text"))
    met = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["_annalist_id"]) & (keyed["_annalist_text_key"] == wanted["_annalist_key"]))
    one = Window.partitionBy("doc_id", "_annalist_text_key").orderBy("_annalist_key")
    single = met.where(~F.col("_annalist_all")).withColumn("_annalist_n", F.row_number().over(one)).where("_annalist_n = 1")
    return met.where("_annalist_all").select(docs.columns).unionByName(single.select(docs.columns))
