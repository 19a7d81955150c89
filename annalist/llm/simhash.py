"""SimHash near copies: fingerprints of 64 bits, linked within four bits by pigeonring filtering.

A fingerprint is a ring of eight segments.  Two that differ in at most four
bits have a place on the ring from which every chain of j consecutive segments
differs in no more than its share, ``4 * j // 8`` bits: the cumulated
differences stay within proportional budgets.  So from there on at most that
many segments of the chain differ at all.  Which segments a full chain leaves
equal is a set of four; a fingerprint has one signature for each such set, its
contents there, and linked ones share a signature.  Candidates are those that
share one; of these only the pairs that have a chain within its budgets (tested
for all eight places in one word of eight counters) come to the full count.

Equal fingerprints are one node from the start.  The signatures are sorted, and
a task scans its groups in blocks.  It tells no pairs but a forest over all
groups that it has seen, so what it tells grows with its fingerprints.  A group
of more than ``LARGE`` fingerprints is not compared at all.  Its members go
another way, which is exact too and grows with their number, not its square:
each is told to all strings within two bits of it, and two of them are linked
if and only if such a string hears of both.  No string hears of more than 2,081
different fingerprints.  Signatures that a third of all fingerprints share
would make one long task even so; those with more than ``HOT`` in a sample
(which affects the dealing only, not the result) skip it.

Nulls and oddities: a null or wordless text has fingerprint zero, which is
linked like any other; with fewer than four words the whole sequence is one
shingle; repeated shingles count as often as they stand; repeated rows are
copies; a null doc_id takes part, but names a component only if nothing else
does.  Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from annalist.llm.common import materialise, shuffle_partitions, text_slices
from annalist.llm.components import connected_components

#: Words of a shingle, seed of its hash, and bits by which linked fingerprints differ at most.
SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = 8
#: Segments whose budgets are tested before the full count.
CHAIN = 4
#: Fingerprints of a group up to which they are compared with each other.
LARGE = 2048
#: Every how many-th fingerprint is sampled for hot signatures, and how many of these make one hot.
SAMPLED, HOT = 64, 512
#: Pairs that are compared at once.
PAIRS = 1 << 20
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16

U = np.uint64


def fingerprint(text: bytes) -> int:
    """The SimHash of a text: a bit is one if it is in more than half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    spans = zip(starts[:n].tolist(), (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]).tolist(), strict=True)
    counts = np.zeros(64, np.int64)
    while part := [xxh64_intdigest(line[a:b], SEED) for a, b in itertools.islice(spans, COUNTED)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f): the fingerprint of each text, its 64 bits as a signed number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = np.array([fingerprint(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()], U)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "f"])

    columns = docs.select("doc_id", "text")
    return columns.mapInArrow(each, StructType([columns.schema["doc_id"], StructField("f", LongType())]))


def equal_segments() -> list[tuple[int, ...]]:
    """The sets of segments that some chain around the ring leaves equal at least, by its budgets, from any start."""
    found = set()
    for start in range(SEGMENTS):
        for unequal in itertools.combinations(range(SEGMENTS), DISTANCE):
            if all(sum(u < j for u in unequal) <= DISTANCE * j // SEGMENTS for j in range(1, SEGMENTS + 1)):
                found.add(tuple(sorted((start + k) % SEGMENTS for k in range(SEGMENTS) if k not in unequal)))
    return sorted(found)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Ones in the segments that a signature holds.
MASKS = [signed(sum(0xFF << (8 * k) for k in kept)) for kept in equal_segments()]
#: What two bits at most can change.
BALL = [signed(sum(1 << b for b in bits)) for n in range(DISTANCE // 2 + 1) for bits in itertools.combinations(range(64), n)]


def within_budgets(x: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """Whether, for each word of differing bits, some place of the ring starts chains that all keep to their budgets.

    The bits of the eight segments are counted in the eight bytes of a word;
    rotations of it add up chains from every place at once.
    """
    x = x - ((x >> U(1)) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
    each = (x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)
    total, over = each, np.zeros_like(each)
    for j in range(1, chain + 1):
        if j > 1:
            turn = 8 * (j - 1)
            total = total + ((each >> U(turn)) | (each << U(64 - turn)))
        over |= total + U(0x0101010101010101 * (127 - DISTANCE * j // SEGMENTS))
    return (~over & U(0x8080808080808080)) != 0


class Forest:
    """The least member of each tree, over numbers that come up by and by."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def compare(group: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Links of the fingerprints of one group that the forest lacks."""
    out = []
    rows = max(1, PAIRS // len(group))
    for at in range(0, len(group) - 1, rows):
        part, rest = group[at : at + rows], group[at:]
        x = part[:, None] ^ rest[None, :]
        i, k = np.nonzero(np.triu(within_budgets(x), 1))
        near = np.bitwise_count(x[i, k]) <= DISTANCE
        for a, b in zip(part[i[near]].view(np.int64).tolist(), rest[k[near]].view(np.int64).tolist(), strict=True):
            if forest.link(a, b):
                out.append((a, b))
    return out


def scan(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of links in groups of rows (kept, held, f) that come sorted; (f, null) for members of large groups."""
    forest, schema = Forest(), pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held, last, streaming = np.zeros(0, np.int64), None, False

    def table(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def told(members: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(members) > large:
            yield table(members, [None] * len(members))
        elif links := compare(members.view(U), forest):
            yield table(*zip(*links, strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        kept, content, f = (np.asarray(batch.column(k)) for k in range(3))
        edge = np.flatnonzero((kept[1:] != kept[:-1]) | (content[1:] != content[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(f)]])
        inner = ends - starts > 1
        inner[[0, -1]] = True
        for s, e in zip(starts[inner].tolist(), ends[inner].tolist(), strict=True):
            key = (int(kept[s]), int(content[s]))
            if key != last:
                if not streaming and len(held) > 1:
                    yield from told(held)
                held, last, streaming = f[s:e], key, False
            else:
                held = f[s:e] if streaming else np.concatenate([held, f[s:e]])
            if len(held) > large or streaming:
                yield table(held, [None] * len(held))
                held, streaming = held[:0], True
    if not streaming and len(held) > 1:
        yield from told(held)


def signatures(nodes: DataFrame) -> DataFrame:
    """(kept, content, f): which segments, and a fingerprint's bits there."""
    contents = F.array(*[F.col("f").bitwiseAND(F.lit(m)) for m in MASKS])
    return nodes.select(F.posexplode(contents).alias("kept", "content"), "f")


def links_between(nodes: DataFrame, large: int = LARGE, hot: int = HOT) -> DataFrame:
    """(a, b): links of distinct fingerprints (f), as many as connect all that are linked."""
    told = signatures(nodes)
    sample = nodes.where(F.pmod(F.xxhash64("f"), F.lit(SAMPLED)) == 0)
    # no more than SAMPLED * len(MASKS) / hot of a fingerprint's weight each: far fewer rows than fingerprints
    common = signatures(sample).groupBy("kept", "content").count().where(F.col("count") > hot).select("kept", "content")
    common = materialise(common)
    skipped = None
    if common.limit(1).count():
        mark = common.withColumn("common", F.lit(True))
        marked = materialise(told.join(mark, ["kept", "content"], "left"))
        skipped = marked.where("common").select("f").distinct()
        told = marked.where("common is null").select("kept", "content", "f")
    dealt = told.repartition(shuffle_partitions(nodes.sparkSession), "kept", "content").sortWithinPartitions("kept", "content", "f")
    found = materialise(dealt.mapInArrow(lambda batches: scan(batches, large), "a long, b long"))
    crowded = found.where("b is null").select(F.col("a").alias("f"))
    if skipped is not None:
        crowded = crowded.unionByName(skipped)
    return found.where("b is not null").unionByName(links_by_strings(crowded.distinct()))


def links_by_strings(nodes: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints (f), through the strings within two bits of both."""
    strings = nodes.select("f", F.explode(F.array(*map(F.lit, BALL))).alias("change")).select("f", F.col("f").bitwiseXOR(F.col("change")).alias("string"))
    least = strings.groupBy("string").agg(F.min("f").alias("least"), F.count("*").alias("n")).where("n > 1").select("string", "least")
    return strings.join(least, "string").where("f <> least").select(F.col("f").alias("a"), F.col("least").alias("b")).distinct()


def near_copies(docs: DataFrame, large: int = LARGE, hot: int = HOT) -> DataFrame:
    """(doc_id, f, component_id): one row for each of ``docs``; the component is named by its smallest doc_id."""
    each = materialise(fingerprints(docs))
    nodes = materialise(each.groupBy("f").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links_between(nodes.select("f"), large, hot))
    placed = nodes.join(roots.select(F.col("node").alias("f"), "root"), "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    named = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    return each.join(placed.join(named, "root").select("f", "component_id"), "f").select("doc_id", "f", "component_id")


def near_copies_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): the fingerprint in 16 hexadecimal digits."""
    return near_copies(docs).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
