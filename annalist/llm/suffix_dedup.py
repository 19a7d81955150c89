"""Removal of repeated passages by longest-previous-factor arrays, distributed by minimizers.

A passage is any string of ``length`` bytes; strings of ``least`` bytes or more
that another document holds too are reported beside it.  Each window of
``least`` bytes has a minimizer, the leftmost least hash of its grams; windows
in a row with the same minimizer form one stretch of text, which carries on for
``length`` bytes from its last window where the text is that long.  Equal
windows have equal minimizers, so stretches are grouped by the gram that stands
there, and text is compared only within a group:

* a group with one stretch, once: nothing repeats;
* a group whose stretches are all equal: all of their text repeats;
* otherwise the distinct stretches are put in suffix order (prefix doubling to
  ``length``, the end of a stretch unlike anything else).  In that order the
  nearest place before it that is earlier in the corpus, and the nearest after
  it, give a suffix's longest previous factor; the nearest later ones its
  longest next factor.  The lengths of these factors decide: a passage repeats
  where one of them reaches ``length``.

``keep="first"`` removes what has a previous factor, so the first copy stays;
``keep="none"`` removes every copy.  Counting by stretch comes before any text
is moved, so copies travel once however many there are, and a group with more
than ``LARGE`` distinct stretches is matched window by window in a shuffle, by
64-bit hashes, as it must not be one task's.  Equal stretches of a group are
told by 64-bit hashes too.

Nulls and oddities: a null text has no bytes; texts shorter than ``least``
repeat nothing; very long texts are handled stretch by stretch; an empty table
gives no rows; repeated rows are copies of each other (with ``keep="first"``,
rows equal in doc_id and text count as one place and are all kept alike; such
rows are one document where bytes shared with others are counted);
further columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import materialise, text_slices, utf8_of
from annalist.llm.textkit import BASE_INVERSE, BYTE_CODES, U, between, mix, powers, prefix, window_minima

LENGTH, GRAM = 400, 48
#: Bytes of a string from which on it is reported as shared with another document.
LEAST = 256
#: Bytes of stretches that are put in suffix order at once.
CHUNK = 500_000
#: Distinct stretches of a group beyond which it is matched by a shuffle.
LARGE = 20_000
PLACE_BITS = 31


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start in the text, windows, gram hash, content hash) of every stretch."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    n, gram = len(data), min(gram, least)
    if n < least:
        return none
    sums = prefix(BYTE_CODES[data])
    grams = mix((sums[gram:] - sums[: n - gram + 1]) * powers(BASE_INVERSE, n - gram + 1))
    low = U((1 << PLACE_BITS) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=U)
    minima = window_minima(keyed, least - gram + 1)
    inside = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    long = sizes >= least
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - least + 1, -1)
    valid = np.cumsum(inside)[: len(minima)] > 0
    new = np.ones(len(minima), bool)
    new[1:] = (minima[1:] != minima[:-1]) | ~valid[:-1]
    new[offsets[:-1][long]] = True
    starts = np.flatnonzero(new & valid)
    if not len(starts):
        return none
    change = np.flatnonzero(new | ~valid)
    after = np.searchsorted(change, starts, "right")
    ends = np.append(change, len(minima))[after]
    text = np.searchsorted(offsets, starts, "right") - 1
    windows = ends - starts
    content = mix(between(sums, starts, np.minimum(ends + length - 1, offsets[text + 1])) ^ windows.astype(U))
    anchor = grams[(minima[starts] & low).astype(np.int64)]
    return text, starts - offsets[text], windows, anchor, content


def occurrences(docs: DataFrame, names: list[str], length: int, least: int) -> DataFrame:
    """(names, start, windows, g, s) of every stretch of every text."""
    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            text, start, windows, anchor, content = stretches(*utf8_of(part["text"]), length, least)
            at = pa.array(text)
            yield pa.record_batch(
                [*(part[c].take(at) for c in names), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                [*names, "start", "windows", "g", "s"],
            )

    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, start int, windows int, g bigint, s bigint")


class Suffixes:
    """Ranks of the suffixes of several texts by their first 8, 16, 32 ... bytes, the end of a text unlike all else."""

    def __init__(self, texts: list[np.ndarray], length: int):
        ends = np.cumsum([len(x) + 1 for x in texts])
        n = int(ends[-1])
        self.starts = np.concatenate([[0], ends[:-1]])
        self.data = np.zeros(n + 8, np.int16)
        for x, a in zip(texts, self.starts.tolist(), strict=True):
            self.data[a : a + len(x)] = x
        self.data[ends - 1] = -1
        self.data[n:] = -1
        self.length = length
        packed, over = np.zeros(n, U), np.zeros(n, bool)
        for j in range(8):
            sign = self.data[j : j + n]
            over |= sign < 0
            packed = (packed << U(8)) | np.where(over, 0, sign).astype(U)
        alone = np.where(over, np.arange(1, n + 1), 0)
        order = np.lexsort((alone, packed))
        changed = (packed[order][1:] != packed[order][:-1]) | (alone[order][1:] != alone[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changed)])
        self.levels = [(8, rank)]
        while 2 * self.levels[-1][0] <= length:
            done, rank = self.levels[-1]
            after = np.zeros(n, np.int64)
            after[: max(n - done, 0)] = rank[done:] + 1
            self.levels.append((2 * done, np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)))

    def order(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The suffixes ``at`` by their first ``length`` bytes, equal ones by place."""
        done, rank = self.levels[-1]
        tail = rank[np.minimum(at + max(self.length - done, 0), len(rank) - 1)]
        return np.lexsort((places, tail, rank[at]))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes a and b have in common, ``length`` at most."""
        a, b, n = a.copy(), b.copy(), len(self.levels[0][1])
        found = np.zeros(len(a), np.int64)
        for step, rank in self.levels[::-1]:
            same = (a < n) & (b < n)
            same[same] = rank[a[same]] == rank[b[same]]
            found += step * same
            a, b = a + step * same, b + step * same
        live = np.ones(len(a), bool)
        for _ in range(7):
            x, y = self.data[np.minimum(a, n)], self.data[np.minimum(b, n)]
            live &= (x == y) & (x >= 0)
            found += live
            a, b = a + live, b + live
        return np.minimum(found, self.length)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1.

    A candidate that is not smaller passes its own candidate on; all do so at
    once, so the steps double.
    """
    before = np.arange(len(values)) - 1
    open_ = np.arange(1, len(values))
    while True:
        open_ = open_[values[before[open_]] >= values[open_]]
        if not len(open_):
            return before
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]


def longest_previous_factors(suffixes: Suffixes, at: np.ndarray, order: np.ndarray, places: np.ndarray, asked: np.ndarray | bool = True) -> np.ndarray:
    """For each suffix ``at`` the bytes it has in common with any one at an earlier place, ``length`` at most; 0 if not asked.

    Of all earlier ones the nearest in suffix order, on either side, have most in common with it.
    """
    asked = np.broadcast_to(asked, len(at))[order]
    own, ranked = at[order], places[order]
    found = np.zeros(len(at), np.int64)
    sides = (nearest_smaller(ranked), len(at) - 1 - nearest_smaller(ranked[::-1])[::-1])
    for near in sides:
        has = np.flatnonzero(asked & (near >= 0) & (near < len(at)))
        found[has] = np.maximum(found[has], suffixes.shared(own[has], own[near[has]]))
    out = np.empty(len(at), np.int64)
    out[order] = found
    return out


def longest_elsewhere(suffixes: Suffixes, at: np.ndarray, order: np.ndarray, owner: np.ndarray, asked: np.ndarray | bool = True) -> np.ndarray:
    """For each suffix ``at`` the bytes it has in common with any one of another owner; 0 if not asked."""
    asked = np.broadcast_to(asked, len(at))[order]
    own, label = at[order], owner[order]
    new = np.concatenate([[True], label[1:] != label[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    last = np.minimum.accumulate(np.where(np.append(new[1:], True), np.arange(len(at)), len(at))[::-1])[::-1]
    found = np.zeros(len(at), np.int64)
    for near in (first - 1, last + 1):
        has = np.flatnonzero(asked & (near >= 0) & (near < len(at)))
        found[has] = np.maximum(found[has], suffixes.shared(own[has], own[near[has]]))
    out = np.empty(len(at), np.int64)
    out[order] = found
    return out


RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
RANGES_SQL = "array<struct<a:bigint,b:bigint>>"


def ranges_of(flags: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each i the ranges [a, b) of flags[first[i]:first[i+1]] that are set, counted from first[i]."""
    before = np.concatenate([[False], flags[:-1]])
    before[first[:-1]] = False
    after = np.concatenate([flags[1:], [False]])
    after[first[1:] - 1] = False
    starts, ends = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    base = first[np.searchsorted(first, starts, "right") - 1]
    each = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, first).astype(np.int32)), each).cast(RANGES)


def decide(rows: list[tuple], length: int, least: int, keep_first: bool) -> pa.RecordBatch:
    """From the first place of each distinct stretch: passages to remove, and windows that other documents hold.

    rows: (g, s, times it occurs, least and greatest key of its documents, place of its first occurrence, windows, bytes).
    """
    texts = [np.frombuffer(r[7], np.uint8) for r in rows]
    times, low, high = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    several = low != high
    order = sorted(range(len(rows)), key=lambda i: tuple((x is not None, x) for x in rows[i][5]))
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    # a stretch of several documents is like no one's
    label = np.unique(low, return_inverse=True)[1] + 0
    label[several] = len(rows) + np.arange(int(several.sum()))
    sizes, windows = np.array([len(t) for t in texts]), np.array([r[6] for r in rows])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(rows)), windows)
    first = np.concatenate([[0], np.cumsum(windows)])
    within = np.arange(first[-1]) - first[owner]
    whole = sizes[owner] - within >= length
    remove = (times > 1)[owner] & whole & (not keep_first)
    elsewhere = several[owner]
    # only windows whose hash recurs can match; suffix order settles how far
    starts = offsets[owner] + within
    hashes = between(prefix(BYTE_CODES[np.concatenate(texts)]), starts, starts + least)
    by_hash = np.argsort(hashes, kind="stable")
    twin = np.zeros(len(hashes), bool)
    same = hashes[by_hash][1:] == hashes[by_hash][:-1]
    twin[by_hash[1:]] |= same
    twin[by_hash[:-1]] |= same
    index = np.flatnonzero(twin)
    if len(index):
        used, k = np.unique(owner[index], return_inverse=True)
        lowest = np.full(len(used), windows.max())
        np.minimum.at(lowest, k, within[index])
        highest = np.zeros(len(used), np.int64)
        np.maximum.at(highest, k, within[index])
        suffixes = Suffixes([texts[i][a : b + length] for i, a, b in zip(used, lowest, highest, strict=True)], length)
        at = suffixes.starts[k] + within[index] - lowest[k]
        places = place[owner[index]] * (1 << 32) + within[index]
        ranked = suffixes.order(at, places)
        asked = (whole & ~remove)[index]
        factor = longest_previous_factors(suffixes, at, ranked, places, asked)
        if not keep_first:
            factor = np.maximum(factor, longest_previous_factors(suffixes, at, ranked, -places, asked & (factor < length)))
        remove[index] |= factor >= length
        elsewhere[index] |= longest_elsewhere(suffixes, at, ranked, label[owner[index]], ~elsewhere[index]) >= least
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), ranges_of(remove, first), ranges_of(elsewhere, first)], ["g", "s", "ranges", "elsewhere"])


def decisions(hard: DataFrame, docs: DataFrame, length: int, least: int, keep_first: bool, large: int = LARGE) -> DataFrame:
    """(g, s, ranges, elsewhere) of the distinct stretches in ``hard`` (g, s, times, low, high, variants, first, windows)."""
    kept = ["g", "s", "times", "low", "high", "variants", "windows", "first"]
    flat = hard.select(*kept, F.col("first.key").alias("key"), F.col("first.size").alias("size"))
    by_doc = flat.groupBy("key", "size").agg(F.collect_list(F.struct(*kept)).alias("wanted"))
    # rows equal in doc_id and text share a key; one of them is enough
    carried = docs.select("key", "size", "text").join(by_doc, ["key", "size"])
    first_type = hard.schema["first"].dataType.simpleString()
    place_type = pa.struct([("doc_id", pa.int64() if "doc_id:bigint" in first_type else pa.string()), ("key", pa.int64()), ("size", pa.int32()), ("start", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            data, offsets = utf8_of(part["text"])
            raw = data.tobytes()
            rows = []
            for i, wanted in enumerate(part["wanted"].to_pylist()):
                for w in wanted:
                    a = int(offsets[i]) + w["first"]["start"]
                    rows.append((*(w[c] for c in kept), raw[a : min(a + w["windows"] + length - 1, int(offsets[i + 1]))]))
            if rows:
                kinds = [pa.int64()] * 6 + [pa.int32(), place_type, pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*kept, "data"])

    texts = carried.mapInArrow(cut, f"g bigint, s bigint, times bigint, low bigint, high bigint, variants bigint, windows int, first {first_type}, data binary").dropDuplicates(["g", "s"])
    small = texts.where(F.col("variants") <= large)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for g, s, times, low, high, first, windows, data in zip(*(batch[c].to_pylist() for c in ("g", "s", "times", "low", "high", "first", "windows", "data")), strict=True):
                if size >= CHUNK and g != held[-1][0]:
                    yield decide(held, length, least, keep_first)
                    held, size = [], 0
                held.append((g, s, times, low, high, tuple(first.values()), windows, data))
                size += len(data)
        if held:
            yield decide(held, length, least, keep_first)

    kinds = f"g bigint, s bigint, ranges {RANGES_SQL}, elsewhere {RANGES_SQL}"
    return small.repartition("g").sortWithinPartitions("g").mapInArrow(order, kinds).unionByName(_by_shuffle(texts.where(F.col("variants") > large), length, least, keep_first))


def _by_shuffle(texts: DataFrame, length: int, least: int, keep_first: bool) -> DataFrame:
    """The same decisions, each window and passage a row: for groups too large for one task."""
    kept = ["g", "s", "times", "low", "high", "first"]

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (data, windows) in enumerate(zip(batch["data"].to_pylist(), batch["windows"].to_pylist(), strict=True)):
                own = np.frombuffer(data, np.uint8)
                sums = prefix(BYTE_CODES[own])
                for size in (least, length):
                    at = np.arange(min(windows, len(own) - size + 1))
                    hashes = between(sums, at, at + size)
                    take = pa.array(np.full(len(at), i))
                    yield pa.record_batch([*(batch[c].take(take) for c in kept), pa.array(np.full(len(at), size == length)), pa.array(at), pa.array(hashes.view(np.int64))], [*kept, "whole", "at", "h"])

    first_type = texts.schema["first"].dataType.simpleString()
    rows = texts.mapInArrow(passages, f"g bigint, s bigint, times bigint, low bigint, high bigint, first {first_type}, whole boolean, at bigint, h bigint")
    place = F.struct("first", "at")
    known = rows.groupBy("whole", "h").agg(F.sum("times").alias("n"), F.min(place).alias("least"), F.min("low").alias("_low"), F.max("high").alias("_high"))
    met = rows.join(known.where("n > 1"), ["whole", "h"])
    one = F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    removed = F.col("whole") & (F.col("least") != place if keep_first else F.lit(True))
    return met.groupBy("g", "s").agg(F.collect_list(F.when(removed, one)).alias("ranges"), F.collect_list(F.when(~F.col("whole") & (F.col("_low") != F.col("_high")), one)).alias("elsewhere"))


def removed_ranges(docs: DataFrame, length: int = LENGTH, keep: str = "none", large: int = LARGE, least: int = LEAST) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``_annalist_removed`` and ``_annalist_shared``.

    Both are byte ranges [a, b), sorted, some overlapping (see ``merge``): what
    is removed, and what stands in strings of ``least`` bytes that another document holds too.
    """
    keep_first, least = {"first": True, "none": False}[keep], min(least, length)
    key, size = F.xxhash64("doc_id", "text"), F.coalesce(F.octet_length("text"), F.lit(0))
    keyed = docs.select("doc_id", "text", key.alias("key"), size.alias("size"))
    id_type = docs.schema["doc_id"].dataType
    found = materialise(occurrences(keyed, ["doc_id", "key", "size"] if keep_first else ["key", "size"], length, least))
    place = F.struct("doc_id", "key", "size", "start") if keep_first else None
    spread = [F.count("*").alias("times"), F.min("key").alias("low"), F.max("key").alias("high")]
    if keep_first:
        distinct = found.groupBy("g", "s").agg(*spread, F.min(place).alias("first"), F.min("windows").alias("windows"))
    else:
        # any occurrence will do: all are non-null numbers of one row
        any_of = [F.first(c).alias(c) for c in ("key", "size", "start", "windows")]
        distinct = found.groupBy("g", "s").agg(*spread, *any_of)
        distinct = distinct.select("g", "s", "times", "low", "high", F.struct(F.lit(None).cast(id_type).alias("doc_id"), "key", "size", "start").alias("first"), "windows")
    groups = distinct.groupBy("g").agg(F.count("*").alias("variants"), F.sum("times").alias("total")).where("total > 1")
    known = materialise(distinct.join(groups, "g"))
    hard = known.where("variants > 1")
    none = F.array().cast(RANGES_SQL)
    upto = lambda n: F.when(n > 0, F.array(F.struct(F.lit(0).cast("bigint").alias("a"), n.cast("bigint").alias("b")))).otherwise(none)
    # passages that start in a stretch: fewer than its windows where the text ends
    whole = lambda size, start: F.least(F.col("windows"), size - start - length + 1)
    everywhere = F.when(F.col("low") != F.col("high"), upto(F.col("windows"))).otherwise(none)
    equal = known.where("variants = 1").select("g", "s", upto(whole(F.col("first.size"), F.col("first.start"))).alias("ranges"), everywhere.alias("elsewhere"), "first", F.lit(True).alias("equal"))
    decided = hard.select("g", "s", "first").join(decisions(hard, keyed, length, least, keep_first, large), ["g", "s"], "left")
    decided = decided.select("g", "s", F.coalesce("ranges", none).alias("ranges"), F.coalesce("elsewhere", none).alias("elsewhere"), "first", F.lit(False).alias("equal"))
    verdict = equal.unionByName(decided)
    verdict = materialise(verdict if keep_first else verdict.drop("first", "equal").where("size(ranges) > 0 or size(elsewhere) > 0"))
    met = found.join(verdict, ["g", "s"])
    if keep_first:
        later = F.when(F.col("first") != place, upto(whole(F.col("size"), F.col("start"))))
        met = met.withColumn("ranges", F.coalesce(later, F.when(F.col("equal"), none), F.col("ranges")))
    moved = lambda c, n: F.transform(c, lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start") + n - 1).alias("b")))
    together = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)
    per_doc = met.select("key", "size", moved("ranges", length).alias("ranges"), moved("elsewhere", least).alias("elsewhere")).groupBy("key", "size").agg(together("ranges"), together("elsewhere"))
    own = docs.withColumn("_annalist_key", key).withColumn("_annalist_size", size)
    right = per_doc.select(F.col("key").alias("_annalist_key"), F.col("size").alias("_annalist_size"), F.col("ranges").alias("_annalist_removed"), F.col("elsewhere").alias("_annalist_shared"))
    return own.join(right, ["_annalist_key", "_annalist_size"], "left").select(*docs.columns, "_annalist_removed", "_annalist_shared")


def merge(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in ranges or ():
        if out and r["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["b"])
        else:
            out.append([r["a"], r["b"]])
    return [(a, b) for a, b in out]


def cut_text(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in removed:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def dedup_digests(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shared of each document.

    n_shared: bytes in strings of ``LEAST`` bytes or more that another document holds too, removed or not.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            data, offsets = utf8_of(part["text"])
            raw = data.tobytes()
            rows = []
            for i, (ranges, shared) in enumerate(zip(part["_annalist_removed"].to_pylist(), part["_annalist_shared"].to_pylist(), strict=True)):
                own = raw[offsets[i] : offsets[i + 1]]
                spans = merge(ranges)
                kept = cut_text(own, spans)
                rows.append((len(own), len(own) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in merge(shared))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([part["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

    found = removed_ranges(docs.select("doc_id", "text"), length, keep)
    return found.mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared bigint")


def deduplicate(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; letters cut in half are dropped with them."""
    found = removed_ranges(docs, length, keep)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = []
            for text, ranges in zip(part["text"].to_pylist(), part["_annalist_removed"].to_pylist(), strict=True):
                texts.append(cut_text(text.encode(), merge(ranges)).decode("utf-8", "ignore") if ranges else text)
            yield pa.record_batch([pa.array(texts, part["text"].type) if n == "text" else part[n] for n in names], names)

    return found.mapInArrow(run, docs.schema)
