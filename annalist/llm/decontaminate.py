"""Benchmark decontamination by winnowing.

Fingerprints are the least hashes of 5-word grams in every 6 of them in a row,
of the benchmark's items and of the documents alike.  Any 10 words that an item
and a document share hold 6 such grams, so both keep the same least one: every
shared span of 10 words shares a fingerprint.  Documents that share any are
then extended: all their 10-word windows are looked up among the windows of the
items, which gives the words hit and the items found.

An item of fewer than 10 words has one window, itself; for these lengths the
windows of the documents are looked up directly.

The benchmark's fingerprints and windows go to the executors whole only while
there are at most ``bound`` of them.  Beyond that the fingerprints are joined
by a shuffle, and each document is extended against only the items that share
a fingerprint with it.

Nulls and oddities: a null text has no words; an item without words is no
window; repeated rows each get their own equal row; repeated items count once
by item_id, and each distinct id by itself; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import text_slices, utf8_of
from annalist.llm.textkit import ALPHANUMERIC, Words, window_minima

WINDOW, GRAM = 10, 5
#: Windows of the benchmark that are sent to the executors whole, at most (16 bytes each).
BOUND = 2_000_000


def windows_of(words: Words, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, length, hash) of every window of each text."""
    texts = np.arange(len(words.counts))
    parts = []
    for n in np.unique(np.minimum(words.counts[words.counts > 0], size)):
        at, hashes = words.ngrams(int(n))
        owner = np.searchsorted(words.first, at, "right") - 1
        mine = np.minimum(words.counts[owner], size) == n
        parts.append((texts[owner[mine]], np.full(mine.sum(), n), hashes[mine]))
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def fingerprints(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the winnowed grams of every text that has ``window`` words."""
    at, hashes = words.ngrams(gram)
    owner = np.searchsorted(words.first, at, "right") - 1
    width = window - gram + 1
    if len(hashes) < width:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    least = window_minima(hashes, width)
    inside = owner[: len(least)] == owner[width - 1 :]
    least, whose = least[inside], owner[: len(inside)][inside]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (whose[1:] != whose[:-1])
    return whose[fresh], least[fresh]


class Index:
    """Sorted windows of items: hashes[length], and the items of each."""

    def __init__(self, items: np.ndarray, lengths: np.ndarray, hashes: np.ndarray):
        self.by_length = {}
        for n in np.unique(lengths):
            order = np.lexsort((items[lengths == n], hashes[lengths == n]))
            self.by_length[int(n)] = (hashes[lengths == n][order], items[lengths == n][order])

    def hits(self, words: Words, only: np.ndarray | None = None) -> tuple[np.ndarray, list[set]]:
        """(words hit, items found) in each text; ``only``: which texts to look into for full windows."""
        total = int(words.first[-1])
        cover = np.zeros(total + 1, np.int64)
        found: list[set] = [set() for _ in words.counts]
        for n, (hashes, items) in self.by_length.items():
            at, mine = words.ngrams(n)
            owner = np.searchsorted(words.first, at, "right") - 1
            if only is not None and n == WINDOW:
                keep = only[owner]
                at, mine, owner = at[keep], mine[keep], owner[keep]
            low = np.searchsorted(hashes, mine)
            hit = hashes[np.minimum(low, len(hashes) - 1)] == mine
            at, owner, low = at[hit], owner[hit], low[hit]
            cover += np.bincount(at, minlength=total + 1) - np.bincount(at + n, minlength=total + 1)
            owner, low = np.divmod(np.unique(owner * len(hashes) + low), len(hashes))
            high = np.searchsorted(hashes, hashes[low], "right")
            for d, a, b in zip(owner.tolist(), low.tolist(), high.tolist(), strict=True):
                found[d].update(items[a:b].tolist())
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:total]) > 0)])
        return covered[words.first[1:]] - covered[words.first[:-1]], found


def rows_of(ids: pa.Array, words: Words, hit: np.ndarray, found: list[set]) -> pa.RecordBatch:
    names = [sorted(map(str, f)) for f in found]
    return pa.record_batch(
        [
            ids,
            pa.array(words.counts.astype(np.int64)),
            pa.array(hit.astype(np.int64)),
            pa.array([len(f) for f in names], pa.int64()),
            pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for f in names], pa.string()),
            pa.array([sorted(f) for f in found], pa.list_(pa.int64())),
            pa.array(hit > 0),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"],
    )


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, items array<bigint>, contaminated boolean"


def words_of(texts: pa.Array) -> Words:
    return Words(*utf8_of(texts), ALPHANUMERIC)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, hash, print) of the benchmark: windows, and fingerprints (print true, length 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = words_of(part["text"])
            at, lengths, hashes = windows_of(words)
            whose, prints = fingerprints(words)
            yield pa.record_batch(
                [
                    part["item_id"].take(pa.array(np.concatenate([at, whose]))),
                    pa.array(np.concatenate([lengths, np.zeros(len(whose), int)]).astype(np.int32)),
                    pa.array(np.concatenate([hashes, prints]).view(np.int64)),
                ],
                ["item_id", "length", "hash"],
            )

    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")
    return rows.mapInArrow(run, "item_id bigint, length int, hash bigint").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated of each document."""
    windows = benchmark_windows(benchmark)
    if windows.count() > bound:
        return _by_join(docs, benchmark, windows)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    search = searcher(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield rows_of(part["doc_id"], *search(part["text"]))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {RESULT}")


def searcher(windows: DataFrame):
    """A function from texts to (words, words hit, items found); ``windows`` is within the bound."""
    got = windows.toPandas()
    items, lengths = got["item_id"].to_numpy(np.int64), got["length"].to_numpy(np.int64)
    hashes = got["hash"].to_numpy(np.int64).view(np.uint64)
    index = Index(items[lengths > 0], lengths[lengths > 0], hashes[lengths > 0])
    prints = np.unique(hashes[lengths == 0])

    def search(texts: pa.Array) -> tuple[Words, np.ndarray, list[set]]:
        words = words_of(texts)
        whose, mine = fingerprints(words)
        shares = np.zeros(len(words.counts), bool)
        if len(prints):
            place = np.minimum(np.searchsorted(prints, mine), len(prints) - 1)
            shares[whose[prints[place] == mine]] = True
        return (words, *index.hits(words, shares))

    return search


def _by_join(docs: DataFrame, benchmark: DataFrame, windows: DataFrame) -> DataFrame:
    """The same rows for a benchmark of any size: fingerprints meet in a shuffle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").withColumn("_text_key", F.xxhash64("text"))
    short = [r["length"] for r in windows.where(f"length between 1 and {WINDOW - 1}").select("length").distinct().orderBy("length").collect()]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = words_of(part["text"])
            whose, hashes = fingerprints(words)
            parts = [(whose, hashes, np.zeros(len(whose), int))]
            for n in short:
                at, mine = words.ngrams(n)
                parts.append((np.searchsorted(words.first, at, "right") - 1, mine, np.full(len(at), n)))
            whose, hashes, lengths = (np.concatenate(p) for p in zip(*parts, strict=True))
            at = pa.array(whose)
            yield pa.record_batch(
                [part["doc_id"].take(at), part["_text_key"].take(at), pa.array(hashes.view(np.int64)), pa.array(lengths.astype(np.int32))],
                ["doc_id", "_text_key", "hash", "length"],
            )

    marked = rows.mapInArrow(prints, f"doc_id {id_type}, _text_key bigint, hash bigint, length int").distinct()
    pairs = marked.join(windows.where(f"length < {WINDOW}"), ["hash", "length"]).select("doc_id", "_text_key", "item_id").distinct()
    with_text = pairs.join(benchmark.select("item_id", F.col("text").alias("item")), "item_id")
    keys = with_text.groupBy("doc_id", "_text_key").agg(F.sort_array(F.collect_list(F.struct("item_id", "item"))).alias("with"))
    right = keys.select(F.col("doc_id").alias("_d"), F.col("_text_key").alias("_k"), "with")
    met = rows.join(right, rows["doc_id"].eqNullSafe(right["_d"]) & rows["_text_key"].eqNullSafe(right["_k"]), "left").select("doc_id", "text", "with")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            for i in range(part.num_rows):
                mine = part["with"][i].as_py() or []
                own = windows_of(words_of(pa.array([m["item"] for m in mine], pa.string())))
                ids = np.array([m["item_id"] for m in mine], np.int64)
                words = words_of(part["text"].slice(i, 1))
                yield rows_of(part["doc_id"].slice(i, 1), words, *Index(ids[own[0]], own[1], own[2]).hits(words))

    return met.mapInArrow(run, f"doc_id {id_type}, {RESULT}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, bound: int = BOUND) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark, all their columns kept."""
    windows = benchmark_windows(benchmark)
    if windows.count() > bound:
        key = F.xxhash64("doc_id", "text")
        found = _by_join(docs.select(key.alias("doc_id"), "text"), benchmark, windows)
        hit = found.where("contaminated").select(F.col("doc_id").alias("_annalist_key")).distinct()
        return docs.withColumn("_annalist_key", key).join(hit, "_annalist_key", "left_anti").select(docs.columns)
    names, search = docs.columns, searcher(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            _, hit, _ = search(part["text"])
            yield part.filter(pa.array(hit == 0)).select(names)

    return docs.mapInArrow(run, docs.schema)
