"""Language-model scores by stupid backoff over counts of hashed n-grams.

The n-grams of one to three words of all documents are counted by hash: a slice
of documents tells each of its n-grams once, with its count there, to the bucket
of the hash.  A bucket adds the counts up and answers every slice that asked.
Each slice then scores its documents.  A word's score is f(n-gram) / f(context)
of the longest n-gram that ends in it and has been seen, times ALPHA for each
word by which the context is shorter than it could be.  A word never seen has
ALPHA once more, over all words and one.

A document is in the counts itself, so by these it never backs off.  Therefore
it is scored twice: by the counts of all documents, and by those of all other
rows, its own occurrences taken off.

Nulls and oddities: a null or wordless text has no words and scores 0; repeated
rows each count and each get their own equal row; a document's first words have
the contexts that there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import shuffle_partitions, text_slices, utf8_of
from annalist.llm.textkit import NOT_SPACE, U, Words, mix

ORDER, ALPHA = 3, 0.4
#: Bits of an n-gram's hash.
BITS = 56
#: N-grams of all slices in a bucket on average; a task holds one bucket's at a time.
BUCKET = 1_000_000
#: N-grams that a slice tells for each byte of text, roughly.
TOLD = 0.29
#: Bytes of text in a slice: the longer, the more repeats are told once.
SLICE = 3_000_000


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of all of them, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(U)


def grams(words: Words, order: int = ORDER) -> list[np.ndarray]:
    """Hashes by order, one for each word: of the n-gram that starts there; of order 0, the same for all.

    Where a text ends before, the hash is of no use and 0.
    """
    total = int(words.first[-1])
    out = [np.full(total, mix(np.array([1], U))[0] >> U(64 - BITS))]
    for n in range(1, order + 1):
        at, hashes = words.ngrams(n)
        mine = np.zeros(total, U)
        mine[at] = mix(hashes + U(n)) >> U(64 - BITS)
        out.append(mine)
    return out


def placed(words: Words, order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(hashes, at, which): sorted hashes of a slice; by order the words that start an n-gram, and its place among the hashes."""
    by_order = grams(words, order)
    left = np.repeat(words.first[1:], words.counts) - np.arange(int(words.first[-1]))
    at = [np.flatnonzero(left >= n) for n in range(order + 1)]
    hashes, which = np.unique(np.concatenate([h[a] for h, a in zip(by_order, at, strict=True)]), return_inverse=True)
    return hashes, at, np.split(which, np.cumsum([len(a) for a in at])[:-1])


def slice_key(part: pa.RecordBatch) -> int:
    """Of the texts of a slice; equal slices share their answers."""
    data, offsets = utf8_of(part["text"])
    digest = hashlib.blake2b(offsets.tobytes(), digest_size=8)
    digest.update(data.tobytes())
    return int.from_bytes(digest.digest(), "little", signed=True)


def scores(words: Words, counts: np.ndarray, at: list[np.ndarray], which: list[np.ndarray], others: bool, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(log score, words backed off) of each text; ``counts`` of the slice's hashes."""
    order, total, texts = len(at) - 1, int(words.first[-1]), len(words.counts)
    owner = np.repeat(np.arange(texts), words.counts)
    place = np.arange(total) - words.first[owner]
    seen = []  # by order, how often the n-gram that starts at a word has been seen
    for n in range(order + 1):
        mine = counts[which[n]].astype(np.int64)
        if others:
            if n == 0:
                mine = mine - words.counts[owner]
            else:
                _, same, own = np.unique(owner[at[n]] * len(counts) + which[n], return_inverse=True, return_counts=True)
                mine = mine - own[same]
        full = np.zeros(total, np.int64)
        full[at[n]] = mine
        seen.append(full)
    could = np.minimum(place + 1, order)
    score = np.log(alpha) * could - np.log(seen[0] + 1.0)
    found = np.zeros(total, np.int64)
    for n in range(1, order + 1):
        ends = np.flatnonzero(place >= n - 1)
        ends = ends[seen[n][ends - n + 1] > 0]
        times = seen[n][ends - n + 1]
        context = seen[n - 1][ends - n + 1] if n > 1 else seen[0][ends]
        score[ends] = np.log(alpha) * (could[ends] - n) + np.log(times / context)
        found[ends] = n
    return np.bincount(owner, score, texts), np.bincount(owner[found < could], minlength=texts)


def lm_scores(docs: DataFrame, alpha: float = ALPHA, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score, log_score_others and n_backoff_others of each document.

    Log scores are sums over the words; n_backoff_others: the words that the
    other documents have not seen in the longest context.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = TOLD * (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = max(1, math.ceil(math.log2(max(told / BUCKET, 2))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, size=SLICE):
            hashes, _, which = placed(Words(*utf8_of(part["text"]), NOT_SPACE), order)
            if not len(hashes):
                continue
            times = np.bincount(np.concatenate(which), minlength=len(hashes))
            bucket = (hashes >> U(BITS - bits)).astype(np.int64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
            ends = np.append(starts[1:], len(hashes))
            pieces = [(packed(np.diff(hashes[a:b], prepend=U(0))), packed(times[a:b])) for a, b in zip(starts, ends, strict=True)]
            yield pa.record_batch(
                [pa.array(bucket[starts]), pa.array(np.full(len(starts), slice_key(part))), pa.array(ends - starts), pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.binary())],
                ["bucket", "slice", "n", "hashes", "times"],
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            hashes = np.concatenate([np.cumsum(unpacked(h, n), dtype=U) for _, n, h, _ in held])
            times = np.concatenate([unpacked(t, n) for _, n, _, t in held]).astype(np.int64)
            sort = np.argsort(hashes, kind="stable")
            ordered = hashes[sort]
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            total = np.empty(len(hashes), np.int64)
            total[sort] = np.repeat(np.add.reduceat(times[sort], new), np.diff(np.append(new, len(hashes))))
            n = np.array([x[1] for x in held])
            data = [packed(x) for x in np.split(total, np.cumsum(n)[:-1])]
            yield pa.record_batch([pa.array([x[0] for x in held], pa.int64()), pa.array([now] * len(held), pa.int64()), pa.array(n), pa.array(data, pa.binary())], ["slice", "bucket", "n", "data"])
            held.clear()

        for batch in batches:
            for bucket, *row in zip(*(batch[c].to_pylist() for c in ("bucket", "slice", "n", "hashes", "times")), strict=True):
                if bucket != now:
                    yield from flush()
                    now = bucket
                held.append(row)
        yield from flush()

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slices' own rows, before those of their buckets."""
        for part in text_slices(batches, size=SLICE):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.record_batch([pa.array([slice_key(part)]), pa.array([-1]), pa.array([0]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "bucket", "n", "data"])

    def scored(texts: list[bytes], answers: dict[int, tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [pa.ipc.open_stream(t).read_next_batch() for t in texts]
        words = Words(*utf8_of(parts[0]["text"]), NOT_SPACE)
        hashes, at, which = placed(words, order)
        counts = np.concatenate([np.zeros(0, U), *(unpacked(d, n) for _, (n, d) in sorted(answers.items()))])
        if len(counts) != len(hashes):
            raise ValueError("the counts of a slice are not those of its n-grams; are the documents the same each time they are read?")
        whole, _ = scores(words, counts, at, which, False, alpha)
        rest, back = scores(words, counts, at, which, True, alpha)
        for part in parts:
            yield pa.record_batch([part["doc_id"], pa.array(words.counts.astype(np.int64)), pa.array(whole), pa.array(rest), pa.array(back.astype(np.int64))], ["doc_id", "n_words", "log_score", "log_score_others", "n_backoff_others"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, answers = None, [], {}
        for batch in batches:
            for own, bucket, n, data in zip(*(batch[c].to_pylist() for c in ("slice", "bucket", "n", "data")), strict=True):
                if own != now:
                    if now is not None:
                        yield from scored(texts, answers)
                    now, texts, answers = own, [], {}
                if bucket < 0:
                    texts.append(data)
                else:
                    answers[bucket] = (n, data)
        if now is not None:
            yield from scored(texts, answers)

    parts = max(shuffle_partitions(spark), 1)
    asked = docs.mapInArrow(emit, "bucket bigint, slice bigint, n bigint, hashes binary, times binary").repartition(parts, "bucket")
    reply = "slice bigint, bucket bigint, n bigint, data binary"
    answers = asked.sortWithinPartitions("bucket").mapInArrow(answer, reply)
    gathered = answers.unionByName(docs.mapInArrow(carry, reply)).repartition(parts, "slice").sortWithinPartitions("slice", "bucket")
    out = gathered.mapInArrow(score, f"doc_id {kind}, n_words bigint, log_score double, log_score_others double, n_backoff_others bigint")
    return out.withColumns({c: F.round(c, 9) for c in ("log_score", "log_score_others")})
