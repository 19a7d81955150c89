"""Best-fit packing of token pieces by a configuration linear program.

1. Every text becomes token ids plus one end id; texts longer than a sequence
   are cut from the end, so only the first piece may be shorter.
2. The histogram of piece lengths (one count for each length up to the
   capacity) is all that packing decisions need.  Over it a covering program is
   solved: how often to use each configuration, a multiset of lengths that fits
   a sequence.  Multiplicative weights price the lengths, a knapsack dynamic
   program finds the dearest configurations, their use is raised by a part of
   what is left to cover, and the prices of what they cover fall.
3. Uses are rounded, down and by largest remainders, and what that leaves
   uncovered is placed best-fit decreasing, over counts of lengths again.
4. Pieces of a length take the slots of that length in the order of their rank,
   which is counted in salted groups, so that a common length is no hot key.

Only the histogram and the plan, both bounded by the capacity, reach the driver.

Nulls and oddities: a null text is an empty one and is the end id alone;
repeated rows are packed each for itself; a null doc_id is kept; an empty table
gives no rows; special token strings inside texts are ordinary text.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import materialise, shuffle_partitions, text_slices

CAPACITY, END_ID = 2048, 0
#: Words whose ids a worker remembers, at most.
REMEMBERED = 400_000
ODD_SPACE = re.compile(r"[^\S \n]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokenizer:
    """Ids of a byte-level BPE file as little-endian bytes, word by word where that is the same.

    The vocabulary's pattern ends a token before every single space or line
    feed between two other characters, so texts without further white space can
    be taken apart there, and the ids of words be remembered.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in t): i for t, i in vocabulary.items() if all(c in signs for c in t) and not re.fullmatch(r"<\|.*\|>", t)}
        self.coding = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.spaced = Remembered(self, ""), Remembered(self, " ")

    def whole(self, text: str) -> bytes:
        return np.array(self.coding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or ODD_SPACE.search(text):
            return self.whole(text)
        out = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.plain["\n"])
            words = line.split(" ")
            out.append(self.plain[words[0]])
            out.extend(map(self.spaced.__getitem__, words[1:]))
        return b"".join(out)


class Remembered(dict):
    def __init__(self, tokenizer: Tokenizer, before: str):
        super().__init__()
        self.tokenizer, self.before = tokenizer, before

    def __missing__(self, word: str) -> bytes:
        ids = self.tokenizer.whole(self.before + word)
        if len(word) < 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


def byte_signs() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def cut_points(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids; only the first may be short."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)]
    return [(s, (starts[i + 1] if i + 1 < len(starts) else length) - s) for i, s in enumerate(starts)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``with_ids``: its ids as bytes too."""
    path = path or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = tokenizer(path)
        for part in text_slices(batches):
            owner, rows, kept = [], [], []
            for i, text in enumerate(part["text"].to_pylist()):
                ids = coding(text or "") + end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    owner.append(i)
                    rows.append((k, start, length, zlib.crc32(own)))
                    if with_ids:
                        kept.append(own)
            values = np.array(rows, np.int64).reshape(-1, 4)
            columns = [part["doc_id"].take(pa.array(owner, pa.int64())), *map(pa.array, values.T.copy())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*columns, pa.array(kept, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    narrow = schema.replace("piece int", "piece bigint")
    return docs.select("doc_id", "text").mapInArrow(run, narrow).withColumn("piece", F.col("piece").cast("int"))


@dataclass
class Plan:
    """Slots by length: those of run i of a length hold ranks from ``first``, ``each`` in a sequence."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks from 0 within a length."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for s in np.unique(lengths):
            mine = lengths == s
            first, each, base, at = self.runs[int(s)]
            i = np.searchsorted(first, ranks[mine], "right") - 1
            copy, place = np.divmod(ranks[mine] - first[i], each[i])
            sequence[mine], offset[mine] = base[i] + copy, at[i] + place * s
        return sequence, offset


def dearest(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, choice) by room: the greatest total price that fits, and the index of a length in it, -1 for none.

    A knapsack by dynamic programming; of lengths that are worth as much, the longest.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    limits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    back, worth = sizes[::-1].copy(), prices[::-1].copy()
    for c in range(int(sizes[0]), capacity + 1):
        skip = len(sizes) - limits[c]
        values = best[c - back[skip:]] + worth[skip:]
        i = int(values.argmax())
        if values[i] > best[c - 1]:
            best[c], choice[c] = values[i], limits[c] - 1 - i
        else:
            best[c], choice[c] = best[c - 1], -1
    return best, choice


def relaxation(sizes: np.ndarray, wanted: np.ndarray, capacity: int, rounds: int, step: float = 0.5, rate: float = 8.0, slack: float = 0.004, bend: float = 2.0) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional uses of configurations that cover no length more than wanted, and nearly all of it after enough rounds.

    Prices start at the lengths' shares of the capacity to the power of ``bend``
    (so that long pieces come before short ones, which fit anywhere) and fall by
    a factor exp(-rate * share covered) as a length is covered.  One pricing gives the
    dearest configuration around each length; those that cost next to as much
    as the dearest of all are used by a part of what is left to cover.
    """
    covered = np.zeros(len(sizes))
    uses: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        live = np.flatnonzero(covered < 0.99)
        if not len(live):
            break
        own = sizes[live]
        prices = (own / capacity) ** bend * np.exp(-rate * covered[live])
        best, choice = dearest(prices, own, capacity)
        around = prices + best[capacity - own]
        for i in np.flatnonzero(around >= (1 - slack) * around.max())[::-1].tolist():
            config, room = {i: 1}, capacity - int(own[i])
            while room > 0:
                if (j := int(choice[room])) < 0:
                    room -= 1
                else:
                    config[j] = config.get(j, 0) + 1
                    room -= int(own[j])
            at, counts = live[list(config)], np.array(list(config.values()))
            amount = step * float(((1 - covered[at]) * wanted[at] / counts).min())
            if amount > 0:
                key = tuple(sorted(zip(sizes[at].tolist(), counts.tolist(), strict=True)))
                uses[key] = uses.get(key, 0.0) + amount
                covered[at] += amount * counts / wanted[at]
    return uses


def rounded(uses: dict[tuple[tuple[int, int], ...], float], left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses: each rounded down, then by the largest remainders one more of those
    that leave no room, as long as what is ``left`` allows it."""
    plan: dict[tuple[tuple[int, int], ...], int] = {}
    by_use = [(config, int(x + 1e-9)) for config, x in sorted(uses.items(), key=lambda u: (-u[1], u[0]))]
    full = [(config, x) for config, x in uses.items() if sum(s * k for s, k in config) == capacity]
    by_rest = [(config, 1) for config, x in sorted(full, key=lambda u: (int(u[1] + 1e-9) - u[1], u[0]))]
    for config, most in (*by_use, *by_rest):
        n = min(most, min(left[s] // k for s, k in config))
        if n > 0:
            plan[config] = plan.get(config, 0) + n
            for s, k in config:
                left[s] -= n * k
    return [(dict(config), n) for config, n in plan.items()]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 300) -> list[tuple[dict[int, int], int]]:
    """(configuration, uses in whole numbers) that together cover the histogram exactly.

    The program is rounded after all, half and a quarter of the rounds, which
    leave more and more to best fit; the fewest sequences win.
    """
    wanted = {s: n for s, n in sorted(histogram.items()) if n > 0}
    # lengths that fill a sequence alone need no pricing
    whole = [({capacity: 1}, wanted.pop(capacity))] if capacity in wanted else []
    if not wanted:
        return whole
    sizes, counts = (np.array(c) for c in zip(*wanted.items(), strict=True))
    plans = []
    for most in (rounds, rounds // 2, rounds // 4):
        left = dict(wanted)
        plan = rounded(relaxation(sizes, counts.astype(float), capacity, most), left, capacity)
        plans.append(plan + best_fit({s: n for s, n in left.items() if n}, capacity))
    return whole + min(plans, key=lambda plan: sum(n for _, n in plan))


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts: sequences of equal content are one entry, whatever their number."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            room = min((r for r in rooms if r >= s), default=None)
            config, m = rooms[room].pop() if room is not None else ({}, n)
            if room is not None and not rooms[room]:
                del rooms[room]
            r = capacity if room is None else room
            each = min(r // s, n)
            filled = min(m, n // each)
            if room is not None and m > filled:
                rooms.setdefault(r, []).append((config, m - filled))
            rooms.setdefault(r - each * s, []).append((config | {s: each}, filled))
            n -= each * filled
    return [entry for r in sorted(rooms) for entry in rooms[r]]


def lay_out(configurations: list[tuple[dict[int, int], int]]) -> Plan:
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for config, n in configurations:
        at = 0
        for s in sorted(config, reverse=True):
            runs.setdefault(s, []).append((taken.get(s, 0), config[s], base, at))
            taken[s] = taken.get(s, 0) + n * config[s]
            at += s * config[s]
        base += n
    return Plan({s: tuple(np.array(c) for c in zip(*r, strict=True)) for s, r in runs.items()}, base)


def pack(tokenized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``tokenized`` with sequence_id and offset, gapless from 0 in every sequence.

    ``tokenized`` is a fixed table of pieces (see ``materialise``): it is read
    once for the histogram and once for the places.
    """
    histogram = {int(r["length"]): int(r["count"]) for r in tokenized.groupBy("length").count().collect()}
    plan = lay_out(solve(histogram, capacity))
    salts = shuffle_partitions(tokenized.sparkSession)
    order = ["doc_id", "piece", "ids_crc32"]
    salted = tokenized.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "_salt").count()
    starts = counts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = salted.join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    names = tokenized.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                sequence, offset = plan.place(part["length"].to_numpy(), part["_rank"].to_numpy())
                yield pa.record_batch([*(part[n] for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokenized.schema)
    return ranked.select(*names, "_rank").mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed pieces of all documents; tokenized once, into the shared folder."""
    return pack(materialise(pieces(docs, path, capacity)), capacity)
