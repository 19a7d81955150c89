"""Words, n-grams and hashes of many texts at once, in numpy over one Arrow buffer.

Hashes are polynomials modulo 2**64 over a random byte table, read off prefix
sums, so that the cost is a few array passes whatever the n-gram length.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = np.ones(size, U)
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        have = _powers[base] = out
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, from 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[starts:ends], alike wherever the same values stand."""
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts])


def byte_class(*, keep: str = "", drop: str = "", default: bool = False) -> np.ndarray:
    out = np.full(256, default)
    for signs, value in ((keep, True), (drop, False)):
        out[list(signs.encode("latin-1"))] = value
    return out


#: [^\x20\x09-\x0D]
NOT_SPACE = byte_class(drop=" \t\n\x0b\x0c\r", default=True)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text, as A-Z are lowered first
ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


class Words:
    """The words of several texts: ``starts`` and ``ends`` in bytes, ``first[d]`` the first word of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True):
        member = inside[data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = member[:-1], member[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(member & ~before)
        self.ends = np.flatnonzero(member & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        codes = BYTE_CODES[LOWER] if lower else BYTE_CODES
        self.hashes = between(prefix(codes[data]), self.starts, self.ends)
        self.counts = np.diff(self.first)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every n words in a row of one text."""
        starts = ngram_starts(self.first, n)
        return starts, between(self.sums(), starts, starts + n)

    def sums(self) -> np.ndarray:
        if not hasattr(self, "_sums"):
            self._sums = prefix(self.hashes)
        return self._sums


def ngram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Indexes at which n items of one text start; first[d] is the first item of text d."""
    total = int(first[-1])
    ok = np.ones(total, bool)
    for back in range(1, n):
        ends = first[1:] - back
        ok[ends[ends >= first[:-1]]] = False
    return np.flatnonzero(ok)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row (two running minima over blocks)."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
