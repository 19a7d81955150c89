"""Secret scans: fixed patterns, and character Markov models of random strings.

The patterns find assigned credentials, access keys and long hexadecimal runs.
Beside them two character-bigram models, one of random strings and one of
ordinary identifiers and words, are trained from labelled samples; a token
whose log-likelihood ratio per character passes a threshold is a secret too.

Nulls and oddities: a null text is scanned as an empty one and stays null when
redacting; repeated rows each get their own equal row; texts are scanned whole,
however long; further columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_ids, text_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
#: Characters of tokens that the models judge, and the fewest of them in one.
TOKEN = re.compile(r"(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
#: Mean log-likelihood ratio per character from which a token is random.
THRESHOLD = 3.0
#: Weight of those shares in a bigram model, in characters seen.
PRIOR = 20.0
#: Documents, random strings and ordinary words that the models learn from, at most.
DOCUMENT_BOUND, SAMPLE_BOUND = 4_000, 20_000

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed in KINDS."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # a greedy run of 16 or more is the whole run, so shorter runs need no match of their own
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass(frozen=True)
class Models:
    """Log ratio of the two bigram models for each pair of ASCII characters."""

    ratio: np.ndarray

    def __call__(self, token: str) -> float:
        codes = np.frombuffer(token.encode("ascii"), np.uint8)
        return float(self.ratio[codes[:-1], codes[1:]].sum() / (len(codes) - 1))


def fit(random_strings: list[str], ordinary: list[str]) -> Models:
    """Bigram models of both samples, smoothed towards the single characters' shares."""
    legal = np.array([bool(re.match(r"[A-Za-z0-9+/_=.-]", chr(c))) for c in range(128)])

    def logs(sample: list[str]) -> np.ndarray:
        counts = np.zeros((128, 128))
        for text in sample:
            codes = np.frombuffer(text.encode("ascii"), np.uint8)
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        single = np.where(legal, counts.sum(axis=0) + 0.5, 0)
        single = single / single.sum()
        return np.log(np.maximum((counts + PRIOR * single) / (counts.sum(axis=1, keepdims=True) + PRIOR), 1e-12))

    return Models(np.where(legal[:, None] & legal[None, :], logs(random_strings) - logs(ordinary), 0.0))


def made_strings(n: int = 3_000, seed: int = 7) -> list[str]:
    """Labelled random strings of the usual alphabets, the same on every run."""
    draw = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"]
    alphabets.append("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    alphabets.append(alphabets[-1] + "+/_-")
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=20 + i % 40)) for i in range(n)]


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(sample, label): values that the patterns find (1) and other words (0) of a bounded set of documents."""
    picked = bounded_ids(docs, "doc_id", DOCUMENT_BOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found: set[tuple[str, int]] = set()
            for text in part["text"].to_pylist():
                text, at = text or "", 0
                rest = []
                for start, end, kind in base_spans(text):
                    value = ASSIGN.match(text, start, end)[2] if kind == "assign" else text[start:end]
                    found.add((value, 1))
                    rest.append(text[at : max(at, start)])
                    at = max(at, end)
                rest.append(text[at:])
                found.update((w, 0) for w in re.findall(r"[A-Za-z][A-Za-z0-9_-]{5,63}", " ".join(rest)))
            rows = sorted(found)
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["sample", "label"])

    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return sample.mapInArrow(run, "sample string, label int").distinct()


def train(docs: DataFrame) -> Models:
    """Both models, from at most SAMPLE_BOUND labelled strings of each kind plus the made ones."""
    samples = labelled_samples(docs)
    ordered = lambda k: samples.where(F.col("label") == k).orderBy(F.xxhash64("sample"), "sample").limit(SAMPLE_BOUND).collect()
    return fit(made_strings() + [r["sample"] for r in ordered(1)], [r["sample"] for r in ordered(0)])


def all_spans(text: str, models: Models, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones, and random tokens that stand in none of them, whole."""
    base = base_spans(text)
    more = []
    for m in TOKEN.finditer(text):
        if models(m[0]) >= threshold and not any(s <= m.start() and m.end() <= e for s, e, _ in base):
            more.append((m.start(), m.end(), "random"))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, models: Models, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            both = [all_spans(t or "", models, threshold) for t in part["text"].to_pylist()]
            columns = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in b[i]] for b in both], SPAN_TYPE) for i in (0, 1)]
            yield pa.record_batch([part["doc_id"], *columns], ["doc_id", "base", "spans"])

    of = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {of}, spans {of}")


def redact(docs: DataFrame, models: Models, threshold: float = THRESHOLD, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; ``n_chars``, if there, counts the new text."""
    names = docs.columns

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for start, end, _ in all_spans(text, models, threshold)[1]:
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = pa.array([clean(t) for t in part["text"].to_pylist()], part["text"].type)
            yield pa.record_batch([texts if n == "text" else part[n] for n in names], names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        changed = F.when(F.col("n_chars").isNotNull(), F.char_length("text"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(names)
    return out
