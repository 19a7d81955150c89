"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must find what they always found.
EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
PHONE = r"(?U)(?<![\w/:-])(?:\+\d{1,3}[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]\d{4}(?![\w-])"
CARD = r"\b(?:\d[ -]?){13,19}\b"
NATIONAL_ID = r"\b\d{3}-\d{2}-\d{4}\b"
ASSIGNED = (
    r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|private[_-]?key)\b"
    r"""(\s*[:=]\s*)(["']?)([^\s"']{4,})\3"""
)
TOKENS = (r"AKIA[0-9A-Z]{16}", r"ghp_[A-Za-z0-9]{20,}", r"xox[baprs]-[A-Za-z0-9-]{10,}", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----")
NEGATIONS = ("not", "no", "never", "stopped", "deprecated", "removed", "former", "ended", "cancelled")
STOP_TERMS = tuple(
    "this that with from have were been they their there which would about into also than then them these those such other more most some what when"
    " where will your just like over only very much many each while after before because could should might shall being does".split()
)
ASKS_ASSISTANT = (
    r"(?i)\b(you (told|said|mentioned|suggested|recommended|gave|shared|listed|explained|advised|described)|what did you\b|you'd (suggested|recommended|mentioned|said)"
    r"|your (suggestions?|recommendations?|advice|tips?|explanation|answer)\b|(our|the) (previous |last |earlier |recent )?(conversation|chat|discussion)s? (about|on|regarding|where)\b"
    r"|we (discussed|talked about|went over)\b)"
)


def slug(text: Column, limit: int = 200, default: str = "fact") -> Column:
    """Lower-case words joined by dashes, cut at ``limit``."""
    kebab = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(kebab, 1, limit), "-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def normalize_fact(text: Column) -> Column:
    """White space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def query_terms(question: Column, most: int = 8) -> Column:
    """The first terms of a question, lower-cased; repeats stay."""
    return F.slice(F.transform(F.regexp_extract_all(question, F.lit("[a-zA-Z0-9_]{3,}"), 0), F.lower), 1, most)


def tokens(text: Column) -> Column:
    """Distinct lower-case terms of a passage."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9_]{3,}"), 0), F.lower))


def chunk_fixed(text: Column, size: int = 1000) -> Column:
    """Pieces of ``size`` characters: the cut of a paragraph that is too long to pack."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.char_length(text) - 1) / size), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))


def pack_lines(paragraph: Column, size: int = 1000) -> Column:
    """Whole lines packed into passages of at most ``size`` characters, each joint counting one.

    The last line of a passage opens the next one too if the next line fits
    beside it; a line over the limit closes the open passage and is cut.
    """
    lines = F.filter(F.split(paragraph, "\n"), lambda x: F.trim(x) != "")
    nothing = F.array().cast("array<string>")
    size_of = lambda held: F.aggregate(held, F.lit(0), lambda n, x: n + F.char_length(x) + 1)
    close = lambda state: F.when(F.size(state["open"]) == 0, state["done"]).otherwise(F.concat(state["done"], F.array(F.array_join(state["open"], "\n"))))

    def step(state: Column, line: Column) -> Column:
        full = (F.size(state["open"]) > 0) & (size_of(state["open"]) + F.char_length(line) + 1 > size)
        last = F.filter(F.slice(state["open"], -1, 1), lambda x: F.char_length(x) + F.char_length(line) + 1 <= size)
        return (
            F.when(F.char_length(line) > size, F.struct(F.concat(close(state), chunk_fixed(line, size)).alias("done"), nothing.alias("open")))
            .when(full, F.struct(close(state).alias("done"), F.concat(last, F.array(line)).alias("open")))
            .otherwise(F.struct(state["done"].alias("done"), F.concat(state["open"], F.array(line)).alias("open")))
        )

    return F.aggregate(lines, F.struct(nothing.alias("done"), nothing.alias("open")), step, close)


def chunk_paragraphs(text: Column, size: int = 1000, cut: Callable[[Column, int], Column] = chunk_fixed) -> Column:
    """Paragraphs packed into passages of at most ``size`` characters, a join counting two.

    A fold over the paragraphs carries the finished passages and the open one;
    a paragraph over the limit closes the open one and goes through ``cut``.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def close(state: Column) -> Column:
        return F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))

    def step(state: Column, p: Column) -> Column:
        fits = F.char_length(state["open"]) + F.char_length(p) + 2 <= size
        joined = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n\n"), p))
        return (
            F.when(F.char_length(p) > size, F.struct(F.concat(close(state), cut(p, size)).alias("done"), F.lit("").alias("open")))
            .when((state["open"] == "") | fits, F.struct(state["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(close(state).alias("done"), p.alias("open")))
        )

    return F.aggregate(paragraphs, empty, step, close)


def has_user_turn(text: Column) -> Column:
    return text.rlike(r"(?im)^\s*(user|human)\s*:")


def pii_kinds(text: Column) -> Column:
    """Kinds of personal data in order: email, phone, national-id, card."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(CARD), 0), lambda m: F.regexp_replace(m, "[^0-9]", ""))
    card = F.exists(numbers, lambda n: F.length(n).between(13, 19) & F.call_function("luhn_check", n))
    return F.array_compact(
        F.array(
            F.when(text.rlike(EMAIL), "email"), F.when(text.rlike(PHONE), "phone"), F.when(text.rlike(NATIONAL_ID), "national-id"), F.when(card, "card")
        )
    )


def secret_reference(value: Column) -> Column:
    return F.concat(F.lit("secret://"), F.substring(F.sha2(value, 256), 1, 16))


def redact(text: Column) -> tuple[Column, Column]:
    """(text with secrets replaced, their references in order): a reference is a hash of the secret."""
    assigned = F.regexp_extract_all(text, F.lit(ASSIGNED), 4)
    others = [F.regexp_extract_all(text, F.lit(p), 0) for p in TOKENS]
    values = F.array_distinct(F.filter(F.concat(assigned, *others), lambda v: ~v.startswith("secret://")))
    clean = F.aggregate(values, text, lambda t, v: F.replace(t, v, secret_reference(v)))
    return clean, F.transform(values, secret_reference)


def contract_at_least(version: Column, floor: str) -> Column:
    """dMAJOR.MINOR >= floor; what cannot be read is not."""
    major, minor = floor.removeprefix("d").split(".")
    part = lambda i: F.nullif(F.regexp_extract(version, r"^d(\d+)\.(\d+)$", i), F.lit("")).cast("int")
    return F.coalesce(F.struct(part(1), part(2)) >= F.struct(F.lit(int(major)), F.lit(int(minor))), F.lit(False)) & part(1).isNotNull()


def hop_base(name: Column) -> Column:
    return F.split(name, "-", 2)[0]


def contradicts(a: Column, b: Column) -> Column:
    """Two statements share two words or more, of any kind, and just one of them is negated."""
    ta, tb = (F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0) for x in (a, b))
    negated = lambda t: F.arrays_overlap(t, F.array(*map(F.lit, NEGATIONS)))
    return (F.size(F.array_intersect(ta, tb)) >= 2) & (negated(ta) != negated(tb))


def sentences(text: Column, least_words: int = 3) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]?"), 0), lambda s: F.trim(s))
    return F.filter(found, lambda s: F.size(F.split(s, r"\s+")) >= least_words)


def excerpt(text: Column, n: int = 320) -> Column:
    """At most ``n`` characters, cut at the last space and marked."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, n)
    return F.when(F.char_length(flat) <= n, flat).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…")))
