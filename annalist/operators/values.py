"""Watched values: what texts say a metric is, and the history that follows from it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.turns import let, trimmed
from annalist.operators.temporal import supersede, value_status
from annalist.sources.shared import keep

#: Characters on either side of a match in which its guards are looked for, and kept of these as evidence.
AROUND, EVIDENCE = 60, 300


@dataclass(frozen=True)
class Watched:
    """A metric that is watched: ``pattern`` finds it, the first of its ``groups`` that took part is the value."""

    key: str
    label: str
    pattern: str
    groups: int = 1
    unit: str = ""
    require: str | None = None
    exclude: str | None = None
    value: str = r"^\d+(\.\d+)?$"


# The metrics that are watched where no others are named.
DEFAULT = (
    Watched(
        "metric:daily-cost", "platform daily cost",
        r"(?i)(?:costs?|paying|bill(?:ed)?[^.\n]{0,20}?|cost check[^$\n]{0,20}?)\s*(?:about |roughly |~|still )?\$\s?(\d+(?:\.\d+)?)\s*(?:per day|/day|a day)"
        r"|(?:steady[- ]state|→|—|:)[^$\n]{0,40}?\*{0,2}~?\$\s?(\d+(?:\.\d+)?)/day",
        2, "$/day", r"(?i)platform|total|steady[- ]state|we are|paying", r"(?i)old account|old-account|would|could|if we|floor|projected",
    ),
    Watched(
        "setting:k8s-version", "kubernetes version",
        r"(?i)kubernetes(?:\s+version)?\s*(?:is now|is|upgraded[^\d]{0,12}to|runs?|=)?\s*v?(1\.\d{2})\b|(?:upgraded[^\d\n]{0,12}to|→)\s*v?(1\.\d{2})\b",
        2, "k8s", r"(?i)kubernetes|k8s", None, r"^1\.\d{2}$",
    ),
    Watched(
        "setting:eks-version", "eks cluster version",
        r"(?i)\beks\b[^\d\n]{0,30}v?(1\.\d{2})\b|(?:upgraded[^\d\n]{0,12}to|→)\s*v?(1\.\d{2})\b",
        2, "eks", r"(?i)\beks\b|kubernetes", None, r"^1\.\d{2}$",
    ),
)
SUFFIXES = ("/day", " per day", " a day", "$")


def without(suffix: str, x: Column) -> Column:
    return F.when(F.lower(x).endswith(suffix), trimmed(F.substring(x, F.lit(1), F.char_length(x) - len(suffix)))).otherwise(x)


def plain_value(raw: Column) -> Column:
    """A value without signs of currency and unit, so that one value has one identity."""
    v = trimmed(F.regexp_replace(trimmed(raw), r"^[$~]+", ""))
    for suffix in SUFFIXES:
        v = let(v, partial(without, suffix))
    return trimmed(F.regexp_replace(v, r"\$+$", ""))


def extract_values(docs: DataFrame, watched: Sequence[Watched] = DEFAULT, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keep..., key, value, unit, fact, evidence): of each metric, the last match in a text whose guards hold.

    A match counts if ``require`` is found, and ``exclude`` is not, in the match
    and 60 characters on either side.  Where its value is none, nothing is told:
    an earlier match does not stand in.  The text is split at the matches, so the
    surroundings are read off the pieces next to a match, whatever the text's length.
    """
    text = F.col("text")
    cut = docs.select(
        *keep,
        *[F.regexp_extract_all(text, F.lit(w.pattern), F.lit(g)).alias(f"_m{i}_{g}") for i, w in enumerate(watched) for g in range(w.groups + 1)],
        *[F.split(text, w.pattern, -1).alias(f"_s{i}") for i, w in enumerate(watched)],
    )
    pieces = cut.select(
        *keep,
        *[f"_m{i}_{g}" for i, w in enumerate(watched) for g in range(w.groups + 1)],
        *[around(F.col(f"_s{i}"), F.col(f"_m{i}_0"), F.right).alias(f"_l{i}") for i in range(len(watched))],
        *[around(F.col(f"_s{i}"), F.col(f"_m{i}_0"), F.left).alias(f"_r{i}") for i in range(len(watched))],
    )
    windows = pieces.select(*keep, *[windows_of(i, w).alias(f"_w{i}") for i, w in enumerate(watched)])
    found = F.array(*[last_of(F.col(f"_w{i}"), w) for i, w in enumerate(watched)])
    each = windows.select(*keep, F.explode(F.array_compact(found)).alias("_v")).select(*keep, "_v.*")
    return each.where(F.col("value").isNotNull())


def around(segments: Column, matches: Column, end) -> Column:
    """Segments and matches in turn, of each only the ``AROUND`` characters at one end; nothing where no match is."""
    short = lambda c: end(c, F.lit(AROUND))
    pairs = F.zip_with(segments, matches, lambda s, m: F.array(short(s), F.coalesce(short(m), F.lit(""))))
    return F.when(F.size(matches) > 0, F.flatten(pairs))


def windows_of(i: int, w: Watched) -> Column:
    """(value, window) of each match."""
    matches, left, right = F.col(f"_m{i}_0"), F.col(f"_l{i}"), F.col(f"_r{i}")
    reach = 2 * AROUND  # a match has a character at least

    def one(m: Column, k: Column) -> Column:
        at = 2 * k + 2  # place of the match among the pieces, from 1
        before = F.array_join(F.slice(left, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach))), "")
        after = F.array_join(F.slice(right, at + 1, F.lit(reach)), "")
        value = F.coalesce(*[F.nullif(F.get(F.col(f"_m{i}_{g}"), k), F.lit("")) for g in range(1, w.groups + 1)])
        return F.struct(value.alias("value"), F.concat(F.right(before, F.lit(AROUND)), m, F.left(after, F.lit(AROUND))).alias("window"))

    return F.when(F.size(matches) > 0, F.transform(matches, one))


def last_of(windows: Column, w: Watched) -> Column:
    guards = lambda x: x["value"].isNotNull() & (x["window"].rlike(w.require) if w.require else F.lit(True)) & (~x["window"].rlike(w.exclude) if w.exclude else F.lit(True))
    def told(value: Column, window: Column) -> Column:
        fact = F.concat(F.lit(f"{w.label} = "), value, F.lit(f" {w.unit}" if w.unit else ""))
        evidence = F.left(trimmed(window), F.lit(EVIDENCE))
        return F.when(value.rlike(w.value), F.struct(F.lit(w.key).alias("key"), value.alias("value"), F.lit(w.unit).alias("unit"), fact.alias("fact"), evidence.alias("evidence")))

    last = F.try_element_at(F.filter(windows, guards), F.lit(-1))
    return let(last, lambda x: let(plain_value(x["value"]), lambda v: told(v, x["window"])))


def value_edges(values: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The history of each metric: intervals of its values in world time.

    ``values``: scope columns, key, value, fact, valid_at, ingested_at, event_id; each
    metric of a scope has one value at a time, and a value that comes back is open again.
    Observations without a time come before all others.
    """
    dated = values.withColumn("valid_at", F.coalesce("valid_at", F.lit("0001-01-01").cast("timestamp")))
    return supersede(dated, [*scope, "key"], "value")


def rebuild_values(docs: DataFrame, watched: Sequence[Watched] = DEFAULT, scope: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Edges and nodes of all watched values of ``docs`` (scope columns, doc_id, text, valid_at), from nothing.

    Built from the documents alone, in valid-time order with the document id to
    settle ties, so that it gives the same rows however often it is run and
    whatever was there before.  ``sources.versions`` puts the tables in place at once.
    """
    seen = extract_values(docs, watched, [*scope, "doc_id", "valid_at"])
    told = keep(seen.select(*scope, "key", "value", "fact", "valid_at", F.col("valid_at").alias("ingested_at"), F.col("doc_id").alias("event_id")))
    edges = value_edges(told, scope)
    named = F.concat_ws("=", "key", "value")
    status = value_status(edges.withColumn("node", F.concat_ws("\u0001", *scope, named)), "node")
    nodes = edges.select(*scope, "key", "value", F.concat_ws("\u0001", *scope, named).alias("node")).distinct().join(status, "node").select(*scope, "key", "value", "status")
    return {"edges": edges, "nodes": nodes}
