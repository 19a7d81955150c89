"""Turns of a transcript, and passages that never lose who is speaking, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.text import chunk_paragraphs

# Speakers that open a turn, and what counts as a name.
ROLES = ("user", "human", "assistant", "ai", "bot")
NAME = r"^[A-Z][a-z]+(?: [A-Z][a-z]+)?$"
CONTINUED = ": (continued) "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def head(line: Column) -> Column:
    """What stands before the first colon of a line, null without one."""
    return F.when(line.contains(":"), trimmed(F.substring_index(line, ":", 1)))


def turns(text: Column) -> Column:
    """Array of (speaker, lines).

    Where any line begins with a role, lines that do begin a turn; else lines that
    begin with a capitalised name that does so twice or more.  Any other line
    continues the turn it stands in; what comes before the first turn is one
    without a speaker.  Blank lines are left out.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: trimmed(x) != "")

    def with_lines(ls: Column) -> Column:
        heads = F.filter(F.transform(ls, head), lambda h: h.isNotNull())

        def with_heads(hs: Column) -> Column:
            roles = F.exists(hs, lambda h: F.lower(h).isin(*ROLES))
            named = let(F.array_sort(F.filter(hs, lambda h: h.rlike(NAME))), lambda s: F.array_distinct(F.filter(s, lambda h, i: h == F.get(s, i + 1))))

            def with_rule(rule: Column) -> Column:
                opens = lambda h: F.when(rule["roles"], F.lower(h).isin(*ROLES)).otherwise(F.array_contains(rule["names"], h))
                speakers = F.transform(ls, lambda x: F.when(F.coalesce(opens(head(x)), F.lit(False)), head(x)))
                return let(speakers, lambda sp: between_starts(ls, sp))

            return let(F.struct(roles.alias("roles"), named.alias("names")), with_rule)

        return F.when(F.size(ls) > 0, let(heads, with_heads))

    return let(lines, with_lines)


def between_starts(lines: Column, speakers: Column) -> Column:
    starts = F.filter(F.transform(speakers, lambda s, i: F.when(s.isNotNull() | (i == 0), i)), lambda i: i.isNotNull())
    to = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(lines)) - F.get(at, k)
    return let(starts, lambda at: F.transform(at, lambda s, k: F.struct(F.get(speakers, s).alias("speaker"), F.slice(lines, s + 1, to(at, k)).alias("lines"))))


def pack_turns(paragraph: Column, size: int = 1000) -> Column:
    """Whole turns packed into passages of at most ``size`` characters, each joint counting one.

    A longer turn closes the open passage and is cut into pieces of whole lines (a
    line that is too long, by itself, at the limit); every piece but the first
    opens with its speaker.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("open"))
    close = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))

    def pieces(turn: Column) -> Column:
        prefix = F.when(turn["speaker"].isNotNull(), F.concat(turn["speaker"], F.lit(CONTINUED))).otherwise(F.lit(""))

        def cut(p: Column) -> Column:
            room = F.greatest(F.lit(size) - F.char_length(p), F.lit(1))
            parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(x) - 1) / room).cast("int")), lambda i: F.substring(x, i * room + 1, room))
            units = F.flatten(F.transform(turn["lines"], parts))

            def step(s: Column, u: Column) -> Column:
                full = (s["open"] != "") & (F.char_length(s["open"]) + F.char_length(u) + 2 > size)
                return F.when(full, state(F.concat(s["done"], F.array(s["open"])), F.concat(p, u))).otherwise(state(s["done"], F.when(s["open"] == "", u).otherwise(F.concat(s["open"], F.lit("\n"), u))))

            return F.aggregate(units, start, step, close)

        return let(prefix, cut)

    def step(s: Column, turn: Column) -> Column:
        def placed(whole: Column) -> Column:
            n = F.char_length(whole)
            full = (s["open"] != "") & (F.char_length(s["open"]) + n + 2 > size)
            joined = F.when(s["open"] == "", whole).otherwise(F.concat(s["open"], F.lit("\n"), whole))
            return (
                F.when(n > size, state(F.concat(close(s), pieces(turn)), F.lit("")))
                .when(full, state(close(s), whole))
                .otherwise(state(s["done"], joined))
            )

        return let(F.array_join(turn["lines"], "\n"), placed)

    return let(turns(paragraph), lambda ts: F.aggregate(ts, start, step, close))


def chunk_turns(text: Column, size: int = 1000) -> Column:
    """Paragraphs packed as ever; one that is too long is a transcript, and packed by turns."""
    return chunk_paragraphs(text, size, pack_turns)
