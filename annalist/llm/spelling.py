"""Spelling variants of words by permuterm rotations, in DataFrame functions only.

A word with a terminator behind it is rotated to every place.  The rotation that
ends in the character at a place has, without that character, a prefix that says
all else of the word: what follows the place, the terminator, what stands before
it.  Words that differ in the character at one place share that prefix; and a
word into which a character is inserted has there, as its prefix, a whole
rotation of the shorter word.  So near words meet under one string, which stands
for a range of the sorted rotations.

Such a range holds at most one word for each letter, and one whole rotation,
which bounds every group by the size of the alphabet.  Each near pair meets in
one range only: a replacement has one place, and of the places at which a
character of a row of equal ones can be taken out, only the first counts.  What
a group tells is one row a member: how many near words it has there, and the
one that occurs most; no pair of words is written.

Nulls and oddities: a null or empty text has no words; a row that is repeated
counts as often as it stands; in rows without a doc_id nothing is deleted from
any run; without any word that is frequent enough the result is empty.  Columns
other than doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import materialise

#: Letters of a run once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts before every letter and is none.
TERMINATOR = "$"
#: Runs whose check sum this divides lose one code point.
DELETED = 199
#: Code points and occurrences of a word, and how many times as often its form occurs.
LENGTH, OCCURRENCES, TIMES = 6, 5, 5


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every run of letters of every text, A-Z lower-cased."""
    lowered = F.translate("text", UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))


def with_deletions(run: DataFrame) -> DataFrame:
    """(word): the runs, of which every one whose check sum with its doc_id is a multiple of ``DELETED`` loses a code point."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return run.select(F.when(h % DELETED == 0, cut).otherwise(F.col("run")).alias("word"))


def frequent(word: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the words that are long and frequent enough."""
    return word.where(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def rotations(words: DataFrame) -> DataFrame:
    """(range, whole, first, word, n): the ranges that a word stands in.

    One for each place of a character, which the range skips, and one for each
    whole rotation.  ``first`` marks the first of equal characters in a row.
    """
    size, marked = F.char_length("word"), F.concat("word", F.lit(TERMINATOR), "word")
    skipped = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(
            F.substr(marked, i + 1, size).alias("range"),
            F.lit(False).alias("whole"),
            ((i == 1) | (F.substr("word", i, F.lit(1)) != F.substr("word", F.greatest(i - 1, F.lit(1)), F.lit(1)))).alias("first"),
        ),
    )
    whole = F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.struct(F.substr(marked, i, size + 1).alias("range"), F.lit(True).alias("whole"), F.lit(False).alias("first")))
    return words.where(size > 0).select(F.inline(F.concat(skipped, whole)), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are near, and of these (-n, word) of the commonest."""
    member = F.struct("whole", "first", (-F.col("n")).alias("minus_n"), "word")
    groups = rotations(words).groupBy("range").agg(F.collect_list(member).alias("m")).where(F.size("m") > 1)

    def near(x: Column, y: Column) -> Column:
        replaced = ~x["whole"] & ~y["whole"] & (x["word"] != y["word"])
        return replaced | (x["whole"] & y["first"]) | (y["whole"] & x["first"])

    def told(x: Column) -> Column:
        others = F.filter("m", lambda y: near(x, y))
        return F.struct(x["word"].alias("word"), F.transform(others, lambda y: F.struct(y["minus_n"].alias("minus_n"), y["word"].alias("word"))).alias("others"))

    each = groups.select(F.inline(F.transform("m", told))).where(F.size("others") > 0)
    return each.groupBy("word").agg(F.sum(F.size("others")).cast("long").alias("n_near"), F.min(F.array_min("others")).alias("best"))


def with_roots(formed: DataFrame) -> DataFrame:
    """Adds ``root``: the last of the forms that lead on from a word.

    A form occurs ``TIMES`` times as often as its word, so a chain has few
    steps; each round doubles the steps that are known.  A word has few near
    words, so no form is the key of many rows.
    """
    jump = materialise(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = materialise(jump.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        jump = ahead.select("word", "root")
        if not ahead.where("moved").limit(1).count():
            break
    return formed.join(jump, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words."""
    found = words.join(near_words(words), "word", "left")
    form_n = -F.col("best.minus_n")
    enough = form_n >= times * F.col("n")
    formed = materialise(
        found.select("word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, form_n).alias("form_n"))
    )
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Each frequent word of the texts of ``docs`` (doc_id, text), its form, its root, and how many words are near it."""
    return group_variants(materialise(frequent(with_deletions(runs(docs)))))
