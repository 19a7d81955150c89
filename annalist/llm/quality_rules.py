"""Quality rules (native): counting rules and a hashed n-gram log-likelihood ratio.

Everything here is DataFrame expressions: no Python runs on the executors.

The ratio compares two multinomials over ``buckets`` hashed features (the
unigrams and bigrams of a text's runs of letters/digits and runs of other
signs): one counted over trusted documents, one over the whole raw corpus.  A
document's verdict is the mean log ratio of its features against a fixed
threshold; every document gets one.

Nulls and oddities: a null text counts as an empty one; an empty text has no
words and fails the base rules; repeated rows each get their own equal row;
further columns are ignored by name and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_ids, held_out

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEATURES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is counted over, at most.
TRUSTED_BOUND = 20_000
#: Weight, in features, of the raw distribution in the smoothed target.
PRIOR = 20_000.0
THRESHOLD = -0.15


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside a window of ``window`` words that occurs twice or more in the array."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]),
    )

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeats(ordered: Column) -> Column:
        hit = F.filter(
            ordered,
            lambda s: s["twin"],
        )
        return let(F.sort_array(F.transform(hit, lambda s: s["at"])), covered)

    def twins(ordered: Column) -> Column:
        return F.transform(
            ordered,
            lambda s, k: F.struct(
                s["at"].alias("at"),
                (
                    F.coalesce(F.get(ordered, k - 1)["h"] == s["h"], F.lit(False))
                    | F.coalesce(F.get(ordered, k + 1)["h"] == s["h"], F.lit(False))
                ).alias("twin"),
            ),
        )

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        slow = repeats(let(pairs, twins))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(slow)

    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(hashes, count))


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the counting rules' columns."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("words", words_of(text))
        .withColumn("lines", lines)
        .select(
            "doc_id",
            "text",
            F.size("words").cast("long").alias("n_words"),
            F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("words")).alias("n_repeat_words"),
        )
    )


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(FEATURES), 0), lambda t: F.xxhash64(t))


def bucket(*parts: Column, buckets: int) -> Column:
    """Bucket of a hashed feature; ``buckets`` is a power of two."""
    return parts[0].bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def feature_buckets(hashes: Column, buckets: int) -> Column:
    """Two buckets for each token: its own, and that of it with the next one (or the end)."""
    both = F.transform(
        hashes,
        lambda x, i: F.array(
            bucket(x, buckets=buckets), bucket(F.xxhash64(x, F.get(hashes, i + 1)), buckets=buckets)
        ),
    )
    return F.flatten(both)


def log_ratio_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(bucket, weight): log target probability over raw probability, of buckets seen.

    ``trusted`` (doc_id) is a bounded table of ids.  The target is smoothed
    towards the raw distribution by ``prior`` features, so that a bucket about
    which the trusted documents say little has a weight near 0.
    """
    marked = docs.join(F.broadcast(trusted.withColumn("_trusted", F.lit(1))), "doc_id", "left")
    counts = (
        marked.select(token_hashes(F.col("text")).alias("h"), F.coalesce("_trusted", F.lit(0)).alias("t"))
        .select(F.explode(feature_buckets(F.col("h"), buckets)).alias("bucket"), "t")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    )
    totals = F.sum("raw").over(_everything()), F.sum("target").over(_everything())
    share = F.col("raw") / totals[0]
    smoothed = (F.col("target") + prior * share) / (totals[1] + prior)
    return counts.select("bucket", F.log(smoothed / share).alias("weight"))


def _everything():
    """All of the weights' buckets, a fixed number."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def weight_array(weights: DataFrame, buckets: int) -> Column:
    """The weights as one array value of ``buckets`` numbers: a scalar subquery, of fixed size."""
    dense = weights.sparkSession.range(buckets).join(weights, F.col("id") == F.col("bucket"), "left")
    one = dense.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("id", F.coalesce("weight", F.lit(0.0)).alias("w")))), lambda s: s["w"]
        )
    )
    return one.scalar()


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    max_repeat_percent: int = 20,
    min_words: int = 10,
) -> DataFrame:
    """Counts, ratio and verdict of each document.

    ``trusted`` (doc_id): the ids of trusted documents, bounded in number.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, log_ratio, kept.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = weight_array(log_ratio_weights(docs, trusted, buckets), buckets)
    scored = base_columns(docs).withColumn("h", token_hashes(F.col("text"))).withColumn("w", weights)

    def one(x: Column, i: Column) -> Column:
        second = F.xxhash64(x, F.get(F.col("h"), i + 1))
        return F.get(F.col("w"), bucket(x, buckets=buckets)) + F.get(F.col("w"), bucket(second, buckets=buckets))

    total = F.aggregate(F.transform("h", one), F.lit(0.0), lambda a, x: a + x)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.withColumn("log_ratio", total / F.greatest(2 * F.size("h"), F.lit(1))).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.round("log_ratio", 9).alias("log_ratio"),
        (~failed & (F.col("log_ratio") >= threshold)).alias("kept"),
    )


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_BOUND) -> DataFrame:
    """Ids that the training folds label as good, at most ``bound``."""
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id")))
    return bounded_ids(good, "doc_id", bound)
