"""Question sets with nested sessions as tables: items, documents and gold sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSIONS = "array<struct<haystack_session_ids:string,haystack_dates:string,haystack_sessions:array<struct<role:string,content:string>>>>"
QA = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"
)


def session_date(text: Column) -> Column:
    """Dates such as 2023/05/30 (Tue) 21:40; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r" \(\w{3}\)", ""), F.lit("yyyy/MM/dd HH:mm"))


def read_qa(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Questions of a JSON file: one on each line, or (``whole``) one array; ``position`` is their place in the file."""
    return spark.read.schema(QA).option("multiLine", whole).json(path).withColumn("position", F.monotonically_increasing_id())


def first_of_each_type(questions: DataFrame, limit: int, types: int = 6) -> DataFrame:
    """The first questions of each type, ``limit`` shared out among ``types``."""
    order = Window.partitionBy("question_type").orderBy("position")
    return questions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(1, limit // types)).drop("_n")


def qa_tables(questions: DataFrame) -> dict[str, DataFrame]:
    """Items (one a question), docs (one a session of a question, turns as lines) and golds (question, session).

    Sessions, their ids and dates belong together by place; a question whose
    lists differ in length is an error.
    """
    ids, dates, sessions = (F.size(c) for c in ("haystack_session_ids", "haystack_dates", "haystack_sessions"))
    wrong = F.raise_error(F.concat(F.lit("sessions do not fit in question "), "question_id")).cast(SESSIONS)
    zipped = F.when((ids == dates) & (dates == sessions), F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).otherwise(wrong)
    each = questions.select("question_id", F.posexplode(zipped).alias("place", "s"))
    lines = F.transform("s.haystack_sessions", lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    docs = each.select(
        "question_id", "place", F.col("s.haystack_session_ids").alias("session_id"), F.concat(F.lit("session "), "s.haystack_dates").alias("title"),
        F.array_join(lines, "\n").alias("text"), session_date(F.col("s.haystack_dates")).alias("valid_at"),
    )
    items = questions.select(
        "question_id", F.col("question_type").alias("type"), "question", "answer", "question_date", F.col("question_id").endswith("_abs").alias("abstention"), F.size("haystack_sessions").alias("n_sessions")
    )
    golds = questions.select("question_id", F.explode(F.array_distinct("answer_session_ids")).alias("session_id"))
    return {"items": items, "docs": docs, "golds": golds}
