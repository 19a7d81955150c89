"""Line chunks, messages and stale marks on literals."""

from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import intake


def test_line_chunks_carry_the_last_line(spark):
    body = "aaaa\nbbbb\ncccc\n" + "d" * 25 + "\n\nee\n  \nff"
    got = spark.createDataFrame([(body,), ("",), (None,)], "text string").select(text.chunk_paragraphs(F.col("text"), 10, text.pack_lines).alias("c")).collect()
    assert got[0]["c"] == ["aaaa\nbbbb", "bbbb\ncccc", "d" * 10, "d" * 10, "d" * 5, "ee\n  \nff"]
    assert not got[1]["c"] and not got[2]["c"]


def messages(spark, body):
    rows = intake.split_messages(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("message").collect()
    return [(r["role"], r["speaker"], r["content"]) for r in rows]


def test_messages_by_role(spark):
    assert messages(spark, "hello\nUser: a\n1. Note: b\n\nBot: c : d") == [("user", None, "hello"), ("user", None, "a\n1. Note: b"), ("assistant", None, "c : d")]


def test_messages_by_name(spark):
    assert messages(spark, "Ann Lee: a\nBob: b\nNote: c\nBob: d\nAnn Lee: e") == [("user", "Ann Lee", "a"), ("assistant", "Bob", "b\nNote: c"), ("user", "Bob", "d"), ("assistant", "Ann Lee", "e")]
    assert messages(spark, None) == [] and messages(spark, "plain") == [("user", None, "plain")]


def test_stale_lines_are_marked(spark):
    notes = spark.createDataFrame([(1, "a [n1]\nb [n2]"), (2, "c [n1]")], "note_id long, body string")
    stale = spark.createDataFrame([(1, "[n2]", "gone")], "note_id long, citation string, state string")
    assert [r["body"] for r in intake.annotate_stale(notes, stale).orderBy("note_id").collect()] == ["a [n1]\nb [n2]  ⚠ gone", "c [n1]"]
