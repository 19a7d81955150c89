"""Reading a source by SQL under an allow-list, and what its tables are as keyed claims.

What a statement may touch is decided on Spark's own plan of it, not on its text:
its relations after analysis, in common tables, subqueries and views as well.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.sources.shared import shared_folder

#: Leaves of a plan that read nothing.
HARMLESS = ("OneRowRelation", "LocalRelation", "CTERelationRef", "Range")
#: Expressions that run code which the statement names.
REFUSED = ("CallMethodViaReflection", "TryReflect")


class Refused(ValueError):
    """The statement is not a single query over the tables that are allowed."""


@dataclass
class Read:
    """``rows``: at most as many as allowed; ``audit``: one row that says who read what, without any content."""

    rows: DataFrame
    truncated: bool
    audit: DataFrame


def nodes(plan) -> Iterator:
    """All nodes of a plan, those of subqueries and common tables as well, down to views."""
    yield plan
    if plan.getClass().getSimpleName() == "View":
        return
    for inner in each(plan.subqueries()):
        yield from nodes(inner)
    for child in each(plan.children()):
        yield from nodes(child)


def each(seq) -> Iterator:
    i = seq.iterator()
    while i.hasNext():
        yield i.next()


def check(session: SparkSession, sql: str, allowed: set[str]) -> tuple[DataFrame, list[str]]:
    """The query as a DataFrame, and the tables that it reads."""
    jvm = session.sparkContext._jvm
    try:
        parsed = session._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except ParseException as e:
        raise Refused(f"not a single statement: {e.getCondition()}") from e
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    kinds = [jvm.java.lang.Class.forName(logical + k) for k in ("Command", "ParsedStatement")]
    if any(k.isInstance(n) for k in kinds for n in nodes(parsed)):
        raise Refused("only a query may be read")
    try:
        df = session.sql(sql.strip().rstrip(";"))
    except AnalysisException as e:
        raise Refused(f"not among the tables allowed, or not a query: {e.getCondition()}") from e
    tables, leaf = set(), jvm.java.lang.Class.forName(logical + "LeafNode")
    for node in nodes(df._jdf.queryExecution().analyzed()):
        kind = node.getClass().getSimpleName()
        if any(f"{r}(" in str(x) or r in x.getClass().getName() for r in REFUSED for e in each(node.expressions()) for x in [e, *below(e)]):
            raise Refused("an expression that runs code")
        if kind == "View":
            name = node.desc().identifier().table().lower()
            if not node.isTempView() or name not in allowed:
                raise Refused(f"not among the tables allowed: {name}")
            tables.add(name)
        elif leaf.isInstance(node) and kind not in HARMLESS:
            raise Refused(f"not among the tables allowed: {kind}")
    return df, sorted(tables)


def below(expression) -> Iterator:
    for c in each(expression.children()):
        yield c
        yield from below(c)


def guarded_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], row_limit: int = 200, source: str = "", user: str | None = None, at: datetime | None = None) -> Read:
    """The rows of one SELECT (or WITH) over the named ``tables``, ``row_limit`` at most.

    One row more is fetched, to tell whether there are more.  The statement runs
    in a session of its own, in which those tables are the only views.
    """
    session = spark.newSession()
    dataset = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in tables.items():
        dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    df, names = check(session, sql, {t.lower() for t in tables})
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.limit(row_limit + 1).write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    n = got.count()
    sha = hashlib.sha256(sql.strip().rstrip(";").encode()).hexdigest()[:16]
    at = at or datetime.now()
    told = (f"query:{source}:{sha}:{int(at.timestamp())}", source, user, names, min(n, row_limit), n > row_limit, sha, at)
    audit = spark.createDataFrame([told], "query_id string, source string, user_id string, tables array<string>, n_rows long, truncated boolean, sql_sha string, at timestamp")
    return Read(got.limit(row_limit), n > row_limit, audit)


def schema_claims(tables: Mapping[str, DataFrame], source: str) -> DataFrame:
    """One keyed state claim for each table: its columns in order, and how many rows back it."""
    out = None
    for name, df in sorted(tables.items()):
        columns = ", ".join(df.columns)
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit("state").alias("kind"), F.lit(f"source/{source}/schema").alias("topic"), F.lit(name).alias("key"), F.lit(f"table {name} columns: {columns}").alias("value"),
            F.lit(f"{source} table {name}: columns {columns}").alias("content"), "n_rows",
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no table to look into")
    return out
