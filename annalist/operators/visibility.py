"""Who may read and write what, and which rows a read sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.scores import as_of

# Named routes and the sources they read.
ROUTES = {
    "coding_assistant": ("github_pr", "repo_files", "langgraph_store"),
    "onboarding": ("docs", "decisions"),
    "blast_radius": ("deploy", "mcp_tool_calls"),
}


def browse_filter(df: DataFrame, tenant: str | None, user: str, teams: list[str]) -> DataFrame:
    """Global rows, and the tenant's own but for other people's rows and teams the caller is not in."""
    own = F.when(F.col("scope") == "user", F.col("scope_id") == user).when(F.col("scope") == "team", F.col("scope_id").isin(*teams) if teams else F.lit(False)).otherwise(F.lit(True))
    return df.where((F.col("scope") == "global") | ((F.col("org_id") == tenant) & own))


def nodes_live_at(nodes: DataFrame, edges: DataFrame, at: Column, mode: str = "valid") -> DataFrame:
    """Nodes that an edge valid at the instant touches."""
    start, end = {"valid": ("valid_at", "invalid_at"), "system": ("ingested_at", "expired_at")}[mode]
    live = edges.where(as_of(F.col(start), F.col(end), at))
    ends = live.select(F.col("src_id").alias("node_id")).unionByName(live.select(F.col("dst_id").alias("node_id"))).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def chunks_as_of(chunks: DataFrame, docs: DataFrame, at: Column, mode: str = "valid") -> DataFrame:
    """P10: passages of documents dated, or else ingested, by the instant."""
    stamp = F.coalesce("valid_at", "ingested_at") if mode == "valid" else F.col("ingested_at")
    return chunks.join(docs.where(stamp <= at).select("doc_id"), "doc_id", "left_semi")


def glob_regex(glob: Column, me: Column) -> Column:
    """A topic glob as a regular expression; {me} is the caller."""
    filled = F.replace(glob, F.lit("{me}"), me)
    quoted = F.regexp_replace(filled, r"([.^$+()\[\]{}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def topic_filter(df: DataFrame, grants: DataFrame, caller: str) -> DataFrame:
    """Keyed rows whose topic one of the caller's grants matches; unkeyed rows, and callers without grants, are free.

    Grants of one caller are few; topics are matched once each, not once a row.
    """
    mine = grants.where(F.col("caller_id") == caller)
    topics = df.select("topic").where("topic is not null").distinct()
    open_ = topics.join(mine, F.rlike(F.col("topic"), glob_regex(F.col("pattern"), F.lit(caller))), "left_semi").withColumn("_open", F.lit(True))
    none = mine.agg(F.count("*") == 0).scalar()
    return df.join(open_, "topic", "left").where(F.col("topic").isNull() | F.col("_open").isNotNull() | none).drop("_open")


def route_sources(queries: DataFrame) -> DataFrame:
    """``queries`` with the sources of their named route, null for all."""
    named = F.coalesce(*[F.when(F.col("route") == k, F.array(*map(F.lit, v))) for k, v in ROUTES.items()])
    return queries.withColumn("sources", named)


def kind_filter(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Nodes of a kind: states, preferences and records are metrics by key; values of other anchors go too."""
    prefix = {"state": "state:", "preference": "pref:", "record": "record:"}.get(kind)
    keep = F.col("type") == "Fact" if prefix is None else (F.col("type") == "Metric") & F.col("key").startswith(prefix)
    dropped = nodes.where((F.col("type") == "Metric") & ~keep).select(F.col("node_id").alias("src_id"))
    hanging = edges.where("type = 'HAS_VALUE'").join(dropped, "src_id", "left_semi").select(F.col("dst_id").alias("node_id"))
    return nodes.where(keep | (F.col("type") == "MetricValue")).join(hanging, "node_id", "left_anti")


def authorize_writes(episodes: DataFrame, callers: DataFrame) -> DataFrame:
    """``deny_reason`` of each episode, null where its caller may write to its scope.

    ``callers``: caller_id, role (service, admin, member), org_id, writable (unit ids).
    """
    met = episodes.join(callers.select("caller_id", "role", F.col("org_id").alias("_org"), "writable"), "caller_id", "left")
    service, admin = F.col("role") == "service", F.col("role") == "admin"
    allowed = (
        F.when(F.col("scope") == "global", service).when(service | admin, True).when(F.col("scope") == "user", F.col("scope_id") == F.col("caller_id"))
        .when(F.col("scope") == "team", F.array_contains("writable", F.col("scope_id"))).when(F.col("scope") == "org", F.col("scope_id") == F.col("_org")).otherwise(False)
    )
    return met.withColumn("deny_reason", F.when(~F.coalesce(allowed, F.lit(False)), F.concat(F.lit("scope:"), "scope"))).drop("role", "_org", "writable")
