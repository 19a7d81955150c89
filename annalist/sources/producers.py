"""Producer rows as episodes, run telemetry, transcripts, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions.text import contract_at_least
from annalist.operators.ledger import require_columns

# The actions of the audit log that are kept, and what they are called.
AUDIT_ACTIONS = {"member_added": "org.member_added", "member_role_changed": "org.role_changed", "member_removed": "org.member_removed"}
RUN_RESULTS = ("success", "error", "max_turns", "cancelled")


def from_audit_log(df: DataFrame) -> DataFrame:
    """Three actions become episodes, others are dropped."""
    require_columns(df, ["id", "organization_id", "actor_user_id", "action", "target_user_id", "created_at"])
    action = F.coalesce(*[F.when(F.col("action") == k, v) for k, v in AUDIT_ACTIONS.items()])
    return df.where(action.isNotNull()).select(
        F.concat(F.lit("backend_audit:"), F.col("id").cast("string")).alias("event_id"), F.col("created_at").alias("occurred_at"), F.lit("org").alias("scope"),
        F.col("organization_id").cast("string").alias("scope_id"), action.alias("action_type"), F.col("actor_user_id").alias("actor_id"), F.col("target_user_id").alias("target_id"),
    )


def from_agents(agents: DataFrame, projects: DataFrame) -> DataFrame:
    """Each owned agent is created, and deployed too where it runs since a known time."""
    met = agents.join(projects, "project_id", "left").where("author_user_id is not null or org_id is not null")
    event = lambda kind, at: F.struct(F.concat_ws(":", F.lit("agent"), "id", F.lit(kind)).alias("event_id"), F.lit(f"agent.{kind}").alias("action_type"), at.alias("occurred_at"))
    running = (F.col("deployment_status") == "running") & F.col("deployed_at").isNotNull()
    events = F.array_compact(F.array(event("created", F.col("created_at")), F.when(running, event("deployed", F.col("deployed_at")))))
    return met.select(F.explode(events).alias("e"), "id", "author_user_id", "org_id").select("e.*", F.col("id").alias("agent_id"), "author_user_id", "org_id")


def from_conversation_store(df: DataFrame) -> DataFrame:
    """Dotted prefixes as pairs; messages, traces and other rows as three kinds of episode."""
    parts = F.split("prefix", r"\.")
    at = lambda odd: F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == odd), lambda i: F.get(parts, i))
    pairs = F.map_from_arrays(F.slice(at(0), 1, F.size(at(1))), at(1))
    kind = F.when(F.upper("value.type") == "MESSAGE", "chat.message").when(F.upper("value.data.trace_type") == "LLM", "agent.tool_called").otherwise("agent.decided")
    return df.select(F.concat_ws(":", F.lit("store"), "prefix", "key").alias("event_id"), pairs.alias("subject"), kind.alias("action_type"), F.when(kind == "chat.message", F.col("value.data.content")).alias("content"), F.col("updated_at").alias("occurred_at"))


def normalize_runs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the first rule that fails names the reason."""
    newer = lambda floor: contract_at_least(F.col("contract"), floor)
    allowed = F.col("run_result").isin(*RUN_RESULTS) | ((F.col("run_result") == "needs_approval") & newer("d11.3"))
    success = F.col("run_result") == "success"
    parked = F.col("run_result") == "needs_approval"
    reason = F.coalesce(
        F.when(~F.col("contract").rlike(r"^d\d+\.\d+$") | F.col("contract").isNull(), "contract"),
        F.when(~F.coalesce(allowed, F.lit(False)), "run_result"),
        F.when(success & F.col("failure_class").isNotNull(), "failure_class_on_success"),
        F.when(~success & F.col("failure_class").isNull(), "failure_class_missing"),
        F.when(parked & (F.col("failure_class") != "approval_pending"), "approval_pending_missing"),
        F.when(newer("d11.2") & F.col("wall_ms").isNull(), "wall_ms"),
        F.when(newer("d11.4") & (F.col("role").isNull() | F.col("run_id").isNull()), "role_or_run_id"),
    )
    judged = df.withColumn("reject_reason", reason)
    return judged.where("reject_reason is null").drop("reject_reason"), judged.where("reject_reason is not null")


def sessions_to_documents(lines: DataFrame, least_chars: int = 2_000) -> DataFrame:
    """Transcript lines (session_id, n, type, day, text) as one document for each session and day."""
    order = Window.partitionBy("session_id").orderBy("n")
    filled = lines.where("not coalesce(is_sidechain, false)").withColumn("day", F.last("day", ignorenulls=True).over(order))
    line = F.concat_ws(": ", "type", "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n")
    days = filled.where("text is not null").groupBy("session_id", "day").agg(body.alias("content"), F.count_if(F.col("type") == "user").alias("user_turns"))
    return days.where((F.col("user_turns") >= 1) & (F.char_length("content") >= least_chars))


def markdown_documents(spark: SparkSession, root: str, most_chars: int = 40_000) -> DataFrame:
    """Markdown files below ``root``: path, workspace (its first part), text, time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    inner = F.regexp_extract("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + r"/(.*)$", 1)
    return files.where(~inner.rlike(r"(^|/)\.")).select(inner.alias("uri"), F.split(inner, "/")[0].alias("workspace"), F.substring(F.decode("content", "UTF-8"), 1, most_chars).alias("text"), F.col("modificationTime").alias("valid_at"))


def catalogue_files(spark: SparkSession, root: str, known: DataFrame, suffixes: tuple[str, ...] = ("md", "txt", "csv", "json")) -> DataFrame:
    """New files with an allowed suffix; their content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("ref"), "length", "modificationTime")
    kept = files.where(F.col("ref").rlike(r"\.(" + "|".join(suffixes) + r")$") & ~F.col("ref").rlike(r"/\.[^/]"))
    title = F.regexp_replace(F.regexp_extract("ref", r"([^/]+)\.[^./]+$", 1), "[-_]+", " ")
    return kept.withColumn("title", title).join(known.select("ref"), "ref", "left_anti")


def repo_cards(listing: DataFrame, top: int = 3) -> DataFrame:
    """The commonest languages of each repository by file suffix, Markdown left out."""
    suffix = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    counts = listing.withColumn("lang", F.lower(suffix)).where("lang <> '' and lang <> 'md'").groupBy("repo", "lang").agg(F.count("*").alias("n"))
    order = Window.partitionBy("repo").orderBy(F.desc("n"), "lang")
    ranked = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    return ranked.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "lang"))), lambda x: x["lang"]), ", ").alias("languages"))
