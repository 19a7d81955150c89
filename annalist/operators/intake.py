"""Further producers, the telemetry batch, drafted eval cases, messages, and bundles for a caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators.ledger import append_episodes, require_columns, scope_for
from annalist.sources.producers import normalize_runs

# Skill events that count as a use, ledger actions, task classes by kind, roles by speaker, ranks of trust.
USE_EVENTS = ("body.loaded", "file.loaded", "script.executed", "outcome")
LEDGER_ACTIONS = ("hop.version_published", "hop.eval_scored")
TASK_CLASS = {"refusal": "refuse", "escalation": "refuse", "unmodelled": "diagnose", "surprise": "diagnose", "verifier_fail": "diagnose", "correction": "ask"}
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant"}
TIERS = ("endorsed", "corroborated", "probation")


def looked_up(table: dict[str, str], key: Column) -> Column:
    """The entry of a small table, null where there is none."""
    return F.coalesce(*[F.when(key == k, v) for k, v in table.items()])


def from_servers(df: DataFrame) -> DataFrame:
    """Deployed and stopped servers become episodes, other states none; the platform's are global."""
    require_columns(df, ["id", "owner_user_id", "owner_type", "name", "status", "tools_metadata", "updated_at"])
    everyone = F.coalesce(F.col("owner_type") == "platform", F.lit(False))
    scope = F.when(everyone, F.struct(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("scope_id"))).otherwise(scope_for(F.lit(None), F.col("owner_user_id")))
    tools = F.filter(F.transform(F.coalesce("tools_metadata", F.array()), lambda t: t["name"]), lambda n: n.isNotNull() & (n != ""))
    return df.where(F.col("status").isin("deployed", "stopped")).select(
        F.concat_ws(":", F.lit("mcp_servers"), "id", "status").alias("event_id"), F.col("updated_at").alias("occurred_at"), scope.alias("s"),
        F.concat(F.lit("mcp."), "status").alias("action_type"), F.col("id").cast("string").alias("server_id"), "name", tools.alias("tools"),
    ).select("event_id", "occurred_at", "s.*", "action_type", "server_id", "name", "tools")


def from_skill_events(df: DataFrame) -> DataFrame:
    """Uses of skills by someone known; other events and those without user and org are left out."""
    require_columns(df, ["event_id", "event_type", "skill_id", "consumer_user_id", "consumer_org_id", "agent_id", "timestamp"])
    known = F.col("consumer_user_id").isNotNull() | F.col("consumer_org_id").isNotNull()
    return df.where(F.col("event_type").isin(*USE_EVENTS) & known).select(
        F.concat_ws(":", F.lit("skills"), "event_id").alias("event_id"), F.col("timestamp").alias("occurred_at"), scope_for(F.col("consumer_org_id"), F.col("consumer_user_id")).alias("s"),
        F.lit("skill.used").alias("action_type"), F.col("skill_id").cast("string").alias("skill_id"), F.col("agent_id").cast("string").alias("agent_id"), F.col("event_type").alias("use"),
    ).select("event_id", "occurred_at", "s.*", "action_type", "skill_id", "agent_id", "use")


def normalize_ledger(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of tuning-ledger entries; missing paths are none, a decision is adopted, rejected or null."""
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("action_type").isin(*LEDGER_ACTIONS), F.lit(False)), "action_type"),
        F.when(F.coalesce("hop_name", F.lit("")) == "", "hop_name"),
        F.when(~F.col("decision").isin("adopted", "rejected"), "decision"),
    )
    filled = df.withColumn("diff_paths", F.coalesce("diff_paths", F.array().cast("array<string>"))).withColumn("scope", F.lit("org")).withColumn("reject_reason", reason)
    return filled.where("reject_reason is null").drop("reject_reason"), filled.where("reject_reason is not null")


def ingest_telemetry(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(event_id, ingested_at, status, reason): each event by its route, accepted, duplicate or rejected."""
    ledger = F.coalesce(F.col("action_type").isin(*LEDGER_ACTIONS), F.lit(False))
    good, bad = normalize_ledger(batch.where(ledger))
    good_runs, bad_runs = normalize_runs(batch.where(~ledger))
    fit = good.select("event_id", "ingested_at").unionByName(good_runs.select("event_id", "ingested_at"))
    rejects = bad.select("event_id", "ingested_at", "reject_reason").unionByName(bad_runs.select("event_id", "ingested_at", "reject_reason"))
    taken = append_episodes(existing, fit).select("event_id", "ingested_at", "status", F.lit(None).cast("string").alias("reason"))
    return taken.unionByName(rejects.select("event_id", "ingested_at", F.lit("rejected").alias("status"), F.col("reject_reason").alias("reason")))


def draft_cases(deviations: DataFrame) -> DataFrame:
    """One eval case for each slug, from its least event_id; the seed is the slug's hash."""
    kind = F.coalesce("kind", F.lit("unknown"))
    named = deviations.withColumn("kind", kind).withColumn("slug", text.slug(F.coalesce("slug", F.concat(F.lit("dev-"), kind))))
    first = named.groupBy("slug").agg(F.min_by(F.struct("event_id", "kind", "expected"), "event_id").alias("d")).select("slug", "d.*")
    seed = F.conv(F.substring(F.sha2("slug", 256), 1, 6), 16, 10).cast("long") % 100_000
    return first.select(F.concat(F.lit("cand-"), "slug").alias("case_id"), seed.alias("seed"), F.coalesce(looked_up(TASK_CLASS, F.col("kind")), F.lit("diagnose")).alias("task_class"), "kind", F.coalesce("expected", F.lit("?")).alias("expected"), "event_id")


def markdown_lines(rows: DataFrame, key: list[str], order: list[str], line: Column) -> DataFrame:
    """The lines of each key in order, as one list in Markdown."""
    lines = F.array_sort(F.collect_list(F.struct(*order, F.concat(F.lit("- "), line).alias("_line"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("body"))


def split_messages(docs: DataFrame) -> DataFrame:
    """(doc_id, message, role, speaker, content) of transcripts.

    A line that opens with a role's name starts a message; in a text without
    such lines, a capitalised name does that recurs or is one of the two
    commonest, and user and assistant take turns.  Other lines that are not
    blank go on with the message before, or open the first one.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    head = F.when(F.col("line").contains(":"), F.trim(F.substring_index("line", ":", 1)))
    of_doc = Window.partitionBy("doc_id")
    marked = lines.withColumn("head", head).withColumn("by_role", looked_up(ROLES, F.lower("head"))).withColumn("has_roles", F.max(F.col("by_role").isNotNull()).over(of_doc))
    names = marked.where(F.col("head").rlike(r"^[A-Z][a-z]+( [A-Z][a-z]+)?$")).groupBy("doc_id", "head").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    named = names.withColumn("rank", F.row_number().over(of_doc.orderBy(F.desc("n"), "at"))).where("n >= 2 or rank <= 2").select("doc_id", "head", F.lit(True).alias("named"))
    met = marked.join(named, ["doc_id", "head"], "left")
    opens = F.when(F.col("has_roles"), F.col("by_role").isNotNull()).otherwise(F.col("named").isNotNull())
    in_order = of_doc.orderBy("pos")
    told = met.withColumn("opens", opens).where(F.col("opens") | (F.trim("line") != "")).withColumn("leads", ~F.col("opens") & (F.row_number().over(in_order) == 1))
    count = told.withColumn("starts", F.sum(F.col("opens").cast("int")).over(in_order)).withColumn("message", F.sum((F.col("opens") | F.col("leads")).cast("int")).over(in_order))
    rest = F.expr("substring(line, instr(line, ':') + 1)")
    body = F.when(F.col("opens"), F.trim(rest)).when(F.col("leads"), F.trim("line")).otherwise(F.col("line"))
    turn = F.when(F.col("starts") % 2 == 1, "user").otherwise("assistant")
    role = F.when(F.col("leads"), "user").when(F.col("opens"), F.when(F.col("has_roles"), F.col("by_role")).otherwise(turn))
    speaker = F.when(F.col("opens") & ~F.col("has_roles"), F.col("head"))
    sorted_lines = F.array_sort(F.collect_list(F.struct("pos", body.alias("line"))))
    return count.groupBy("doc_id", "message").agg(F.min_by(role, "pos").alias("role"), F.min_by(speaker, "pos").alias("speaker"), F.array_join(F.transform(sorted_lines, lambda x: x["line"]), "\n").alias("content"))


def annotate_stale(notes: DataFrame, stale: DataFrame) -> DataFrame:
    """Notes (note_id, body) whose lines say what has become of the first stale citation in them."""
    of_note = stale.groupBy("note_id").agg(F.array_sort(F.collect_set(F.struct("citation", "state"))).alias("_stale"))
    met = notes.join(of_note, "note_id", "left")
    mark = lambda line: F.get(F.filter(F.col("_stale"), lambda s: F.contains(line, s["citation"])), F.lit(0))["state"]
    lines = F.transform(F.split("body", "\n"), lambda x: F.coalesce(F.concat(x, F.lit("  ⚠ "), mark(x)), x))
    return met.withColumn("body", F.array_join(lines, "\n")).drop("_stale")


def notes_context(notes: DataFrame, budget: int) -> DataFrame:
    """(caller_id, n_notes, body, truncated): a caller's notes, most general first, until one goes over the budget.

    ``notes``: caller_id, place (1 org, 2 org workspace, 3 user, 4 user workspace), label, version, body.
    """
    block = F.concat(F.lit("\n# "), "label", F.lit(" (v"), F.col("version").cast("string"), F.lit(")\n"), "body")
    order = Window.partitionBy("caller_id").orderBy("place", "label")
    sized = notes.where(F.trim("body") != "").withColumn("block", block).withColumn("used", F.sum(F.char_length("block")).over(order))
    fits = F.col("used") <= budget
    kept = F.array_sort(F.collect_list(F.when(fits, F.struct("place", "label", "block"))))
    return sized.groupBy("caller_id").agg(F.count_if(fits).alias("n_notes"), F.array_join(F.transform(kept, lambda x: x["block"]), "").alias("body"), F.bool_or(~fits).alias("truncated"))


def profile(facts: DataFrame, acts: DataFrame, learnings: int = 10, recent: int = 10) -> DataFrame:
    """(caller_id, learnings, recent): facts by tier, newest first and each text once; what the caller did last."""
    rank = F.coalesce(*[F.when(F.col("tier") == t, i) for i, t in enumerate(TIERS)], F.lit(len(TIERS)))
    best = facts.where(F.trim("fact") != "").groupBy("caller_id", "fact").agg(F.min(F.struct(rank.alias("rank"), (-F.unix_micros("ingested_at")).alias("age"))).alias("o"))
    of_caller = Window.partitionBy("caller_id")
    known = best.withColumn("n", F.row_number().over(of_caller.orderBy("o", "fact"))).where(F.col("n") <= learnings)
    last = acts.withColumn("n", F.row_number().over(of_caller.orderBy(F.desc("at"), "action", "act_id"))).where(F.col("n") <= recent)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c])
    a, b = known.groupBy("caller_id").agg(in_order("fact").alias("learnings")), last.groupBy("caller_id").agg(in_order("action").alias("recent"))
    return a.join(b, "caller_id", "full")


def json_lines(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key..., line): each row as a line of JSON, columns in their order; written with ``write.text`` it is a JSONL file."""
    return df.select(*key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))


def json_summary(df: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """One JSON object of named aggregates over all rows."""
    return df.agg(*[c.alias(k) for k, c in figures.items()]).select(F.to_json(F.struct(*figures), {"ignoreNullFields": "false"}).alias("summary"))
