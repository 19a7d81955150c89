"""Queries of further producers, drafted cases, messages and bundles, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import intake
from annalist.plans.queries import load, register

STATE = "CASE p_partkey % 3 WHEN 0 THEN 'deployed' WHEN 1 THEN 'stopped' ELSE 'draft' END"


@register("S10_from_servers", f"""SELECT 'mcp_servers:' || p_partkey || ':' || {STATE} AS event_id, CASE WHEN p_partkey % 5 = 0 THEN 'global' ELSE 'user' END AS scope,
CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS VARCHAR) END AS scope_id, 'mcp.' || {STATE} AS action_type, array_to_string(string_split(p_name, ' '), '+') AS tools FROM part WHERE p_partkey % 3 < 2""")
def s10(spark, sf_dir):
    tools = F.transform(F.split("p_name", " "), lambda x: F.struct(x.alias("name")))
    kind = F.when(F.col("p_partkey") % 5 == 0, "platform").otherwise("user")
    servers = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("owner_user_id"), kind.alias("owner_type"), F.col("p_name").alias("name"), F.expr(STATE).alias("status"), tools.alias("tools_metadata"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    return intake.from_servers(servers).select("event_id", "scope", "scope_id", "action_type", F.array_join("tools", "+").alias("tools"))


USE = "CASE event_id % 5 WHEN 0 THEN 'body.loaded' WHEN 1 THEN 'file.loaded' WHEN 2 THEN 'script.executed' WHEN 3 THEN 'outcome' ELSE 'metadata.surfaced' END"


@register("S11_from_skill_events", f"""SELECT 'skills:' || event_id AS event_id, CASE WHEN user_id % 3 > 0 THEN 'org' ELSE 'user' END AS scope, CAST(CASE WHEN user_id % 3 > 0 THEN user_id % 3 ELSE user_id END AS VARCHAR) AS scope_id, event_type AS skill_id, {USE} AS use
FROM events WHERE event_id % 5 < 4 AND (user_id % 3 > 0 OR user_id % 7 > 0)""")
def s11(spark, sf_dir):
    u = F.col("user_id")
    loads = load(spark, sf_dir, "events").select("event_id", F.expr(USE).alias("event_type"), F.col("event_type").alias("skill_id"), F.when(u % 7 > 0, u).alias("consumer_user_id"), F.when(u % 3 > 0, u % 3).alias("consumer_org_id"), F.lit(None).cast("string").alias("agent_id"), F.col("ts").alias("timestamp"))
    return intake.from_skill_events(loads).select("event_id", "scope", "scope_id", "skill_id", "use")


def telemetry(spark, sf_dir):
    """Events as a telemetry batch: every other one an entry of the tuning ledger, the others runs; some break a rule, some are told twice."""
    i, none = F.col("event_id"), F.lit(None).cast("string")
    action = F.when(i % 2 == 0, F.when(i % 4 == 0, "hop.eval_scored").otherwise("hop.version_published")).otherwise("hop.run_outcome")
    won = F.when(i % 3 == 0, "error").otherwise("success")
    return load(spark, sf_dir, "events").select(
        (i - i % 10).alias("event_id"), F.col("ts").alias("ingested_at"), action.alias("action_type"), F.when(i % 7 > 0, F.col("event_type")).alias("hop_name"), F.when(i % 11 == 0, "maybe").when(i % 5 == 0, "adopted").alias("decision"), F.array().cast("array<string>").alias("diff_paths"),
        F.lit("d11.1").alias("contract"), won.alias("run_result"), F.when((i % 3 == 0) & (i % 9 > 0), "tool_error").alias("failure_class"), F.lit(1).alias("wall_ms"), F.lit("r").alias("role"), none.alias("run_id"),
    )


JUDGED = """WITH j AS (SELECT event_id, ts, event_id - event_id % 10 AS id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 7 = 0 THEN 'hop_name' WHEN event_id % 11 = 0 THEN 'decision' END WHEN event_id % 9 = 0 THEN 'failure_class_missing' END AS reason FROM events)"""


@register("S14_ledger_entries", f"{JUDGED} SELECT id AS event_id, ts AS ingested_at, CASE WHEN event_id % 5 = 0 THEN 'adopted' END AS decision, 'org' AS scope FROM j WHERE event_id % 2 = 0 AND reason IS NULL")
def s14(spark, sf_dir):
    rows, _ = intake.normalize_ledger(telemetry(spark, sf_dir).where("action_type <> 'hop.run_outcome'"))
    return rows.select("event_id", "ingested_at", "decision", "scope")


@register("S30_telemetry_batch", f"""{JUDGED}, fit AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS n FROM j WHERE reason IS NULL)
SELECT id AS event_id, ts AS ingested_at, CASE WHEN n > 1 OR id % 50 = 0 THEN 'duplicate' ELSE 'accepted' END AS status, reason FROM fit UNION ALL SELECT id, ts, 'rejected', reason FROM j WHERE reason IS NOT NULL""")
def s30(spark, sf_dir):
    batch = telemetry(spark, sf_dir)
    return intake.ingest_telemetry(batch, batch.where("event_id % 50 = 0").select("event_id"))


KIND = "CASE p_size % 5 WHEN 0 THEN 'refusal' WHEN 1 THEN 'correction' WHEN 2 THEN 'surprise' WHEN 3 THEN 'other' END"


@register("S29_draft_cases", f"""WITH d AS (SELECT p_partkey AS event_id, coalesce({KIND}, 'unknown') AS kind, trim(regexp_replace(lower(p_type || ' ' || p_size % 7), '[^a-z0-9]+', '-', 'g'), '-') AS slug, p_name AS expected FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY event_id) AS n FROM d)
SELECT 'cand-' || slug AS case_id, CAST(('0x' || substr(sha256(slug), 1, 6)) AS BIGINT) % 100000 AS seed, CASE kind WHEN 'refusal' THEN 'refuse' WHEN 'correction' THEN 'ask' ELSE 'diagnose' END AS task_class, kind, expected, event_id FROM f WHERE n = 1""")
def s29(spark, sf_dir):
    named = F.concat_ws(" ", "p_type", (F.col("p_size") % 7).cast("string"))
    return intake.draft_cases(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("event_id"), F.expr(KIND).alias("kind"), named.alias("slug"), F.col("p_name").alias("expected")))


@register("S28_markdown_lines", "SELECT o_custkey, string_agg('- ' || o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY o_orderdate, o_orderkey) AS body FROM orders GROUP BY 1")
def s28(spark, sf_dir):
    return intake.markdown_lines(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus"))


@register("X2_chunks_lines")
def x2(spark, sf_dir):
    pieces = text.chunk_paragraphs(F.col("text"), 400, text.pack_lines)
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("ordinal", "content"))


@register("X29_messages")
def x29(spark, sf_dir):
    order = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    told = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(order, lambda x: x["line"]), "\n").alias("text"))
    return intake.split_messages(told)


@register("K12_notes_context", """WITH b AS (SELECT o_custkey AS caller_id, o_orderkey % 4 + 1 AS place, chr(10) || '# ' || o_orderkey || ' (v1)' || chr(10) || o_orderpriority AS block, CAST(o_orderkey AS VARCHAR) AS label FROM orders),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY caller_id ORDER BY place, label ROWS UNBOUNDED PRECEDING) AS used FROM b)
SELECT caller_id, count(*) FILTER (used <= 120) AS n_notes, coalesce(string_agg(block, '' ORDER BY place, label) FILTER (used <= 120), '') AS body, bool_or(used > 120) AS truncated FROM u GROUP BY 1""")
def k12(spark, sf_dir):
    key = F.col("o_orderkey")
    notes = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("caller_id"), (key % 4 + 1).alias("place"), key.cast("string").alias("label"), F.lit(1).alias("version"), F.col("o_orderpriority").alias("body"))
    return intake.notes_context(notes, 120)


@register("K11_profile", """WITH f AS (SELECT user_id, event_type || ' ' || event_id % 6 AS fact, CASE event_id % 4 WHEN 0 THEN 3 ELSE event_id % 4 - 1 END AS rank, ts FROM events),
b AS (SELECT user_id, fact, min((rank, -epoch_us(ts))) AS o FROM f GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, fact) AS n FROM b),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type, event_id) AS n FROM events)
SELECT x.user_id AS caller_id, learnings, recent FROM (SELECT user_id, string_agg(fact, '|' ORDER BY n) AS learnings FROM k WHERE n <= 10 GROUP BY 1) x JOIN (SELECT user_id, string_agg(event_type, '|' ORDER BY n) AS recent FROM a WHERE n <= 10 GROUP BY 1) y USING (user_id)""")
def k11(spark, sf_dir):
    events, i = load(spark, sf_dir, "events"), F.col("event_id")
    tier = F.when(i % 4 == 1, intake.TIERS[0]).when(i % 4 == 2, intake.TIERS[1]).when(i % 4 == 3, intake.TIERS[2])
    facts = events.select(F.col("user_id").alias("caller_id"), F.concat_ws(" ", "event_type", (i % 6).cast("string")).alias("fact"), tier.alias("tier"), F.col("ts").cast("timestamp").alias("ingested_at"))
    acts = events.select(F.col("user_id").alias("caller_id"), F.col("ts").alias("at"), F.col("event_type").alias("action"), i.alias("act_id"))
    return intake.profile(facts, acts).select("caller_id", F.array_join("learnings", "|").alias("learnings"), F.array_join("recent", "|").alias("recent"))
