"""Queries of visibility, governance, lifecycle and graph operators, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import scores, text
from annalist.operators import compose, extract, feedback, governance, graph, ledger, retrieve, temporal, visibility
from annalist.plans.queries import NOW, load, now, observations, register, runs_of, RESULT, RUNS

SCOPES = "['global','org','team','user'][1 + event_id % 4]"
SCOPE_ID = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(user_id % 3 AS VARCHAR) WHEN 2 THEN event_type ELSE CAST(user_id AS VARCHAR) END"


def scoped(spark, sf_dir):
    """Events as rows of four scopes in three tenants."""
    i, u = F.col("event_id"), F.col("user_id")
    scope = F.element_at(F.array(*map(F.lit, ("global", "org", "team", "user"))), (1 + i % 4).cast("int"))
    scope_id = F.when(i % 4 == 1, (u % 3).cast("string")).when(i % 4 == 2, F.col("event_type")).when(i % 4 == 3, u.cast("string"))
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", (u % 3).cast("string").alias("org_id"), scope.alias("scope"), scope_id.alias("scope_id"))


@register("P1_scope_filter", f"SELECT event_id FROM events WHERE event_id % 4 = 0 OR (user_id % 3 = 1 AND ((event_id % 4 = 1) OR (event_id % 4 = 2 AND event_type = 'click') OR (event_id % 4 = 3 AND user_id = 7)))")
def p1(spark, sf_dir):
    wanted = spark.createDataFrame([("1", "global", None), ("1", "org", "1"), ("1", "team", "click"), ("1", "user", "7")], "org_id string, scope string, scope_id string")
    return governance.scope_filter(scoped(spark, sf_dir), wanted).select("event_id")


@register("P4_no_scopes", "SELECT event_id FROM events WHERE false")
def p4(spark, sf_dir):
    return governance.scope_filter(scoped(spark, sf_dir), spark.createDataFrame([], "org_id string, scope string, scope_id string")).select("event_id")


@register("P2_browse_filter", "SELECT event_id FROM events WHERE event_id % 4 = 0 OR (user_id % 3 = 1 AND (event_id % 4 = 1 OR (event_id % 4 = 2 AND event_type IN ('click', 'view')) OR (event_id % 4 = 3 AND user_id = 7)))")
def p2(spark, sf_dir):
    return visibility.browse_filter(scoped(spark, sf_dir), "1", "7", ["click", "view"]).select("event_id")


@register("P5_classification", f"SELECT CASE event_id % 4 WHEN 0 THEN 'public' WHEN 3 THEN 'personal' ELSE 'internal' END AS class, count(*) AS n FROM events GROUP BY 1")
def p5(spark, sf_dir):
    return scoped(spark, sf_dir).groupBy(governance.classification(F.col("scope")).alias("class")).agg(F.count("*").alias("n"))


@register("P7_overlap", f"{RUNS} SELECT count(*) AS n FROM runs WHERE (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-10') AND valid_at < TIMESTAMP '2024-01-11'")
def p7(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    edges = temporal.supersede(observations(load(spark, sf_dir, "events")), ["user_id"])
    return edges.where(scores.windows_overlap(F.col("valid_at"), F.col("invalid_at"), day("2024-01-10"), day("2024-01-11"))).agg(F.count("*").alias("n"))


@register("P9_nodes_live_at", f"{RUNS}, mid AS (SELECT max(ts) - INTERVAL 10 DAY AS t FROM events), live AS (SELECT * FROM runs, mid WHERE valid_at <= t AND (invalid_at IS NULL OR invalid_at > t)) SELECT 'u' || user_id AS node_id FROM live UNION SELECT dst FROM live")
def p9(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    edges = temporal.supersede(observations(events), ["user_id"]).select(F.concat(F.lit("u"), "user_id").alias("src_id"), F.col("dst").alias("dst_id"), "valid_at", "invalid_at")
    nodes = events.select(F.concat(F.lit("u"), "user_id").alias("node_id")).unionByName(events.select(F.col("event_type").alias("node_id"))).distinct()
    return visibility.nodes_live_at(nodes, edges, events.agg(F.max("ts") - F.expr("INTERVAL 10 DAYS")).scalar())


CHUNK_COUNT = "CAST(greatest((length(coalesce(text,''))-1)//1000, 0) + 1 AS BIGINT)"


@register("P10_chunks_as_of", f"SELECT doc_id, {CHUNK_COUNT} AS n FROM documents WHERE CASE WHEN lang = 'en' THEN doc_id % 7 ELSE doc_id % 5 END <= 3")
def p10(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    dated = docs.select("doc_id", F.when(F.col("lang") == "en", day(F.col("doc_id") % 7)).alias("valid_at"), day(F.col("doc_id") % 5).alias("ingested_at"))
    return visibility.chunks_as_of(retrieve.chunks_of(docs), dated, F.lit("2024-01-04").cast("date")).groupBy("doc_id").agg(F.count("*").alias("n"))


@register("P11_topic_filter", "SELECT event_id FROM events WHERE user_id % 4 = 0 OR event_type = 'click' OR user_id = 7")
def p11(spark, sf_dir):
    u = F.col("user_id")
    rows = load(spark, sf_dir, "events").select("event_id", F.when(u % 4 != 0, F.concat_ws("/", F.lit("u"), u, "event_type")).alias("topic"))
    grants = spark.createDataFrame([("7", "u/*/click"), ("7", "u/{me}/*"), ("8", "*")], "caller_id string, pattern string")
    return visibility.topic_filter(rows, grants, "7").select("event_id")


@register("P12_routes", "SELECT event_id, CASE event_type WHEN 'click' THEN 'github_pr,repo_files,langgraph_store' WHEN 'view' THEN 'docs,decisions' END AS sources FROM events")
def p12(spark, sf_dir):
    route = F.when(F.col("event_type") == "click", "coding_assistant").when(F.col("event_type") == "view", "onboarding").otherwise("other")
    return visibility.route_sources(load(spark, sf_dir, "events").withColumn("route", route)).select("event_id", F.array_join("sources", ",").alias("sources"))


@register("P13_kind_filter", "SELECT 'm' || p_partkey AS node_id FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'v' || p_partkey FROM part WHERE p_partkey % 3 = 0")
def p13(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    key = F.concat(F.element_at(F.array(*map(F.lit, ("state:", "pref:", "record:"))), (1 + F.col("p_partkey") % 3).cast("int")), "p_partkey")
    one = lambda p, kind, k: part.select(F.concat(F.lit(p), "p_partkey").alias("node_id"), F.lit(kind).alias("type"), k.alias("key"))
    nodes = one("m", "Metric", key).unionByName(one("v", "MetricValue", F.lit(None).cast("string"))).unionByName(one("f", "Fact", F.lit(None).cast("string")))
    edges = part.select(F.concat(F.lit("m"), "p_partkey").alias("src_id"), F.concat(F.lit("v"), "p_partkey").alias("dst_id"), F.lit("HAS_VALUE").alias("type"))
    return visibility.kind_filter(nodes, edges, "state").select("node_id")


@register("P15_authorize_writes", """SELECT event_id, CASE WHEN CASE event_id % 4 WHEN 0 THEN user_id % 5 = 0 ELSE user_id % 5 < 2 OR (event_id % 4 = 1) OR (event_id % 4 = 2 AND event_type = 'view') OR event_id % 4 = 3 END THEN NULL
ELSE 'scope:' || ['global','org','team','user'][1 + event_id % 4] END AS deny_reason FROM events""")
def p15(spark, sf_dir):
    rows = scoped(spark, sf_dir).withColumn("caller_id", F.col("user_id").cast("string"))
    role = F.element_at(F.array(*map(F.lit, ("service", "admin", "member", "member", "member"))), (1 + F.col("user_id") % 5).cast("int"))
    callers = rows.select("caller_id", role.alias("role"), "org_id", F.array(F.lit("view")).alias("writable")).distinct()
    return visibility.authorize_writes(rows, callers).select("event_id", "deny_reason")


@register("P16_ledger_browse", "SELECT event_id, 'dropped' AS status FROM events WHERE event_id % 11 <> 0 AND event_id % 7 = 0 ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def p16(spark, sf_dir):
    i = F.col("event_id")
    rows = load(spark, sf_dir, "events").select("event_id", F.col("ts").alias("occurred_at"), F.when(i % 11 == 0, F.col("ts")).alias("dead_at"), F.when(i % 7 == 0, "policy").alias("dropped_reason"), (i % 2 == 0).alias("processed"))
    return ledger.list_episodes(rows, "dropped", 10, 50).select("event_id", "status")


@register("G4_drop_reason", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'deny_source:click' WHEN user_id % 2 = 0 AND event_type <> 'view' THEN 'not_allowed_source:' || event_type END AS reason FROM events")
def g4(spark, sf_dir):
    allow = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("view"), F.lit("click")))
    return load(spark, sf_dir, "events").select("event_id", governance.drop_reason(F.col("event_type"), F.array(F.lit("click")), allow).alias("reason"))


@register("G9_salience", f"SELECT event_id, round_even(0.5 * exp(-greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0) / 365) + 0.5 * (event_id % 4) / 4.0, 3) AS salience FROM events")
def g9(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.col("ts").alias("valid_at"), ((F.col("event_id") % 4) / 4.0).alias("distinctiveness"))
    return governance.salience(rows, now()).select("event_id", "salience")


@register("G8_recency", f"SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE exp(-greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0) / 365) END, 9) AS recency FROM events")
def g8(spark, sf_dir):
    dated = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    return load(spark, sf_dir, "events").select("event_id", F.round(scores.recency(dated, now()), 9).alias("recency"))


@register("G14_pii_in_node", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'national-id' ELSE '' END AS kinds FROM part")
def g14(spark, sf_dir):
    k = F.col("p_partkey") % 3
    nodes = load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(k == 0, "ask a.b@example.org now").alias("summary"), F.create_map(F.lit("note"), F.when(k == 1, "id 123-45-6789").otherwise(F.lit(""))).alias("props"))
    return governance.pii_in_node(nodes).select("p_partkey", F.array_join("pii", ",").alias("kinds"))


@register("G15_purge", "SELECT event_type, count(*) AS n FROM events WHERE NOT (event_id % 4 = 3 AND user_id % 5 = 0) GROUP BY 1")
def g15(spark, sf_dir):
    rows = scoped(spark, sf_dir)
    gone = rows.where("user_id % 5 = 0").select(F.lit("user").alias("scope"), F.col("user_id").cast("string").alias("scope_id"))
    return governance.purge(rows, gone, ["scope", "scope_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@register("G16_forget_documents", f"SELECT count(*) AS n_docs, CAST(sum({CHUNK_COUNT}) AS BIGINT) AS n_chunks FROM documents WHERE lang <> 'de'")
def g16(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    gone = docs.where("lang = 'de'").select("doc_id")
    chunks = governance.purge(retrieve.chunks_of(docs), gone, ["doc_id"]).agg(F.count("*").alias("n_chunks"))
    return governance.purge(docs, gone, ["doc_id"]).agg(F.count("*").alias("n_docs")).crossJoin(chunks)


@register("G17_curation_listing", f"SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN {CHUNK_COUNT} - 1 ELSE 0 END AS INTEGER) AS max_served FROM documents")
def g17(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return governance.curation_listing(docs, retrieve.chunks_of(docs.where("lang = 'en'")).withColumn("served_count", F.col("ordinal"))).select("doc_id", "max_served")


@register("G21_close_expired", f"{RUNS} SELECT dst, count(*) FILTER (WHERE invalid_at IS NULL AND user_id % 3 <> 0) AS n_open FROM runs GROUP BY 1")
def g21(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    edges = temporal.supersede(observations(events), ["user_id"]).select(F.col("user_id").cast("string").alias("src_id"), F.col("dst").alias("dst_id"), F.col("valid_at").cast("timestamp"), F.col("invalid_at").cast("timestamp"), F.col("expired_at").cast("timestamp"))
    nodes = events.select(F.col("user_id").cast("string").alias("node_id"), F.lit("committed").alias("status"), F.when(F.col("user_id") % 3 == 0, F.lit("2024-02-01").cast("timestamp")).alias("expires_at")).distinct()
    _, closed = governance.close_expired(nodes, edges, now())
    return closed.groupBy(F.col("dst_id").alias("dst")).agg(F.count_if(F.col("invalid_at").isNull()).alias("n_open"))


@register("G22_retract", "SELECT c_custkey AS node_id, CASE WHEN c_custkey % 4 = 0 THEN 'retracted' ELSE 'committed' END AS status, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS reason FROM customer")
def g22(spark, sf_dir):
    nodes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.lit("committed").alias("status"), "c_mktsegment")
    return governance.retract(nodes.drop("c_mktsegment"), nodes.where("node_id % 4 = 0").withColumnRenamed("c_mktsegment", "reason")).select("node_id", "status", "reason")


@register("G23_endorse", """WITH r AS (SELECT user_id % 20 AS node_id, CAST(user_id AS VARCHAR) AS u, max_by(event_type, (ts, event_type)) AS last FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2)
SELECT node_id, string_agg(u, ',' ORDER BY u) FILTER (WHERE last = 'click') AS endorsed FROM r GROUP BY 1""")
def g23(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    op = F.when(F.col("event_type") == "click", "endorse").otherwise("withdraw")
    # as in the SQL, the later of two words at one instant is the one that sorts last by its event
    requests = e.select((F.col("user_id") % 20).alias("node_id"), F.col("user_id").cast("string").alias("user_id"), op.alias("op"), F.struct("ts", "event_type").alias("at"))
    nodes = requests.select("node_id").distinct().withColumn("endorsed_by", F.array().cast("array<string>"))
    return governance.endorse(nodes, requests).select("node_id", F.nullif(F.array_join("endorsed_by", ","), F.lit("")).alias("endorsed"))


@register("G24_publish", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'refused' WHEN 1 THEN 'merged' WHEN 2 THEN 'contested' ELSE 'published' END AS outcome, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 2 THEN 'k' || p_partkey || '~u' ELSE 'k' || p_partkey END AS shared_key FROM part")
def g24(spark, sf_dir):
    part, k = load(spark, sf_dir, "part"), F.col("p_partkey") % 4
    own = part.select("p_partkey", F.lit("Fact").alias("type"), F.concat(F.lit("k"), "p_partkey").alias("key"), F.col("p_name").alias("name"), F.when(k == 0, "mail x@example.org").otherwise("none").alias("summary"), F.lit("u").alias("user_id"))
    shared = own.where("p_partkey % 4 in (1, 2)").select("type", "key", F.when(k == 1, F.col("name")).otherwise("other").alias("name"))
    return governance.publish(own, shared).select("p_partkey", "outcome", "shared_key")


@register("G25_depart", "SELECT 'events' AS \"table\", count(*) FILTER (WHERE event_id % 4 = 3 AND user_id = 7) AS removed FROM events UNION ALL SELECT 'views', count(*) FILTER (WHERE event_id % 4 = 3 AND user_id = 7) FROM events WHERE event_type = 'view'")
def g25(spark, sf_dir):
    rows = scoped(spark, sf_dir)
    left, certificate = governance.depart({"events": rows, "views": rows.where("event_type = 'view'")}, "7")
    counts = F.from_json("counts", "array<struct<table:string,removed:bigint>>")
    return certificate.select(F.inline(counts))


@register("G26_ingest_status", "SELECT CASE event_id % 6 WHEN 0 THEN 'processed' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'consent_blocked' WHEN 3 THEN 'declined' WHEN 4 THEN 'declined' ELSE 'policy_dropped' END AS status, count(*) AS n FROM events GROUP BY 1")
def g26(spark, sf_dir):
    reasons = F.array(F.lit(None).cast("string"), *map(F.lit, ("duplicate", "consent:off", "salience:0.1", "budget:x:2/2", "deny_source:x")))
    status = governance.ingest_status(F.get(reasons, (F.col("event_id") % 6).cast("int")))
    return load(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@register("G27_apply_dim_changes", """WITH c AS (SELECT user_id AS k, NULLIF(event_type, 'error') AS v, ts FROM events), a AS (SELECT k, arg_max_null(v, ts) AS v, count(*) + 1 AS version FROM c GROUP BY 1)
SELECT k, v, version FROM a WHERE v IS NOT NULL""")
def g27(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.nullif(F.col("event_type"), F.lit("error")).alias("v"), F.col("ts").cast("timestamp").alias("at"))
    dim = e.select("k", F.lit("first").alias("v")).distinct()
    return governance.apply_dim_changes(dim, e, ["k"], "v")


@register("B6_end_entities", """WITH t AS (SELECT user_id AS k, max_by(event_type, ts) AS last FROM events WHERE event_type IN ('click', 'error') GROUP BY 1), n AS (SELECT DISTINCT user_id AS k FROM events)
SELECT k, CASE WHEN k % 10 <> 0 AND last = 'error' THEN 'ended' WHEN k % 10 <> 0 AND last = 'click' AND k % 3 = 0 THEN 'committed' WHEN k % 3 = 0 THEN 'ended' ELSE 'committed' END AS status FROM n LEFT JOIN t USING (k)""")
def b6(spark, sf_dir):
    e, k = load(spark, sf_dir, "events"), F.col("user_id")
    nodes = e.select(k.alias("key"), F.when(k % 10 == 0, "Metric").otherwise("Agent").alias("type"), F.when(k % 3 == 0, "ended").otherwise("committed").alias("status")).distinct()
    said = e.where("event_type in ('click', 'error')").select(k.alias("key"), F.when(F.col("event_type") == "error", "absent").otherwise("present").alias("presence"), F.col("ts").alias("at"))
    return graph.end_entities(nodes, said).select(F.col("key").alias("k"), "status")


@register("B11_resolve_alias", """SELECT 'k' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key, 'k' || lpad(CAST(c_custkey - c_custkey % 25 AS VARCHAR), 9, '0') AS canonical FROM customer""")
def b11(spark, sf_dir):
    name = lambda c: F.concat(F.lit("k"), F.lpad(c.cast("string"), 9, "0"))
    k = F.col("c_custkey")
    last = F.max("c_custkey").over(graph.Window.partitionBy())
    chain = load(spark, sf_dir, "customer").withColumn("last", last).select(name(k).alias("key"), F.when((k % 25 != 24) & (k < F.col("last")), F.array(name(k + 1))).alias("aliases"))
    return graph.resolve_alias(chain)


@register("B13_invalidate_contradictions", "SELECT s_suppkey AS edge_id, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS closed FROM supplier")
def b13(spark, sf_dir):
    k = F.col("s_suppkey")
    # every third supplier says that it ships there; a second statement of the same source denies it
    said = F.when(k % 2 == 0, "we ship goods there").otherwise("warehouse is open daily")
    edges = load(spark, sf_dir, "supplier").select(k.alias("edge_id"), k.alias("src_id"), F.lit("STATES").alias("type"), F.concat(F.lit("a"), k).alias("dst_id"), said.alias("fact"), F.lit("2024-01-01").cast("timestamp").alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
    denied = edges.where("src_id % 3 = 0").select((F.col("edge_id") + 1_000_000).alias("edge_id"), "src_id", "type", F.concat(F.lit("b"), "src_id").alias("dst_id"), F.lit("we do not ship goods").alias("fact"), F.lit("2024-01-05").cast("timestamp").alias("valid_at"), "invalid_at")
    return graph.invalidate_contradictions(edges.unionByName(denied)).where("edge_id < 1000000").select("edge_id", F.col("invalid_at").isNotNull().alias("closed"))


@register("B14_contested", "SELECT c_custkey AS node_id, c_custkey % 5 = 0 OR (c_custkey % 5 = 1 AND c_custkey > 0) AS contested FROM customer")
def b14(spark, sf_dir):
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    edges = c.where("c_custkey % 5 = 0").select(k.alias("src_id"), (k + 1).alias("dst_id"), F.lit("CONTRADICTS").alias("type"), F.lit(None).cast("timestamp").alias("invalid_at"))
    closed = c.where("c_custkey % 5 = 3").select(k.alias("src_id"), (k + 1).alias("dst_id"), F.lit("CONTRADICTS").alias("type"), now().alias("invalid_at"))
    return graph.contested(c.select(k.alias("node_id")), edges.unionByName(closed)).select("node_id", "contested")


@register("B18_lift", """WITH n AS (SELECT 'n' || c_nationkey AS unit_id, c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN 'endorsed' WHEN c_custkey % 3 = 1 THEN 'corroborated' ELSE 'probation' END AS tier FROM customer)
SELECT 'r' || n_regionkey AS unit_id, name, max(tier) AS tier, count(*) AS observed_count FROM n JOIN nation ON unit_id = 'n' || n_nationkey WHERE tier <> 'probation' GROUP BY 1, 2""")
def b18(spark, sf_dir):
    from annalist.plans.queries import units

    k = F.col("c_custkey") % 3
    nodes = load(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("unit_id"), F.col("c_mktsegment").alias("name"), F.when(k == 0, "endorsed").when(k == 1, "corroborated").otherwise("probation").alias("tier"), F.lit(False).alias("lifted"))
    return graph.lift(nodes, units(spark, sf_dir)).select("unit_id", "name", "tier", "observed_count")


@register("B19_validate_tree", "SELECT 'c' || c_custkey AS unit_id, 'duplicate_name' AS problem FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'x' || s_suppkey, p FROM supplier, (SELECT unnest(['missing_parent', 'no_root']) AS p) WHERE s_suppkey % 2 = 0")
def b19(spark, sf_dir):
    from annalist.plans.queries import units

    names = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("unit_id"), F.col("c_mktsegment").alias("name"))
    lost = load(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("x"), "s_suppkey").alias("unit_id"), F.concat(F.lit("gone"), "s_suppkey").alias("parent_id"), F.lit("x").alias("name"))
    tree = units(spark, sf_dir).join(names, "unit_id", "left").withColumn("name", F.coalesce("name", "unit_id"))
    return graph.validate_tree(tree.select("unit_id", "parent_id", "name").unionByName(lost))


@register("B20_build_registry", """SELECT DISTINCT user_id % 3 AS org_id, event_type AS name, last_value(CASE WHEN event_id % 2 = 0 THEN 'v' || event_id END IGNORE NULLS) OVER w AS version, last_value(CASE WHEN event_id % 3 = 0 THEN user_id END IGNORE NULLS) OVER w AS owner, last_value(event_id) OVER w AS contract
FROM events WINDOW w AS (PARTITION BY user_id % 3, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def b20(spark, sf_dir):
    i = F.col("event_id")
    rows = load(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("org_id"), F.col("event_type").alias("name"), F.when(i % 2 == 0, F.concat(F.lit("v"), i)).alias("version"), F.when(i % 3 == 0, F.col("user_id")).alias("owner"), F.lit("on").alias("mode"), i.alias("contract"), F.col("ts").alias("at"), i)
    return graph.build_registry(rows).select("org_id", "name", "version", "owner", "contract")


@register("T1_neighbours", """WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT o.o_orderkey AS query_id, count(DISTINCT y.b) - 1 AS n FROM orders o JOIN d x ON x.a = 'o' || o.o_orderkey JOIN d y ON y.a = x.b WHERE o.o_orderkey % 10 = 0 GROUP BY 1 HAVING count(DISTINCT y.b) > 1""")
def t1(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    edges = orders.select(F.concat(F.lit("c"), "o_custkey").alias("src_id"), F.concat(F.lit("o"), "o_orderkey").alias("dst_id"))
    starts = orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("o"), "o_orderkey").alias("node_id"))
    return graph.hops(starts, edges, 2).where("hops = 2").groupBy("query_id").agg(F.count("*").alias("n"))


@register("T4_expand_values", f"{RUNS} SELECT user_id AS node_id, dst AS value_id FROM runs WHERE invalid_at IS NULL AND user_id % 2 = 0")
def t4(spark, sf_dir):
    edges = temporal.supersede(observations(load(spark, sf_dir, "events")), ["user_id"]).select(F.col("user_id").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("HAS_VALUE").alias("type"), "valid_at", "invalid_at")
    hits = edges.select(F.col("src_id").alias("node_id")).where("node_id % 2 = 0").distinct()
    return graph.expand_values(hits, edges).select("node_id", "value_id")


@register("T5_current_values", f"{RUNS} SELECT user_id, dst FROM runs WHERE invalid_at IS NULL AND (CAST(user_id AS VARCHAR) LIKE '1%' OR CAST(user_id AS VARCHAR) LIKE '2%')")
def t5(spark, sf_dir):
    edges = temporal.supersede(observations(load(spark, sf_dir, "events")), ["user_id"]).withColumn("anchor_key", F.concat(F.lit("state:"), "user_id"))
    return graph.current_values(edges, ["state:1", "state:2"]).select("user_id", "dst")


TERMS = "list_distinct(list_transform(regexp_extract_all({}, '[a-zA-Z0-9_]{{3,}}'), lambda t: lower(t)))"


@register("T6_inject_values", f"""WITH q AS (SELECT s_suppkey AS query_id, unnest({TERMS.format('p_name')}) AS term FROM supplier JOIN part ON p_partkey = s_suppkey), a AS (SELECT p_partkey AS anchor_id, unnest({TERMS.format('p_name')}) AS term FROM part)
SELECT query_id, anchor_id, count(*) AS overlap FROM a JOIN q USING (term) GROUP BY 1, 2 HAVING count(*) >= 2""")
def t6(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    asked = load(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.col("p_name").alias("question"))
    return graph.inject_values(asked, part.select(F.col("p_partkey").alias("anchor_id"), F.col("p_name").alias("anchor_key"))).select("query_id", "anchor_id", "overlap")


@register("T9_latest_decisions", "WITH d AS (SELECT event_type AS base, user_id AS turn, max_by(CASE WHEN value > 50 THEN 'accepted' ELSE 'declined' END, (ts, event_id)) AS decision FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2) SELECT p.base, p.turn, coalesce(decision, 'pending') AS decision FROM (SELECT DISTINCT event_type AS base, user_id AS turn FROM events) p LEFT JOIN d USING (base, turn)")
def t9(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    proposals = e.select(F.concat("event_type", F.lit("-ro")).alias("hop"), F.col("user_id").alias("turn")).distinct()
    decisions = e.where("user_id % 2 = 0").select(F.col("event_type").alias("hop"), F.col("user_id").alias("turn"), F.when(F.col("value") > 50, "accepted").otherwise("declined").alias("decision"), F.struct("ts", "event_id").alias("at"))
    return graph.latest_decisions(proposals, decisions).select("base", "turn", "decision")


@register("K4_rank_passages", f"""WITH s AS (SELECT user_id AS query_id, event_id AS doc_id, round(value * greatest(0.35, power(2.0, -greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0) / 180)) * CASE WHEN event_type = 'error' THEN 0.6 ELSE 1.0 END, 9) AS final FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, final, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def k4(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), F.lit(0).alias("ordinal"), F.col("value").alias("score"), F.col("ts").alias("valid_at"), (F.col("event_type") == "error").alias("failed"))
    return compose.rank_passages(rows, now()).select("query_id", "doc_id", "final", "rank")


@register("K9_enforce_citations", "SELECT o_orderkey AS query_id, 'see [' || o_orderkey || '] and ' AS answer, 1 AS n_false FROM orders")
def k9(spark, sf_dir):
    k = F.col("o_orderkey")
    answers = load(spark, sf_dir, "orders").select(k.alias("query_id"), F.concat(F.lit("see ["), k, F.lit("] and [x"), k, F.lit("]")).alias("answer"))
    return compose.enforce_citations(answers, answers.select("query_id", F.array("query_id").alias("node_ids"))).select("query_id", "answer", "n_false")


@register("N1_parse_sections", "SELECT p_partkey AS note_id, s.section, s.body, CASE WHEN s.section = 'odd' THEN 'unknown_section' END AS error FROM (SELECT p_partkey, unnest([{'section': 'summary', 'body': p_name}, {'section': 'decisions', 'body': p_type}, {'section': 'odd', 'body': p_brand}]) AS s FROM part)")
def n1(spark, sf_dir):
    body = F.concat_ws("\n", F.lit("## Summary"), "p_name", F.lit("## decisions"), "p_type", F.lit("## odd"), "p_brand")
    return compose.parse_sections(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("note_id"), body.alias("body")))


@register("N4_stale_citations", "SELECT o_orderkey AS note_id, 'e' || o_orderkey AS edge_id FROM orders WHERE o_orderkey % 3 <> 0")
def n4(spark, sf_dir):
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    notes = o.select(k.alias("note_id"), F.concat(F.lit("- as in [edge:e"), k, F.lit("]")).alias("body"))
    edges = o.where("o_orderkey % 3 <> 1").select(F.concat(F.lit("e"), k).alias("edge_id"), F.when(k % 3 == 2, now()).alias("invalid_at"))
    return compose.stale_citations(notes, edges)


@register("A8_deviations", "SELECT event_type AS hop, user_id % 7 AS kind, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list('s' || user_id))), 1, 5), ',') AS slugs FROM events GROUP BY 1, 2")
def a8(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("hop"), (F.col("user_id") % 7).alias("kind"), F.concat(F.lit("s"), "user_id").alias("slug"))
    return feedback.deviations(rows).withColumn("slugs", F.array_join("slugs", ","))


@register("A10_propose_stalls", f"WITH r AS (SELECT event_type AS task, user_id % 10 AS org_id, {RESULT} AS res FROM events) SELECT task, org_id, 'raise_turn_budget' AS proposal FROM r GROUP BY 1, 2 HAVING count(*) >= 30 AND round(count(*) FILTER (WHERE res = 'max_turns') / count(*), 6) >= 0.05")
def a10(spark, sf_dir):
    stats = feedback.run_stats(runs_of(load(spark, sf_dir, "events")), ["task", "org_id"])
    return feedback.propose_stalls(stats, 0.05).select("task", "org_id", "proposal")


@register("A17_gc_report", "WITH n AS (SELECT user_id, min(ts) AS created_at, count(*) FILTER (WHERE event_type = 'view' AND value > 90) AS served FROM events GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (WHERE served > 0) AS ever_served, count(*) FILTER (WHERE served >= 3) AS hot, count(*) FILTER (WHERE served = 0 AND created_at < TIMESTAMP '2024-03-01' - INTERVAL 30 DAY) AS unserved_old FROM n")
def a17(spark, sf_dir):
    served = F.count_if((F.col("event_type") == "view") & (F.col("value") > 90))
    nodes = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"), F.nullif(served, F.lit(0)).alias("served_count"))
    return feedback.gc_report(nodes, F.lit(NOW).cast("timestamp_ntz"))


@register("S2_normalize_envelope", "SELECT CASE WHEN event_id % 4 = 3 AND user_id % 2 = 0 THEN 'scope_id_missing' END AS reject_reason, ['global','org','team','user'][1 + event_id % 4] AS scope, count(*) AS n FROM events GROUP BY 1, 2")
def s2(spark, sf_dir):
    bare = F.when((F.col("scope") == "org") | ((F.col("scope") == "user") & (F.col("user_id") % 2 == 0)), None).otherwise(F.col("scope_id"))
    rows = scoped(spark, sf_dir).withColumn("scope_id", bare).withColumn("scope", F.when(F.col("scope") != "user", F.col("scope"))).withColumn("content", F.lit("x"))
    ok, rejects = ledger.normalize_envelope(rows, False)
    both = ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects)
    return both.groupBy("reject_reason", "scope").agg(F.count("*").alias("n"))


@register("S3_items_to_envelopes", "SELECT 'docs:' || doc_id AS event_id, CASE WHEN lang = 'en' THEN 'team' ELSE 'org' END AS scope, 'document.observed' AS action_type, n_chars FROM documents")
def s3(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    meta = F.when(F.col("lang") == "en", F.create_map(F.lit("scope"), F.lit("team"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    items = docs.select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"), F.lit(NOW).cast("timestamp").alias("occurred_at"), meta.alias("metadata"))
    out = ledger.items_to_envelopes(items, "docs")
    n = F.char_length(F.get_json_object("payload", "$.statement")).cast("long")
    return out.select("event_id", "scope", "action_type", n.alias("n_chars"))


@register("S7_scope_for", "SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'org' ELSE 'user' END AS scope, CAST(CASE WHEN user_id % 3 > 0 THEN user_id % 3 ELSE user_id END AS VARCHAR) AS scope_id FROM events")
def s7(spark, sf_dir):
    org = F.nullif(F.col("user_id") % 3, F.lit(0))
    return load(spark, sf_dir, "events").select("event_id", ledger.scope_for(org, F.col("user_id")).alias("s")).select("event_id", "s.scope", "s.scope_id")


@register("R11_workspace_boost", "SELECT event_id, round(CASE WHEN event_type = 'view' THEN value * 1.4 ELSE value END, 9) AS score FROM events")
def r11(spark, sf_dir):
    hits = load(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"), F.col("event_type").alias("workspace"), F.lit("view").alias("query_workspace"))
    return retrieve.workspace_boost(hits).select("event_id", F.round("score", 9).alias("score"))


@register("R12_distance_boost", "SELECT event_id, round(value * CASE WHEN user_id % 4 < 3 THEN 1 + 0.5 / (1 + user_id % 4) ELSE 1 END, 9) AS score FROM events")
def r12(spark, sf_dir):
    hits = load(spark, sf_dir, "events").select("event_id", F.lit(1).alias("query_id"), F.col("user_id").alias("node_id"), F.col("value").alias("score"))
    near = hits.select("query_id", "node_id").distinct().where("node_id % 4 < 3").withColumn("hops", F.col("node_id") % 4)
    return retrieve.distance_boost(hits, near).select("event_id", F.round("score", 9).alias("score"))


@register("S25_cold_candidates", f"""WITH q AS (SELECT s_suppkey AS query_id, unnest({TERMS.format('p_name')}) AS term FROM supplier JOIN part ON p_partkey = s_suppkey), i AS (SELECT p_partkey AS item_id, p_size, unnest({TERMS.format("p_name || ' ' || p_brand")}) AS term FROM part WHERE p_partkey % 2 = 0),
o AS (SELECT query_id, item_id, p_size, count(*) AS overlap FROM i JOIN q USING (term) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, p_size DESC, item_id) AS rank FROM o) SELECT query_id, item_id, overlap FROM r WHERE rank <= 5""")
def s25(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    asked = load(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.col("p_name").alias("question"))
    items = part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("path"), F.col("p_size").alias("modified_at"), F.when(F.col("p_partkey") % 2 == 0, "listed").otherwise("admitted").alias("status"))
    return retrieve.cold_candidates(asked, items).select("query_id", "item_id", "overlap")


@register("X8_normalize_fact", r"SELECT doc_id, md5(nullif(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '')) AS digest FROM documents")
def x8(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_fact(F.col("text")).cast("binary")).alias("digest"))


@register("X16_presence_targets", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'absent' ELSE 'present' END AS presence FROM events WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND user_id % 2 = 0)")
def x16(spark, sf_dir):
    i = F.col("event_id")
    value = F.when(i % 3 == 0, "Gone. for good").when(i % 3 == 1, "running again").otherwise("perhaps gone")
    topic = F.when(F.col("user_id") % 2 == 0, "ops/watch/x").otherwise("ops/x")
    return extract.presence_targets(load(spark, sf_dir, "events").select("event_id", value.alias("value"), topic.alias("topic"))).select("event_id", "presence")


@register("X19_grounded", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 8 AND doc_id % 2 = 0")
def x19(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    quote = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" and what is not in it")))
    return extract.grounded(docs.select("doc_id", quote.alias("span")), docs).select("doc_id")


@register("K2_decay", f"SELECT event_id, round(CASE event_type WHEN 'click' THEN greatest(0.35, power(2.0, -greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0) / 14)) WHEN 'view' THEN 1.0 ELSE greatest(0.35, power(2.0, -greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0) / 365)) END, 9) AS factor FROM events")
def k2(spark, sf_dir):
    own = F.when(F.col("event_type") == "click", "2w").when(F.col("event_type") == "view", "2x")
    return load(spark, sf_dir, "events").select("event_id", F.round(scores.decay(F.lit("learning"), own, F.col("ts"), now()), 9).alias("factor"))


@register("K7_excerpt", r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(CASE WHEN length(t) <= 320 THEN t ELSE regexp_replace(substr(t, 1, 320), '[ ][^ ]*$', '') || '…' END) AS digest FROM f")
def k7(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.excerpt(F.col("text")).cast("binary")).alias("digest"))


@register("R1_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def r1(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@register("V8_probes", f"{RUNS}, p AS (SELECT user_id, valid_at, lead(valid_at) OVER (PARTITION BY user_id ORDER BY valid_at, event_id) AS nxt FROM runs) SELECT count(*) FILTER (WHERE nxt < valid_at) AS out_of_order, 0 AS changed_by_replay FROM p")
def v8(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    once, again = (temporal.supersede(observations(e), ["user_id"]) for e in (events, events.repartition(5, "value")))
    changed = F.lit(0 if temporal.replay_equal(once, again) else 1)
    return once.agg(F.count_if(F.col("invalid_at") < F.col("valid_at")).alias("out_of_order")).withColumn("changed_by_replay", changed)
