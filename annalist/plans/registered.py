"""Queries of operators that were reached through others only, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.text import contradicts
from annalist.operators import governance, graph, retrieve
from annalist.plans.queries import ASKED, load, questions, register
from annalist.sources import producers


@register("R5_query_terms", f"WITH {ASKED} SELECT query_id, term, times FROM asked")
def r5(spark, sf_dir):
    return retrieve.terms_of_queries(questions(spark, sf_dir))


@register("S9_from_agents", """WITH a AS (SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS running, c_custkey % 3 = 0 AS dated, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS author, n_regionkey AS org FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 5 > 0),
k AS (SELECT * FROM a WHERE author IS NOT NULL OR org IS NOT NULL)
SELECT 'agent:' || id || ':created' AS event_id, 'agent.created' AS action_type, id AS agent_id, author AS author_user_id, org AS org_id FROM k UNION ALL SELECT 'agent:' || id || ':deployed', 'agent.deployed', id, author, org FROM k WHERE running AND dated""")
def s9(spark, sf_dir):
    k = F.col("c_custkey")
    agents = load(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 5 > 0, F.col("c_nationkey")).alias("project_id"), F.when(k % 7 > 0, F.col("c_nationkey")).alias("author_user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "running").otherwise("stopped").alias("deployment_status"),
        F.when(k % 3 == 0, F.lit("2024-01-02").cast("timestamp")).alias("deployed_at"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    projects = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_regionkey").alias("org_id"))
    return producers.from_agents(agents, projects).select("event_id", "action_type", "agent_id", "author_user_id", "org_id")


@register("S12_conversation_store", """SELECT 'store:user.' || user_id || '.project.' || user_id % 7 || ':' || event_id AS event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(user_id % 7 AS VARCHAR) AS project_id,
CASE event_type WHEN 'click' THEN 'chat.message' WHEN 'view' THEN 'agent.tool_called' ELSE 'agent.decided' END AS action_type, CASE WHEN event_type = 'click' THEN 'said ' || event_id END AS content FROM events""")
def s12(spark, sf_dir):
    e, u = F.col("event_type"), F.col("user_id")
    data = F.struct(F.when(e == "view", "llm").alias("trace_type"), F.concat(F.lit("said "), F.col("event_id").cast("string")).alias("content"))
    value = F.struct(F.when(e == "click", "message").otherwise("trace").alias("type"), F.struct(F.upper(data["trace_type"]).alias("trace_type"), data["content"].alias("content")).alias("data"))
    rows = load(spark, sf_dir, "events").select(F.concat(F.lit("user."), u.cast("string"), F.lit(".project."), (u % 7).cast("string")).alias("prefix"), F.col("event_id").cast("string").alias("key"), value.alias("value"), F.col("ts").alias("updated_at"))
    return producers.from_conversation_store(rows).select("event_id", F.col("subject")["user"].alias("user_id"), F.col("subject")["project"].alias("project_id"), "action_type", "content")


@register("S19_repo_cards", """WITH f AS (SELECT p_brand AS repo, ['py', 'go', 'rs', 'md', 'ts'][1 + p_partkey % 5] AS lang FROM part WHERE p_partkey % 9 > 0),
c AS (SELECT repo, lang, count(*) AS n FROM f WHERE lang <> 'md' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, lang) AS r FROM c)
SELECT repo, string_agg(lang, ', ' ORDER BY r) AS languages FROM r WHERE r <= 3 GROUP BY 1""")
def s19(spark, sf_dir):
    p = F.col("p_partkey")
    suffix = F.element_at(F.array(*map(F.lit, ("py", "go", "rs", "md", "ts"))), (1 + p % 5).cast("int"))
    path = F.when(p % 9 > 0, F.concat(F.lit("src/f"), p.cast("string"), F.lit("."), suffix)).otherwise(F.lit("Makefile"))
    return producers.repo_cards(load(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), path.alias("path")))


@register("G18_purge_workspace", """WITH n AS (SELECT event_id AS node_id, user_id % 10 AS workspace, 'u' || user_id AS scope_id FROM events), gone AS (SELECT node_id FROM n WHERE workspace = 3 AND scope_id IN ('u3', 'u13', 'u23'))
SELECT 'node' AS kind, count(*) AS n FROM n WHERE node_id NOT IN (SELECT node_id FROM gone) UNION ALL
SELECT 'edge', count(*) FROM events WHERE event_id NOT IN (SELECT node_id FROM gone) AND event_id - 1 NOT IN (SELECT node_id FROM gone)""")
def g18(spark, sf_dir):
    """A workspace leaves its own scopes: nodes go, and the edges that touch them."""
    nodes = load(spark, sf_dir, "events").select(F.col("event_id").alias("node_id"), (F.col("user_id") % 10).alias("workspace"), F.concat(F.lit("u"), "user_id").alias("scope_id"))
    edges = nodes.select(F.col("node_id").alias("src_id"), (F.col("node_id") - 1).alias("dst_id"))
    gone = nodes.where((F.col("workspace") == 3) & F.col("scope_id").isin("u3", "u13", "u23")).select("node_id")
    left = governance.purge(governance.purge(edges, gone.withColumnRenamed("node_id", "src_id"), ["src_id"]), gone.withColumnRenamed("node_id", "dst_id"), ["dst_id"])
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(governance.purge(nodes, gone, ["node_id"]), "node").unionByName(count(left, "edge"))


@register("B2_observation_stamps", """SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) AS derived_from, count(*) AS observed_count, max(ts) AS last_observed_at,
CASE WHEN count(*) FILTER (value <= 99) > 0 THEN 'committed' ELSE 'working' END AS status FROM events GROUP BY 1""")
def b2(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    seen = e.select("user_id", F.col("event_type").alias("name"), F.lit("s").alias("source"), "event_id", F.col("ts").alias("occurred_at"), F.when(F.col("value") > 99, "working").otherwise("committed").alias("status"))
    twice = seen.unionByName(seen.where("event_id % 4 = 0"))  # told again, which changes nothing
    return graph.build_nodes(twice, ["user_id"]).select("user_id", F.array_join("derived_from", ",").alias("derived_from"), "observed_count", "last_observed_at", "status")


@register("B12_contradicts", "SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 4 = 3 AND o_orderstatus = 'O' AS contradicts FROM orders")
def b12(spark, sf_dir):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    a = F.concat(F.lit("The order is now in state "), status)
    b = F.when(k % 4 == 0, "no order in that state").when(k % 4 == 1, "the order is in state F").when(k % 4 == 2, "never an Order").otherwise(F.concat(F.when(status == "O", "order not ").otherwise("order "), F.lit("in place")))
    return load(spark, sf_dir, "orders").select("o_orderkey", contradicts(a, b).alias("contradicts"))
