"""Queries of search, fold and report operators, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import extract, fold, governance, reports, retrieve, search, temporal
from annalist.plans.governed import TERMS, scoped
from annalist.plans.queries import CHUNKS, LEXICAL, NOW, RESULT, RUNS, lexical, load, now, observations, questions, register, runs_of
from annalist.sources.shared import keep

WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


def stamp(s: str):
    return F.lit(s).cast("timestamp")


@register("P8_liveness", "SELECT event_id FROM events WHERE (event_id % 3 > 0 OR ts > TIMESTAMP '2024-01-15') AND event_type NOT IN ('click', 'view')")
def p8(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "superseded").when(F.col("event_type") == "view", "ended").otherwise("committed")
    rows = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp")).alias("expires_at"), status.alias("status"))
    return search.live(rows, stamp("2024-01-15")).select("event_id")


@register("P14_in_workspace", "SELECT c_custkey AS src_id, o_orderkey AS dst_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def p14(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.col("c_mktsegment").alias("workspace")).unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"), F.lit("none").alias("workspace")))
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src_id"), F.concat(F.lit("o"), "o_orderkey").alias("dst_id"))
    _, kept = search.in_workspace(nodes, edges, "BUILDING")
    number = lambda x: F.substring(x, 2, 20).cast("long").alias(x)
    return kept.select(number("src_id"), number("dst_id"))


@register("P18_document_detail", f"WITH {CHUNKS} SELECT doc_id, string_agg(md5(content), '' ORDER BY ordinal) AS digests FROM chunks WHERE doc_id % 20 = 0 GROUP BY 1")
def p18(spark, sf_dir):
    chunks = retrieve.chunks_of(load(spark, sf_dir, "documents").where("doc_id % 20 = 0"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", F.md5(F.col("content").cast("binary")).alias("d"))))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["d"]), "").alias("digests"))


@register("P19_node_read", "WITH v AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 1) SELECT user_id, count(DISTINCT event_type) AS n_neighbours FROM events JOIN v USING (user_id) GROUP BY 1")
def p19(spark, sf_dir):
    from annalist.operators.graph import hops

    events = load(spark, sf_dir, "events")
    nodes = events.select("user_id", (F.col("user_id") % 3).cast("string").alias("org_id"), F.lit("org").alias("scope"), (F.col("user_id") % 3).cast("string").alias("scope_id")).distinct()
    seen = governance.scope_filter(nodes, spark.createDataFrame([("1", "org", "1")], "org_id string, scope string, scope_id string"))
    edges = events.select(F.concat(F.lit("u"), "user_id").alias("src_id"), F.col("event_type").alias("dst_id"))
    near = hops(seen.select(F.col("user_id").alias("query_id"), F.concat(F.lit("u"), "user_id").alias("node_id")), edges, 1).where("hops = 1")
    return near.groupBy(F.col("query_id").alias("user_id")).agg(F.count("*").alias("n_neighbours"))


VECTORS = """s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def asked_vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@register("R3_node_vectors", f"WITH {VECTORS.format('e.vec_id % 4 > 0 AND e.vec_id % 3 = 0')} SELECT query_id, vec_id AS node_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def r3(spark, sf_dir):
    i = F.col("vec_id")
    nodes = load(spark, sf_dir, "embeddings").select(i.alias("node_id"), "embedding", F.when(i % 3 == 0, "Fact").otherwise("Metric").alias("type"), F.when(i % 4 == 0, "ended").otherwise("committed").alias("status"), F.lit(None).cast("timestamp").alias("expires_at"))
    return search.node_vectors(asked_vectors(spark, sf_dir), nodes, now(), ("Fact",), 10)


@register("R4_edge_vectors", f"WITH {VECTORS.format('e.vec_id % 5 > 0')} SELECT query_id, vec_id AS edge_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def r4(spark, sf_dir):
    i = F.col("vec_id")
    edges = load(spark, sf_dir, "embeddings").select(i.alias("edge_id"), "embedding", stamp("2024-01-01").alias("valid_at"), F.when(i % 5 == 0, stamp("2024-02-01")).alias("invalid_at"))
    return search.edge_vectors(asked_vectors(spark, sf_dir), edges, now(), 10)


NODE_LEXICAL = f"""q AS (SELECT s_suppkey AS query_id, lower(p_name) AS q FROM supplier JOIN part ON p_partkey = s_suppkey), qw AS (SELECT query_id, q, len({WORDS.format('q')}) AS n, unnest({WORDS.format('q')}) AS word FROM q),
h AS (SELECT p_partkey AS node_id, lower(p_name) AS name, lower(p_brand) AS key, unnest({WORDS.format("p_name || ' ' || p_type || ' ' || p_brand")}) AS word FROM part),
m AS (SELECT query_id, node_id, round(count(*) / any_value(n) + CASE WHEN starts_with(any_value(key), any_value(q)) OR contains(any_value(name), any_value(q)) THEN 0.5 ELSE 0 END, 6) AS score FROM h JOIN qw USING (word) GROUP BY 1, 2),
nodes AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM m)"""


def node_hits(spark, sf_dir, k=30):
    part = load(spark, sf_dir, "part")
    asked = load(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.col("p_name").alias("question"))
    nodes = part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_type").alias("summary"), F.col("p_brand").alias("key"))
    return search.node_lexical(asked, nodes, k)


@register("R9_node_lexical", f"WITH {NODE_LEXICAL} SELECT query_id, node_id, score, CAST(rank AS INTEGER) AS rank FROM nodes WHERE rank <= 30")
def r9(spark, sf_dir):
    return node_hits(spark, sf_dir)


@register("R13_speaker_boost", r"SELECT conv_id, turn, round(CASE WHEN conv_id % 2 = 0 AND role = 'assistant' OR conv_id % 2 = 1 AND role = 'user' THEN turn * 1.3 ELSE turn END, 9) AS score FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '(?i)(user|human|assistant|ai|bot)\s*:')")
def r13(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where(~F.coalesce("text", F.lit("")).rlike(r"(?i)(user|human|assistant|ai|bot)\s*:"))
    hits = c.select("conv_id", "turn", F.col("turn").cast("double").alias("score"), F.concat_ws("", "role", F.lit(": "), "text").alias("content"), F.when(F.col("conv_id") % 2 == 0, "assistant").otherwise("user").alias("speaker"))
    return search.speaker_boost(hits).select("conv_id", "turn", F.round("score", 9).alias("score"))


@register("R16_explain", "WITH h AS (SELECT user_id % 9 AS query_id, event_type AS type, user_id % 30 AS key, ['org','team','user'][1 + event_id % 3] AS scope FROM events) SELECT query_id, CAST(0 AS BIGINT) AS \"global\", count(*) FILTER (WHERE scope = 'org') AS org, count(*) FILTER (WHERE scope = 'team') AS team, count(*) FILTER (WHERE scope = 'user') AS \"user\", count(*) AS candidates, count(DISTINCT (type, key)) AS merged, count(*) - count(DISTINCT (type, key)) AS shadowed FROM h GROUP BY 1")
def r16(spark, sf_dir):
    scope = F.element_at(F.array(F.lit("org"), F.lit("team"), F.lit("user")), (1 + F.col("event_id") % 3).cast("int"))
    hits = load(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("query_id"), F.col("event_type").alias("type"), (F.col("user_id") % 30).alias("key"), F.col("event_id").alias("node_id"), F.col("value").alias("score"), scope.alias("scope"))
    merged = retrieve.merge_scopes(hits.withColumn("scope_rank", governance.scope_rank(F.col("scope"))))
    return search.explain(hits, merged)


@register("R17_derived_search", f"""WITH {NODE_LEXICAL}, v AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_id DESC) AS rank FROM nodes WHERE rank <= 30),
f AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, node_id, rank FROM nodes WHERE rank <= 30 UNION ALL SELECT * FROM v) WHERE node_id % 5 > 0 GROUP BY 1, 2),
b AS (SELECT query_id, node_id, round(score * CASE WHEN node_id % 4 < 2 THEN 1 + 0.5 / (1 + node_id % 4) ELSE 1 END, 9) AS score FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM b)
SELECT query_id, node_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r17(spark, sf_dir):
    hits = keep(node_hits(spark, sf_dir))
    other = retrieve.top(hits.drop("rank"), "query_id", [F.desc("node_id")], 1 << 30)
    legs = hits.withColumn("leg", F.lit("lexical")).unionByName(other.withColumn("leg", F.lit("vector")))
    nodes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_partkey") % 5 == 0, "ended").otherwise("committed").alias("status"), F.lit(None).cast("timestamp").alias("expires_at"))
    near = hits.where("node_id % 4 < 2").select("query_id", "node_id", (F.col("node_id") % 4).alias("hops"))
    return search.derived_search(legs, nodes, near, now()).withColumn("score", F.round("score", 6))


@register("R18_direct_search", f"""{LEXICAL}, f AS (SELECT query_id, doc_id, ordinal, round(1.0 / (60 + rank), 9) AS score FROM legs WHERE rank <= 60),
own AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, ordinal) AS n FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM own WHERE n <= 2)
SELECT query_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r18(spark, sf_dir):
    """The lexical leg alone, as in an ablation; the documents have no user turns."""
    hits = lexical(spark, sf_dir).select("query_id", "doc_id", "ordinal", "rank", F.lit("user").alias("speaker"))
    legs = hits.withColumn("leg", F.lit("lexical")).unionByName(hits.withColumn("leg", F.lit("title")))
    return search.direct_search(legs, retrieve.chunks_of(load(spark, sf_dir, "documents")), weights={"lexical": 1.0, "title": 0.0}).select("query_id", "doc_id", "ordinal", "score", "rank")


@register("R19_across_tiers", f"""WITH {NODE_LEXICAL}, i AS (SELECT query_id, 'node:' || node_id AS item, rank FROM nodes WHERE rank <= 10 UNION ALL SELECT query_id, 'passage:' || node_id || ':0', rank FROM nodes WHERE rank <= 10),
s AS (SELECT query_id, item, round(1.0 / (60 + rank), 9) AS score FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM s) SELECT query_id, item, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def r19(spark, sf_dir):
    hits = keep(node_hits(spark, sf_dir, 10))
    return search.across_tiers(hits, hits.withColumnRenamed("node_id", "doc_id").withColumn("ordinal", F.lit(0)))


@register("R21_topic_routing", f"""WITH q AS (SELECT DISTINCT s_suppkey AS query_id, unnest({WORDS.format("p_name || ' ' || p_brand")}) AS word FROM supplier JOIN part ON p_partkey = s_suppkey),
t AS (SELECT p_type AS topic, CASE WHEN starts_with(p_type, 'E') THEN 'state' ELSE 'record' END AS kind, unnest({WORDS.format("p_type || ' ' || CASE WHEN starts_with(p_type, 'E') THEN 'state' ELSE 'record' END || ' w'")}) AS word FROM part UNION SELECT p_type, CASE WHEN starts_with(p_type, 'E') THEN 'state' ELSE 'record' END, unnest({WORDS.format('p_name')}) FROM part),
m AS (SELECT query_id, topic, count(*) + CASE WHEN any_value(kind) = 'state' THEN 0.5 ELSE 0 END AS score FROM t JOIN q USING (word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, topic) AS rank FROM m) SELECT query_id, topic, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def r21(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    asked = load(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_brand").alias("question"))
    topics = part.select(F.col("p_type").alias("topic"), F.when(F.col("p_type").startswith("E"), "state").otherwise("record").alias("kind"), F.lit("w").alias("workspace")).distinct()
    return search.topic_routing(asked, topics, part.select(F.col("p_type").alias("topic"), F.col("p_name").alias("key")))


@register("R22_grep", f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_slice(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]{{3,}}'), lambda t: lower(t)), 1, 4))) AS term FROM benchmark),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents), t AS (SELECT doc_id, line, unnest({TERMS.format('body')}) AS term FROM l),
m AS (SELECT query_id, doc_id, count(DISTINCT line) AS n_lines FROM t JOIN q USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_lines DESC, doc_id) AS rank FROM m) SELECT query_id, doc_id, n_lines, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r22(spark, sf_dir):
    return search.grep_files(questions(spark, sf_dir), load(spark, sf_dir, "documents").select("doc_id", "text"))


@register("K5_leading_value", r"""WITH f AS (SELECT DISTINCT p_partkey AS fact_id, p_size AS rank, p_partkey % 2 = 0 AS keyed, unnest(list_filter(regexp_split_to_array(lower(p_name || '/' || p_brand), '[/:=\s\-]+'), lambda w: len(w) >= 3)) AS word FROM part),
q AS (SELECT DISTINCT s_suppkey AS query_id, unnest(list_filter(regexp_split_to_array(lower(p_name), '[/:=\s\-]+'), lambda w: len(w) >= 3)) AS word FROM supplier JOIN part ON p_partkey = s_suppkey),
m AS (SELECT query_id, fact_id, rank, count(*) AS overlap FROM f JOIN q USING (word) GROUP BY query_id, fact_id, rank, keyed HAVING count(*) >= CASE WHEN keyed THEN 1 ELSE 2 END), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank, fact_id) AS n FROM m) SELECT query_id, fact_id, overlap FROM r WHERE n = 1""")
def k5(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    asked = load(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.col("p_name").alias("question"))
    facts = part.select(F.col("p_partkey").alias("fact_id"), F.col("p_size").alias("rank"), (F.col("p_partkey") % 2 == 0).alias("keyed"), F.concat_ws("/", "p_name", "p_brand").alias("anchor"))
    return search.leading_value(asked, facts)


@register("K6_predates", "SELECT event_id, ts < TIMESTAMP '2024-01-15' AND user_id % 2 = 0 AS predates FROM events")
def k6(spark, sf_dir):
    passages = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("query_id"), F.col("ts").cast("timestamp").alias("valid_at"))
    values = passages.select("query_id").distinct().where("query_id % 2 = 0").withColumn("since", stamp("2024-01-15"))
    return search.predates(passages, values).select("event_id", "predates")


@register("T3_caller_anchors", "SELECT c_custkey AS caller_id, unnest(['u' || c_custkey, 'a' || c_nationkey]) AS node_id FROM customer")
def t3(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    callers = c.select(F.col("c_custkey").alias("caller_id"), F.array("c_nationkey").alias("agent_ids"))
    nodes = c.select(F.concat(F.lit("User:"), "c_custkey").alias("key"), F.concat(F.lit("u"), "c_custkey").alias("node_id")).unionByName(c.select(F.concat(F.lit("Agent:"), "c_nationkey").alias("key"), F.concat(F.lit("a"), "c_nationkey").alias("node_id")).distinct())
    return search.caller_anchors(callers, nodes)


@register("T7_semi_anti", "SELECT count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS ordered, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS never FROM customer")
def t7(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("ordered")).crossJoin(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("never")))


@register("T8_served_verdicts", f"SELECT DISTINCT 'u' || user_id AS node_id, event_id AS run_id, {RESULT} AS run_result FROM events UNION SELECT DISTINCT 'n' || event_type, event_id, {RESULT} FROM events")
def t8(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    served = e.select(F.col("event_id").alias("run_id"), F.array(F.concat(F.lit("u"), "user_id")).alias("node_ids"), F.array("event_id").alias("event_ids"))
    nodes = e.groupBy(F.concat(F.lit("n"), "event_type").alias("node_id")).agg(F.collect_set("event_id").alias("derived_from"))
    return reports.served_verdicts(served, runs_of(e), nodes)


@register("G5_fold_gate", """WITH e AS (SELECT event_id, user_id, event_type, event_id % 2 = 0 AS doc, ts, value FROM events), d AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM e WHERE doc AND user_id % 7 <> 0 AND event_type <> 'error')
SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'consent:pause' WHEN event_type = 'error' THEN 'deny_source:error' WHEN n > 5 THEN 'budget:' || event_type || ':5/5' WHEN doc AND value < 20 THEN 'salience:' || value
WHEN NOT doc AND user_id % 3 = 0 THEN 'pii:email' END AS dropped_reason FROM e LEFT JOIN d USING (event_id)""")
def g5(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    doc = F.col("event_id") % 2 == 0
    rows = e.select("event_id", F.lit("o").alias("org_id"), F.when(F.col("user_id") % 7 == 0, "user").otherwise("team").alias("scope"), F.col("user_id").cast("string").alias("scope_id"), F.col("event_type").alias("source"), F.col("ts").alias("ingested_at"),
                    F.when(doc, "document.ingested").otherwise("memory.claim").alias("action_type"), F.col("value").alias("salience"), F.when(F.col("user_id") % 3 == 0, "mail a@example.org").otherwise("none").alias("content"))
    consent = rows.where("scope = 'user'").select("scope", "scope_id", F.lit("pause").alias("state")).distinct()
    return fold.fold_gate(rows, consent, F.array(F.lit("error")), F.lit(None).cast("array<string>"), 20.0, 5).select("event_id", "dropped_reason")


@register("G12_redact_map", "SELECT p_partkey, p_name AS name, 'token=secret://' || substr(sha256('tok' || p_partkey || 'abcdef'), 1, 16) AS note FROM part")
def g12(spark, sf_dir):
    made = F.create_map(F.lit("name"), F.col("p_name"), F.lit("note"), F.concat(F.lit("token=tok"), "p_partkey", F.lit("abcdef")))
    return load(spark, sf_dir, "part").select("p_partkey", fold.redact_map(made).alias("m")).select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["note"].alias("note"))


@register("G28_governs", "SELECT event_id, user_id % 10 = 0 OR event_id % 4 = 3 OR (event_id % 4 = 2 AND user_id % 2 = 0) AS governs FROM events")
def g28(spark, sf_dir):
    rows = scoped(spark, sf_dir).withColumn("caller_id", F.col("user_id").cast("string")).withColumn("is_admin", F.col("user_id") % 10 == 0)
    held = rows.where("user_id % 2 = 0").select("caller_id", F.col("event_type").alias("unit_id"))
    return fold.governs(rows, held).select("event_id", "governs")


@register("X14_mentions", "SELECT p_partkey AS event_id, regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g') AS key FROM (SELECT p_partkey, unnest(list_distinct([p_name, p_type])) AS n FROM part)")
def x14(spark, sf_dir):
    hint = lambda c: F.struct(F.col(c).alias("name"), F.array("p_brand").alias("aliases"))
    return fold.mentions(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("event_id"), F.array(hint("p_name"), hint("p_type")).alias("hints"))).select("event_id", "key")


@register("X15_valid_until", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) END AS until FROM events")
def x15(spark, sf_dir):
    i, at = F.col("event_id") % 3, F.col("ts").cast("timestamp")
    said = F.when(i == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("next Tuesday"))
    return load(spark, sf_dir, "events").select("event_id", fold.valid_until(said).cast("timestamp_ntz").alias("until"))


@register("B3_upsert_edges", "SELECT user_id, event_type AS dst, min(ts) AS valid_at, max_by(value, (ts, event_id)) AS fact, count(*) AS observed_count FROM events GROUP BY 1, 2")
def b3(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("dst"), F.col("ts").alias("valid_at"), F.col("value").alias("fact"), "event_id")
    return fold.upsert_edges(e, ["user_id", "dst"])


@register("B9_resolve_by_key", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'n' || o_custkey ELSE 'Customer:' || o_custkey END AS node_id, o_custkey % 2 = 1 AS is_new FROM orders")
def b9(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.lit("Customer").alias("type"), F.col("o_custkey").cast("string").alias("key"))
    nodes = o.where("cast(key as bigint) % 2 = 0").select("type", "key", F.concat(F.lit("n"), "key").alias("node_id")).distinct()
    return fold.resolve_by_key(o, nodes).select("o_orderkey", "node_id", "is_new")


@register("B21_effective_ontology", "WITH t AS (SELECT DISTINCT c_nationkey AS org_id FROM customer) SELECT org_id, class, 'core' AS origin FROM t, (SELECT unnest(['Agent', 'BUILDING']) AS class) UNION SELECT DISTINCT c_nationkey, c_mktsegment, 'extension' FROM customer WHERE c_mktsegment <> 'BUILDING'")
def b21(spark, sf_dir):
    core = spark.createDataFrame([("Agent",), ("BUILDING",)], "class string")
    own = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org_id"), F.array("c_mktsegment").alias("classes"))
    return fold.effective_ontology(core, own)


KNOWN = f"""s AS (SELECT p_partkey AS state_id, p_name AS subject, len({WORDS.format('p_name')}) AS n, unnest({WORDS.format('p_name')}) AS word FROM part), a AS (SELECT DISTINCT p_type AS anchor, len({WORDS.format('p_type')}) AS m, unnest({WORDS.format('p_type')}) AS word FROM part UNION SELECT DISTINCT p_name, len({WORDS.format('p_name')}), unnest({WORDS.format('p_name')}) FROM part WHERE p_partkey % 3 = 0)"""


@register("X18_known_subjects", f"""WITH {KNOWN}, b AS (SELECT state_id, anchor, n, m, count(*) AS k FROM s JOIN a USING (word) GROUP BY 1, 2, 3, 4), f AS (SELECT *, k = least(n, m) AS inside, CASE WHEN k = least(n, m) THEN 1.0 ELSE k / (n + m - k) END AS j FROM b WHERE k = least(n, m) OR k / (n + m - k) >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY inside DESC, j DESC, anchor) AS r FROM f) SELECT p_partkey AS state_id, coalesce(anchor, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')) AS anchor FROM part LEFT JOIN (SELECT * FROM r WHERE r = 1) ON state_id = p_partkey""")
def x18(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    anchors = part.select(F.col("p_type").alias("anchor")).unionByName(part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("anchor"))).distinct()
    return fold.known_subjects(part.select(F.col("p_partkey").alias("state_id"), F.col("p_name").alias("subject")), anchors).select("state_id", "anchor")


@register("X20_valid_states", "WITH c AS (SELECT event_id, ['state','odd','record'][1 + event_id % 3] AS kind, CASE WHEN event_id % 5 = 0 THEN 'a/b' ELSE event_type END AS key FROM events) SELECT event_id, key, 'x' AS value FROM c WHERE kind <> 'odd' AND key <> 'a/b'")
def x20(spark, sf_dir):
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("state", "odd", "record"))), (1 + i % 3).cast("int"))
    one = lambda p, v: load(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.when(i % 5 == 0, "a/b").otherwise(F.col("event_type")).alias("key"), F.lit(v).alias("value"), F.lit(p).alias("position"))
    return fold.valid_states(one(1, "x").unionByName(one(2, "y"))).select("event_id", "key", "value")


@register("X23_dated_facts", "SELECT event_id, '[' || strftime(CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) ELSE DATE '2024-02-02' END, '%Y-%m-%d') || '] ' || event_type AS name FROM events")
def x23(spark, sf_dir):
    facts = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.when(F.col("event_id") % 2 == 0, F.to_date("ts")).alias("event_date"), F.col("event_type").alias("fact"))
    sessions = facts.select("session_id").distinct().withColumn("session_date", F.lit("2024-02-02").cast("date"))
    return fold.dated_facts(facts, sessions).select("event_id", "name")


@register("X25_topic_lines", "WITH t AS (SELECT user_id AS topic, event_type AS unit, CAST(count(*) AS DOUBLE) AS total FROM events GROUP BY 1, 2) SELECT topic, string_agg(printf('%.1f', total) || ' ' || unit, '; ' ORDER BY unit) AS line FROM t GROUP BY 1")
def x25(spark, sf_dir):
    tallies = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("topic"), F.col("event_type").alias("unit")).agg(F.count("*").cast("double").alias("total"))
    return fold.topic_lines(tallies)


@register("X26_current_topics", f"{RUNS} SELECT user_id, dst FROM runs WHERE invalid_at IS NULL AND CAST(user_id AS VARCHAR) LIKE '%1'")
def x26(spark, sf_dir):
    edges = temporal.supersede(observations(load(spark, sf_dir, "events")), ["user_id"]).withColumn("anchor_key", F.concat(F.lit("state:u/"), "user_id"))
    return fold.current_topics(edges, "state:u/", "1").select("user_id", "dst")


@register("X27_anchor_text", "SELECT p_partkey, lower(replace(p_brand, '#', '#')) || ' ' || p_size || ' (state watch)' AS subject FROM part")
def x27(spark, sf_dir):
    topic = F.concat_ws("/", F.lit("state"), "p_brand", F.lit("watch"), F.col("p_size").cast("string"))
    return load(spark, sf_dir, "part").select("p_partkey", fold.anchor_text(topic).alias("subject"))


@register("X30_topic_states", "SELECT user_id AS topic, printf('%.1f', CAST(sum(CAST(round(value) AS BIGINT)) AS DOUBLE)) || ' pts' AS line, 'state:' || user_id AS anchor FROM events GROUP BY 1 HAVING sum(CAST(round(value) AS BIGINT)) > 0")
def x30(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("topic"), F.col("event_id").cast("string").alias("fact"), F.to_date("ts").alias("date"), F.lit("add").alias("op"), F.round("value").alias("qty"), F.lit("pts").alias("unit"))
    return fold.topic_states(e)


@register("X9_hash_embed", "SELECT o_orderkey, 1.0 AS norm, 0 AS zero FROM orders")
def x9(spark, sf_dir):
    made = extract.hash_embed(load(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text")), key="o_orderkey")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    return made.select("o_orderkey", F.round(F.sqrt(square), 9).alias("norm"), F.size(F.filter("embedding", lambda v: v < 0)).alias("zero"))


@register("X10_re_embed", "SELECT o_orderkey AS row_id, 'new' AS model, CASE WHEN o_orderkey % 3 = 0 THEN 64 ELSE 1 END AS dim FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'new', 1 FROM orders WHERE o_orderkey % 3 > 0")
def x10(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(k.alias("row_id"), F.col("o_orderpriority").alias("text"), F.when(k % 3 > 0, "new").alias("model"), F.when(k % 3 > 0, F.array(F.lit(1.0))).alias("embedding"))
    done = fold.re_embed(rows, "new", lambda df: extract.hash_embed(df, key="row_id"))
    return done.select("row_id", "model", F.size("embedding").alias("dim"))


@register("S26_admit_items", "SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 50 THEN 'declined' ELSE 'admitted' END AS status FROM documents")
def s26(spark, sf_dir):
    return fold.admit_items(load(spark, sf_dir, "documents")).select("doc_id", "status")


@register("A2_ops_stats", "SELECT event_type AS type, count(*) AS total, count(*) FILTER (WHERE event_id % 3 = 0) AS open FROM events GROUP BY 1")
def a2(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("invalid_at"))
    return reports.ops_stats(e)


@register("A5_owner_report", f"WITH r AS (SELECT user_id % 10 AS org_id, {RESULT} AS res, value, event_id FROM events) SELECT org_id, count(*) AS n_runs, round(100 * count(*) FILTER (WHERE res = 'success') / count(*), 2) AS won_per_100, round(100 * count(*) FILTER (WHERE res = 'max_turns') / count(*), 2) AS stalled_per_100, round(sum(value), 3) AS tokens, count(*) FILTER (WHERE event_id % 2 = 0) AS n_served FROM r GROUP BY 1")
def a5(spark, sf_dir):
    runs = runs_of(load(spark, sf_dir, "events")).withColumn("tokens", F.col("turns"))
    return reports.owner_report(runs, runs.where("run_id % 2 = 0"))


@register("A9_distillation_window", "WITH r AS (SELECT user_id % 4 AS org_id, ts AS t, event_id AS run_id FROM events), k AS (SELECT * FROM r WHERE t > CASE WHEN org_id < 2 THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-25' - INTERVAL 14 DAY END), n AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY t, run_id) AS n FROM k) SELECT org_id, run_id FROM n WHERE n > 1")
def a9(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    runs = load(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("org_id"), F.col("ts").alias("at"), F.col("event_id").alias("run_id"))
    turns = runs.where("org_id < 2").select("org_id").distinct().withColumn("at", day("2024-01-20"))
    return reports.distillation_window(runs, turns, day("2024-01-25")).select("org_id", "run_id")


@register("A11_applicability", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'unknown' WHEN event_type = 'click' THEN 'locked' WHEN event_type IN ('error', 'signup') THEN CASE WHEN value BETWEEN 10 AND 50 THEN 'applicable' ELSE 'out_of_range' END ELSE 'not_allowed' END AS applicability FROM events")
def a11(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("hop"), F.lit("k").alias("knob"), F.col("value").cast("string").alias("value"))
    h = F.col("hop")
    ranged = h.isin("error", "signup")
    tunables = e.where("hop <> 'view'").select("hop", "knob").distinct().select("hop", "knob", F.when(ranged, 10.0).alias("low"), F.when(ranged, 50.0).alias("high"), F.when(h == "purchase", F.array(F.lit("on"))).alias("choices"), (h == "click").alias("locked"))
    return reports.applicability(e, tunables).select("event_id", "applicability")


@register("A12_promotion_gate", "SELECT o_orderkey AS candidate_id, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'auto' WHEN o_orderstatus = 'F' THEN 'review' ELSE 'rejected' END AS gate FROM orders")
def a12(spark, sf_dir):
    k = F.col("o_orderkey")
    c = load(spark, sf_dir, "orders").select(k.alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("declined").alias("verdict"), (F.col("o_custkey") % 2 == 0).alias("gating"), F.when(k % 3 == 0, F.array(F.lit("read"))).when(k % 3 == 1, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("odd"))).alias("tools"))
    return reports.promotion_gate(c, spark.createDataFrame([("read", False), ("write", True)], "tool string, applies boolean")).select("candidate_id", "gate")


@register("A12b_cited_proposals", "SELECT o_orderkey AS proposal_id FROM orders WHERE o_custkey % 2 = 0")
def a12b(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    proposals = o.select(F.col("o_orderkey").alias("proposal_id"), F.array(F.col("o_orderkey"), -1 - F.col("o_custkey")).alias("evidence"))
    read = o.select(F.col("o_orderkey").alias("evidence_id")).unionByName(o.where("o_custkey % 2 = 0").select((-1 - F.col("o_custkey")).alias("evidence_id")))
    return reports.cited_proposals(proposals, read).select("proposal_id")


EVAL = """t AS (SELECT user_id % 20 AS candidate_id, event_type AS suite, round(avg(CAST(value > 20 AS INTEGER)), 6) AS rate FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1, 2),
p AS (SELECT *, CASE suite WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS position, rate < CASE suite WHEN 'click' THEN 0.7 WHEN 'error' THEN 0.8 ELSE 0.75 END AS failed FROM t),
v AS (SELECT *, CASE WHEN coalesce(max(CAST(failed AS INTEGER)) OVER (PARTITION BY candidate_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skipped' WHEN failed THEN 'rejected' ELSE 'passed' END AS outcome FROM p)"""


def verdicts(spark, sf_dir):
    rows = load(spark, sf_dir, "events").where("event_type in ('click', 'error', 'view')").select((F.col("user_id") % 20).alias("candidate_id"), F.col("event_type").alias("suite"), (F.col("value") > 20).alias("passed"))
    return reports.eval_verdict(rows, spark.createDataFrame([("click", 1, 0.7), ("error", 2, 0.8), ("view", 3, 0.75)], "suite string, position int, floor double"))


@register("A13_eval_verdict", f"WITH {EVAL} SELECT candidate_id, suite, CAST(position AS INTEGER) AS position, rate, outcome FROM v")
def a13(spark, sf_dir):
    return verdicts(spark, sf_dir)


@register("A13b_verdict_episodes", f"WITH {EVAL} SELECT 'eval:' || candidate_id AS event_id, 'hop.eval_scored' AS action_type, CASE WHEN bool_or(outcome = 'rejected') THEN 'rejected' ELSE 'adopted' END AS decision FROM v GROUP BY candidate_id")
def a13b(spark, sf_dir):
    return reports.verdict_episodes(verdicts(spark, sf_dir))


@register("F2_survival", f"SELECT event_id, round(greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0), 2) AS age_days, round(greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0) / 45, 2) AS half_lives, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0 > 45 AS decayed FROM events")
def f2(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", reports.survival(F.col("ts"), F.lit(45.0), now()).alias("s")).select("event_id", "s.*")


@register("F3_trust_records", f"WITH s AS (SELECT user_id AS node_id, {RESULT} AS res FROM events), c AS (SELECT node_id, count(*) FILTER (WHERE res = 'success') AS passes, count(*) FILTER (WHERE res <> 'success') AS fails, count(*) AS runs FROM s GROUP BY 1) SELECT node_id, CASE WHEN node_id % 5 = 0 THEN 'endorsed' WHEN node_id % 3 = 0 THEN 'probation' WHEN (runs >= 2 OR passes >= 3) AND fails = 0 THEN 'corroborated' ELSE 'probation' END AS tier, passes, fails, runs FROM c")
def f3(spark, sf_dir):
    from annalist.operators.feedback import consequences

    e, n = load(spark, sf_dir, "events"), F.col("node_id")
    c = consequences(e.select(F.col("event_id").alias("run_id"), F.array("user_id").alias("node_ids")), runs_of(e))
    nodes = c.select("node_id", (n % 5 == 0).alias("endorsed"), (n % 3 != 0).alias("grounded"), F.col("runs").alias("observed"), F.lit(None).cast("timestamp").alias("last_seen"), F.lit(90.0).alias("half_life"))
    return reports.trust_records(nodes, c, now()).select("node_id", "tier", "passes", "fails", "runs")


@register("N2_changed_sections", "WITH v AS (SELECT user_id AS note_id, event_id AS version, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT note_id, version, unnest([s, b]) AS section, unnest(['added', 'removed']) AS change FROM v WHERE b IS NOT NULL AND b <> s")
def n2(spark, sf_dir):
    versions = load(spark, sf_dir, "events").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("version"), F.create_map("event_type", F.lit("body")).alias("sections"))
    return reports.changed_sections(versions)


@register("N3b_visible_notes", "SELECT event_id AS note_id FROM events WHERE event_id % 4 = 1 OR (event_id % 4 = 2 AND event_type = 'view') OR (event_id % 4 = 3 AND user_id = 7)")
def n3b(spark, sf_dir):
    notes = scoped(spark, sf_dir).select(F.col("event_id").alias("note_id"), "scope", "scope_id", F.col("event_type").alias("workspace"))
    return reports.visible_notes(notes, "7", ["view"]).select("note_id")


@register("N5_close_threads", "SELECT o_orderkey AS note_id, o_orderkey % 2 = 0 AND o_custkey % 2 = 0 AS closed FROM orders")
def n5(spark, sf_dir):
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    none = F.lit(None).cast("timestamp")
    cite = lambda kind, i, at: F.struct(F.lit(kind).alias("kind"), i.cast("string").alias("id"), at.alias("at"))
    bullets = o.select(k.alias("note_id"), F.lit(0).alias("bullet"), F.array(cite("edge", k, none), cite("run", F.lit("r"), F.when(F.col("o_custkey") % 2 == 1, now()))).alias("citations"))
    return reports.close_threads(bullets, o.where("o_orderkey % 2 = 0").select(k.cast("string").alias("id")), now()).select("note_id", "closed")


@register("N6_state_block", "WITH t AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS n FROM t), b AS (SELECT user_id, string_agg('- ' || event_type || ' $1', chr(10) ORDER BY n) AS block FROM r WHERE n <= 3 GROUP BY 1) SELECT user_id AS note_id, 'head <!-- state -->' || chr(10) || block || chr(10) || '<!-- /state --> tail' AS body FROM b")
def n6(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("note_id"), F.col("event_type").alias("topic"), F.col("ts").alias("at"), F.concat("event_type", F.lit(" $1")).alias("line"))
    notes = e.select("note_id").distinct().withColumn("body", F.lit("head <!-- state -->\nold\n<!-- /state --> tail"))
    return reports.state_block(notes, e, 3)


@register("V4_gold_hit", "SELECT p_partkey AS query_id, p_partkey % 2 = 0 AS gold_hit FROM part")
def v4(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    answers = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("The "), "p_name", F.lit(".")).alias("gold"))
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("so a "), F.upper("p_name"), F.lit("! indeed"))).otherwise("other words")
    return reports.gold_hit(answers, part.select(F.col("p_partkey").alias("query_id"), shown.alias("content")))


@register("V5_run_summary", "WITH r AS (SELECT event_type AS type, value, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS m FROM events), i AS (SELECT event_type AS type, count(DISTINCT user_id) * 100 AS ingested_chars FROM events GROUP BY 1) SELECT type, count(*) AS n, round(avg(CAST(value > 20 AS INTEGER)), 6) AS accuracy, round(avg(value / 1000), 6) AS recall, max(value) FILTER (WHERE place = CAST(floor(0.95 * (m - 1)) AS BIGINT)) AS p95_ms, any_value(ingested_chars) AS ingested_chars FROM r JOIN i USING (type) GROUP BY 1")
def v5(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("type"), (F.col("value") > 20).alias("correct"), (F.col("value") / 1000).alias("recall"), F.col("value").alias("latency_ms"), F.col("user_id").alias("haystack"), F.lit(100).alias("ingested_chars"))
    return reports.run_summary(rows)


@register("X6_question_speaker", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS speaker FROM benchmark")
def x6(spark, sf_dir):
    asked = F.when(F.col("item_id") % 2 == 0, "what you told me of the trip").otherwise("where did I go")
    return load(spark, sf_dir, "benchmark").select("item_id", extract.question_speaker(asked).alias("speaker"))


@register("S15_contract_gate", "SELECT event_id, event_id % 4 < 2 AS ok FROM events")
def s15(spark, sf_dir):
    version = F.element_at(F.array(*map(F.lit, ("d11.4", "d12.0", "d9.9", "11.4"))), (1 + F.col("event_id") % 4).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", text.contract_at_least(version, "d11.3").alias("ok"))
