"""Queries that bind the operators to the tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import scores, text
from annalist.operators import evaluate, feedback, governance, graph, ledger, retrieve, temporal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NOW = "2024-03-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def observations(events: DataFrame) -> DataFrame:
    """Events as claims: what a user did last is the value of the user."""
    return events.select("user_id", F.col("event_type").alias("dst"), F.col("ts").alias("valid_at"), F.col("ts").alias("ingested_at"), "event_id")


CHUNKS = "chunks AS (SELECT doc_id, i AS ordinal, substr(coalesce(text,''), i*1000+1, 1000) AS content FROM documents, LATERAL (SELECT unnest(generate_series(0, greatest((length(coalesce(text,''))-1)//1000, 0))) AS i))"
INDEX = f"{CHUNKS}, idx AS (SELECT doc_id, ordinal, unnest(list_distinct(list_transform(regexp_extract_all(content, '[a-zA-Z0-9_]{{3,}}'), lambda t: lower(t)))) AS term FROM chunks)"
ASKED = "asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_slice(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]{3,}'), lambda t: lower(t)), 1, 8)) AS term FROM benchmark) GROUP BY 1, 2)"
LEXICAL = f"""WITH {INDEX}, {ASKED}, dfs AS (SELECT term, count(*) AS df FROM idx WHERE term IN (SELECT term FROM asked) GROUP BY 1),
weights AS (SELECT term, ln(1 + ((SELECT count(*) FROM chunks) - df + 0.5) / (df + 0.5)) AS idf FROM dfs),
scored AS (SELECT query_id, doc_id, ordinal, round(sum(times * idf), 6) AS score FROM idx JOIN asked USING (term) JOIN weights USING (term) GROUP BY 1, 2, 3),
legs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM scored)"""
RUNS = """WITH o AS (SELECT user_id, event_type AS dst, ts AS valid_at, event_id, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT user_id, dst, valid_at, lead(valid_at) OVER (PARTITION BY user_id ORDER BY valid_at, event_id) AS invalid_at, event_id FROM o WHERE before IS NULL OR before <> dst)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def lexical(spark: SparkSession, sf_dir: str, k: int = 60) -> DataFrame:
    return retrieve.lexical_topk(questions(spark, sf_dir), retrieve.chunks_of(load(spark, sf_dir, "documents")), k)


@register("R7_lexical_topk", f"{LEXICAL} SELECT query_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal, score, CAST(rank AS INTEGER) AS rank FROM legs WHERE rank <= 60")
def r7(spark, sf_dir):
    return lexical(spark, sf_dir)


@register("R6_idf", f"WITH {INDEX}, {ASKED} SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM chunks) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM idx WHERE term IN (SELECT term FROM asked) GROUP BY 1")
def r6(spark, sf_dir):
    chunks = retrieve.chunks_of(load(spark, sf_dir, "documents"))
    asked = retrieve.terms_of_queries(questions(spark, sf_dir)).select("term").distinct()
    return retrieve.idf(retrieve.inverted_index(chunks).join(asked, "term"), chunks.agg(F.count("*"))).withColumn("idf", F.round("idf", 6))


@register("R14_cap_per_doc", f"""{LEXICAL}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, ordinal) AS n FROM legs WHERE rank <= 60),
best AS (SELECT query_id, doc_id, ordinal, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM own WHERE n <= 2)
SELECT query_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal, score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 20""")
def r14(spark, sf_dir):
    return retrieve.cap_per_doc(lexical(spark, sf_dir), 2, 20)


@register("X1_chunks_fixed", f"WITH {CHUNKS} SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, length(content) AS n_chars, md5(content) AS digest FROM chunks")
def x1(spark, sf_dir):
    chunks = retrieve.chunks_of(load(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "ordinal", F.char_length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


@register("X1_chunks_paragraphs")
def x1p(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return docs.select("doc_id", F.posexplode(text.chunk_paragraphs(F.col("text"))).alias("ordinal", "content"))


@register("R2_vector_topk", """WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30""")
def r2(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    return retrieve.vector_topk(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors)


@register("R2_index_topk")
def r2i(spark, sf_dir):
    """Through the index, whose recall against ``R2_vector_topk`` a test measures."""
    from annalist.operators import vectors as lists

    vectors = load(spark, sf_dir, "embeddings")
    return lists.index_topk(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), lists.build_index(vectors))


@register("R10_rrf", f"""{LEXICAL}, first AS (SELECT query_id, doc_id, min(rank) AS rank FROM legs WHERE rank <= 60 GROUP BY 1, 2),
newest AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM first),
both_legs AS (SELECT query_id, doc_id, 1.0/(60+rank) AS part FROM first UNION ALL SELECT query_id, doc_id, 0.7/(60+rank) FROM newest)
SELECT query_id, doc_id, round(sum(part), 9) AS score FROM both_legs GROUP BY 1, 2""")
def r10(spark, sf_dir):
    first = lexical(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    newest = retrieve.top(first.drop("rank"), "query_id", [F.desc("doc_id")], 1 << 30)
    legs = first.withColumn("leg", F.lit("lexical")).unionByName(newest.withColumn("leg", F.lit("title")))
    return retrieve.rrf(legs, {"lexical": 1.0, "title": 0.7}, ["doc_id"])


@register("K13_context_block", f"""{LEXICAL}, sized AS (SELECT query_id, rank, length(content) AS size FROM legs JOIN chunks USING (doc_id, ordinal) WHERE rank <= 60),
run AS (SELECT query_id, rank, size, sum(size) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM sized)
SELECT query_id, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS used FROM run WHERE running <= 6000 GROUP BY 1""")
def k13(spark, sf_dir):
    chunks = retrieve.chunks_of(load(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.char_length("content").alias("size"))
    block = retrieve.context_block(lexical(spark, sf_dir).join(chunks, ["doc_id", "ordinal"]), "query_id", 6000)
    return block.groupBy("query_id").agg(F.count("*").alias("n_items"), F.sum("size").alias("used"))


@register("B4_supersede", f"{RUNS} SELECT user_id, dst, valid_at, invalid_at, event_id FROM runs")
def b4(spark, sf_dir):
    return temporal.supersede(observations(load(spark, sf_dir, "events")), ["user_id"]).select("user_id", "dst", "valid_at", "invalid_at", "event_id")


@register("B4_supersede_by_arrival")
def b4a(spark, sf_dir):
    obs = observations(load(spark, sf_dir, "events")).withColumn("ingested_at", F.col("valid_at") + F.expr("make_interval(0,0,0,pmod(hash(event_id),3),0,0,0)"))
    return temporal.supersede_by_arrival(obs, ["user_id"])


@register("P6_as_of", f"{RUNS}, mid AS (SELECT make_timestamp(CAST(floor((epoch_us(min(ts)) + epoch_us(max(ts))) / 2) AS BIGINT)) AS t FROM events) SELECT user_id, dst FROM runs, mid WHERE valid_at <= t AND (invalid_at IS NULL OR invalid_at > t)")
def p6(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    middle = events.agg(F.timestamp_micros(((scores.micros(F.min("ts")) + scores.micros(F.max("ts"))) / 2).cast("long"))).scalar()
    return temporal.at_time(temporal.supersede(observations(events), ["user_id"]), middle).select("user_id", "dst")


@register("A4_metric_history", f"{RUNS} SELECT user_id, count(*) AS n_values, count(*) FILTER (WHERE invalid_at IS NULL) AS n_current, max_by(dst, (valid_at, event_id)) AS last_value, min(valid_at) AS first_at FROM runs GROUP BY 1")
def a4(spark, sf_dir):
    return temporal.metric_history(temporal.supersede(observations(load(spark, sf_dir, "events")), ["user_id"]), ["user_id"])


@register("B8_value_status", f"{RUNS} SELECT dst, CASE WHEN bool_or(invalid_at IS NULL) THEN 'committed' ELSE 'superseded' END AS status FROM runs GROUP BY 1")
def b8(spark, sf_dir):
    return temporal.value_status(temporal.supersede(observations(load(spark, sf_dir, "events")), ["user_id"]))


@register("A6_freshness", f"""WITH g AS (SELECT user_id, event_type, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts))) / 3600000000.0 AS gap FROM events),
p AS (SELECT user_id, event_type, max(ts) AS last_at, median(gap) FILTER (WHERE gap >= 1) AS cadence FROM g GROUP BY 1, 2)
SELECT user_id, event_type, last_at, round(cadence, 6) AS cadence_hours, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_at)) / 3600000000.0 > coalesce(2 * cadence, 720) AS stale FROM p""")
def a6(spark, sf_dir):
    values = load(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("valid_at"))
    return temporal.freshness(values, ["user_id", "event_type"], now()).select("user_id", "event_type", "last_at", F.round("cadence_hours", 6).alias("cadence_hours"), "stale")


@register("A3_contradiction_backlog", "SELECT user_id, count(DISTINCT event_type) AS n_open FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def a3(spark, sf_dir):
    edges = temporal.supersede(observations(load(spark, sf_dir, "events")), ["user_id", "dst"])
    return temporal.contradiction_backlog(edges, ["user_id"])


@register("A1_store_stats", "SELECT source, lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1, 2")
def a1(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@register("S1_append_episodes", "SELECT event_id % 100 AS id, count(*) AS n, count(*) - 1 AS n_duplicate FROM events GROUP BY 1")
def s1(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    incoming = events.select((F.col("event_id") % 100).alias("event_id"), F.col("ts").alias("ingested_at"))
    done = ledger.append_episodes(incoming.limit(0), incoming)
    return done.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "duplicate").alias("n_duplicate"))


@register("S4_tail", "SELECT event_id, ts FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 99) ORDER BY ts, event_id LIMIT 100")
def s4(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "ts")
    last = ledger.tail(events, None, 100).orderBy(F.desc("ts"), F.desc("event_id")).first()
    return ledger.tail(events, (last["ts"], last["event_id"]), 100)


@register("S5_watermarks", "SELECT event_type AS source, max(ts) AS cursor_ts, max_by(event_id, (ts, event_id)) AS cursor_id FROM events GROUP BY 1")
def s5(spark, sf_dir):
    return ledger.watermarks(load(spark, sf_dir, "events").withColumnRenamed("event_type", "source"))


@register("S20_changed_only", "SELECT doc_id, substr(sha256(text), 1, 32) AS content_hash FROM documents WHERE lang <> 'en'")
def s20(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    state = docs.where("lang = 'en'").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32).alias("content_hash"))
    return ledger.changed_only(docs, state, "doc_id", "text").select("doc_id", "content_hash")


@register("S22_sync_catalogue", """WITH t AS (SELECT 'p' || p_partkey AS ref, p_name AS sha FROM part WHERE p_size <= 25), i AS (SELECT 'p' || p_partkey AS ref, CASE WHEN p_partkey % 3 = 0 THEN 'old' ELSE p_name END AS sha FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(t.ref, i.ref) AS ref, coalesce(t.sha, i.sha) AS sha, CASE WHEN i.sha IS NULL THEN 'new' WHEN t.sha IS NULL THEN 'gone' WHEN i.sha <> t.sha THEN 'changed' ELSE 'same' END AS status FROM t FULL JOIN i ON t.ref = i.ref""")
def s22(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumn("ref", F.concat(F.lit("p"), "p_partkey"))
    items = part.where("p_partkey % 2 = 0").select("ref", F.when(F.col("p_partkey") % 3 == 0, "old").otherwise(F.col("p_name")).alias("sha"))
    return ledger.sync_catalogue(part.select("ref", F.col("p_name").alias("sha"), F.col("p_size").alias("size")), items, "^p[0-9]+$", 25)


@register("G10_daily_budget", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS n, event_type FROM events) SELECT event_id, CASE WHEN n > 20 THEN 'budget:' || event_type || ':20/20' END AS drop_reason FROM r")
def g10(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("ingested_at"))
    return governance.daily_budget(events, ["event_type"], F.lit(20)).select("event_id", "drop_reason")


@register("G2_consent", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'consent:off' WHEN user_id % 7 = 0 THEN 'consent:pause' END AS consent_reason FROM events")
def g2(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    episodes = events.select("event_id", (F.col("user_id") % 5).cast("string").alias("org_id"), F.lit("user").alias("scope"), F.col("user_id").cast("string").alias("scope_id"))
    users = events.select("user_id").distinct()
    consent = users.where("user_id % 7 = 0").select(F.lit("user").alias("scope"), F.col("user_id").cast("string").alias("scope_id"), F.lit("pause").alias("state"))
    org = events.select(F.lit("org").alias("scope"), (F.col("user_id") % 5).cast("string").alias("scope_id")).where("scope_id = '0'").distinct().withColumn("state", F.lit("off"))
    return governance.resolve_consent(episodes, consent.unionByName(org)).select("event_id", "consent_reason")


STOP = ", ".join(f"'{t}'" for t in text.STOP_TERMS)
LEADING = f"""WITH w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(coalesce(text,''), '[a-zA-Z][a-zA-Z0-9_-]{{3,}}'), lambda t: lower(t)) AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM w), c AS (SELECT doc_id, term, count(*) AS times, min(pos) AS pos FROM e WHERE term NOT IN ({STOP}) GROUP BY 1, 2)
SELECT doc_id, term, times, CAST(pos AS INTEGER) AS pos, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, pos) AS rank FROM c) WHERE rank <= 24"""


@register("G6_leading_terms", LEADING)
def g6(spark, sf_dir):
    return governance.leading_terms(load(spark, sf_dir, "documents"))


@register("G7_distinctiveness", f"""WITH w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(coalesce(text,''), '[a-zA-Z][a-zA-Z0-9_-]{{3,}}'), lambda t: lower(t)) AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM w WHERE lang = 'en'),
c AS (SELECT doc_id, term, count(*) AS times, min(pos) AS pos FROM e WHERE term NOT IN ({STOP}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, pos) AS rank FROM c),
k AS (SELECT DISTINCT unnest(ws) AS term FROM w WHERE lang <> 'en')
SELECT doc_id, round(count(*) FILTER (WHERE k.term IS NULL) / count(*), 6) AS distinctiveness FROM r LEFT JOIN k USING (term) WHERE rank <= 24 GROUP BY 1""")
def g7(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return governance.distinctiveness(docs.where("lang = 'en'"), docs.where("lang <> 'en'")).withColumn("distinctiveness", F.round("distinctiveness", 6))


@register("G13_pii_kinds", r"""SELECT doc_id, regexp_matches(text, '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b') AS email, regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') AS national_id FROM documents""")
def g13(spark, sf_dir):
    kinds = text.pii_kinds(F.coalesce("text", F.lit("")))
    has = lambda k: F.array_contains("kinds", k).alias(k.replace("-", "_"))
    return load(spark, sf_dir, "documents").withColumn("kinds", kinds).select("doc_id", has("email"), has("national-id"))


@register("G11_redact")
def g11(spark, sf_dir):
    clean, refs = text.redact(F.coalesce("text", F.lit("")))
    return load(spark, sf_dir, "documents").select("doc_id", clean.alias("text"), refs.alias("refs"))


@register("G19_retention", "SELECT count(*) AS n, min(ts) AS first_at FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events)")
def g19(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    cutoff = events.agg(F.max("ts") - F.expr("INTERVAL 10 DAYS")).scalar()
    return governance.apply_retention(events, "ts", cutoff).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"))


@register("T2_graph_distance", """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(query_id, node_id, hops) AS (SELECT s_suppkey, 's' || s_suppkey, 0 FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT w.query_id, d.b, w.hops + 1 FROM w JOIN d ON w.node_id = d.a WHERE w.hops < 2)
SELECT query_id, hops, count(*) AS n FROM (SELECT query_id, node_id, min(hops) AS hops FROM w GROUP BY 1, 2) GROUP BY 1, 2""")
def t2(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src_id"), F.concat(F.lit("o"), "o_orderkey").alias("dst_id"))
    lines = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src_id"), F.concat(F.lit("s"), "l_suppkey").alias("dst_id"))
    starts = load(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("s"), "s_suppkey").alias("node_id"))
    return graph.hops(starts, orders.unionByName(lines), 2).groupBy("query_id", "hops").agg(F.count("*").alias("n"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations in them and customers in those, as one tree."""
    region = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("unit_id"), F.lit(None).cast("string").alias("parent_id"))
    nation = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("unit_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    customer = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("unit_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return region.unionByName(nation).unionByName(customer)


@register("B16_unit_closure", """WITH RECURSIVE u AS (SELECT 'r' || r_regionkey AS unit_id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
up(unit_id, ancestor_id, distance) AS (SELECT unit_id, unit_id, 0 FROM u UNION ALL SELECT up.unit_id, u.parent_id, up.distance + 1 FROM up JOIN u ON up.ancestor_id = u.unit_id WHERE u.parent_id IS NOT NULL)
SELECT ancestor_id, distance, count(*) AS n FROM up GROUP BY 1, 2""")
def b16(spark, sf_dir):
    return graph.unit_closure(units(spark, sf_dir)).groupBy("ancestor_id", "distance").agg(F.count("*").alias("n"))


@register("P3_accessible_scopes", """SELECT c_custkey AS caller_id, unnest(['user','team','org','global']) AS scope, unnest([CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(c_nationkey AS VARCHAR), NULL]) AS scope_id, CAST(unnest([0,1,2,3]) AS INTEGER) AS pos FROM customer""")
def p3(spark, sf_dir):
    callers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("caller_id"), F.array("c_mktsegment").alias("team_ids"), F.col("c_nationkey").alias("org_id"))
    return governance.accessible_scopes(callers)


@register("P17_document_browse", "WITH c AS (SELECT doc_id, greatest((length(coalesce(text,''))-1)//1000, 0) + 1 AS n_chunks FROM documents) SELECT doc_id, source, lang, CAST(n_chunks AS BIGINT) AS n_chunks FROM documents JOIN c USING (doc_id) WHERE contains(lower(source), 'c1') ORDER BY doc_id DESC LIMIT 50")
def p17(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    found = docs.where(F.lower("source").contains("c1"))
    n = retrieve.chunks_of(found).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return found.join(n, "doc_id").select("doc_id", "source", "lang", "n_chunks").orderBy(F.desc("doc_id")).limit(50)


def runs_of(events: DataFrame) -> DataFrame:
    result = F.when(F.col("value") > 20, "success").when(F.col("value") > 10, "max_turns").otherwise("error")
    return events.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 10).alias("org_id"), F.col("event_type").alias("task"), result.alias("run_result"), F.col("value").alias("turns"), "ts")


RESULT = "CASE WHEN value > 20 THEN 'success' WHEN value > 10 THEN 'max_turns' ELSE 'error' END"


@register("A7_run_stats", f"WITH r AS (SELECT event_type AS task, user_id % 10 AS org_id, {RESULT} AS res, value FROM events) SELECT task, org_id, count(*) AS n_runs, count(*) FILTER (WHERE res = 'success') AS n_success, count(*) FILTER (WHERE res = 'max_turns') AS n_stalls, round(median(value), 6) AS median_turns, round(count(*) FILTER (WHERE res = 'max_turns') / count(*), 6) AS stall_share FROM r GROUP BY 1, 2 HAVING count(*) >= 30")
def a7(spark, sf_dir):
    return feedback.run_stats(runs_of(load(spark, sf_dir, "events")), ["task", "org_id"]).withColumn("median_turns", F.round("median_turns", 6))


@register("A15_fleet", f"WITH c AS (SELECT event_type AS task, {RESULT} AS run_result, count(*) AS n, count(DISTINCT user_id % 10) AS tenants FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id % 10) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, run_result) AS rank FROM c) SELECT task, run_result, n, tenants, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def a15(spark, sf_dir):
    return feedback.fleet(runs_of(load(spark, sf_dir, "events")))


@register("F1_consequences", f"WITH s AS (SELECT event_id AS run_id, unnest(list_distinct([user_id % 50, user_id % 7])) AS node_id, {RESULT} AS res FROM events) SELECT node_id, count(*) FILTER (WHERE res = 'success') AS passes, count(*) FILTER (WHERE res <> 'success') AS fails, count(DISTINCT run_id) AS runs FROM s GROUP BY 1")
def f1(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    served = events.select(F.col("event_id").alias("run_id"), F.array(F.col("user_id") % 50, F.col("user_id") % 7).alias("node_ids"))
    return feedback.consequences(served, runs_of(events))


@register("F4_trust_tiers", f"""WITH s AS (SELECT event_id AS run_id, unnest(list_distinct([user_id % 50, user_id % 7])) AS node_id, {RESULT} AS res FROM events),
c AS (SELECT node_id, count(*) FILTER (WHERE res = 'success') AS p, count(*) FILTER (WHERE res <> 'success') AS f, count(DISTINCT run_id) AS runs FROM s GROUP BY 1)
SELECT node_id, CASE WHEN node_id % 11 = 0 THEN 'endorsed' WHEN node_id % 3 = 0 THEN 'probation' WHEN (runs >= 2 OR p >= 3) AND f = 0 THEN 'corroborated' ELSE 'probation' END AS tier FROM c""")
def f4(spark, sf_dir):
    c, n = f1(spark, sf_dir), F.col("node_id")
    return c.select("node_id", scores.trust_tier(n % 11 == 0, n % 3 != 0, F.col("runs"), F.col("passes"), F.col("fails")).alias("tier"))


@register("A16_usage", "SELECT node_id, count(*) AS served_count, max(ts) AS last_served_at FROM (SELECT ts, unnest([user_id % 50, user_id % 7]) AS node_id FROM events) GROUP BY 1")
def a16(spark, sf_dir):
    return feedback.usage(load(spark, sf_dir, "events").select(F.col("ts").alias("served_at"), F.array(F.col("user_id") % 50, F.col("user_id") % 7).alias("node_ids")))


@register("A19_latency_histogram", "SELECT event_type, CAST(CASE WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 25 THEN 25 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 WHEN value <= 250 THEN 250 WHEN value <= 500 THEN 500 WHEN value <= 1000 THEN 1000 END AS INTEGER) AS le, count(*) AS n FROM events GROUP BY 1, 2")
def a19(spark, sf_dir):
    return feedback.latency_histogram(load(spark, sf_dir, "events"), ["event_type"], "value")


@register("V7_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value FROM r WHERE place = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)")
def v7(spark, sf_dir):
    return feedback.nearest_rank(load(spark, sf_dir, "events"), ["event_type"], "value", 0.95)


GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def golds(spark, sf_dir) -> DataFrame:
    """Documents that hold a question's whole text: met by its longest inner word, then compared."""
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.transform(F.regexp_extract_all("passage", F.lit("[a-zA-Z0-9_]{3,}"), 0), F.lower)
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    keyed = b.where(F.size(words) > 2).withColumn("term", longest)
    terms = docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    met = terms.join(keyed.select("query_id", "term"), "term").select("query_id", "doc_id").join(b, "query_id").join(docs, "doc_id")
    found = met.where(F.col("text").contains(F.col("passage"))).select("query_id", "doc_id")
    # one or two words may be parts of longer ones: these are met by the first three letters of the longest
    few = b.where(F.size(words).between(1, 2)).withColumn("part", F.substring(F.element_at(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"], 1, 3))
    if few.limit(1).count():
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
        parts = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform(text.tokens(F.col("text")), cut)))).alias("part"))
        pairs = parts.join(few, "part").select("query_id", "passage", "doc_id").join(docs, "doc_id")
        found = found.unionByName(pairs.where(F.col("text").contains(F.col("passage"))).select("query_id", "doc_id"))
    none = b.where(F.size(words) == 0)
    if none.limit(1).count():  # nothing to meet by
        found = found.unionByName(none.join(docs, F.col("text").contains(F.col("passage"))).select("query_id", "doc_id"))
    return found


@register("V1_retrieval_metrics", f"{LEXICAL}, {GOLD}, f AS (SELECT query_id, min(rank) AS first_rank FROM legs JOIN gold USING (query_id, doc_id) WHERE rank <= 60 GROUP BY 1) SELECT query_id, CAST(first_rank AS INTEGER) AS first_rank, coalesce(first_rank <= 5, false) AS hit, round(coalesce(1.0 / first_rank, 0), 6) AS rr FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN f USING (query_id)")
def v1(spark, sf_dir):
    return evaluate.retrieval_metrics(lexical(spark, sf_dir), golds(spark, sf_dir)).withColumn("rr", F.round("rr", 6))


@register("V2_recall_at", f"{LEXICAL}, {GOLD}, h AS (SELECT DISTINCT query_id, doc_id, 1 AS hit FROM legs WHERE rank <= 15) SELECT query_id, round(count(hit) / count(*), 6) AS recall FROM (SELECT DISTINCT * FROM gold) LEFT JOIN h USING (query_id, doc_id) GROUP BY 1")
def v2(spark, sf_dir):
    return evaluate.recall_at(lexical(spark, sf_dir), golds(spark, sf_dir), 15)


@register("X7_slug", "SELECT p_partkey, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 20), '-+$', ''), ''), 'fact') AS slug FROM part")
def x7(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type"), 20).alias("slug"))


@register("X21_sentence_facts", r"""WITH s AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda x: trim(x))) AS s FROM documents) SELECT doc_id, count(*) AS n, md5(min(s)) AS first_digest FROM s WHERE len(regexp_split_to_array(s, '[ \t\n\r\f\x0b]+')) >= 3 GROUP BY 1""")
def x21(spark, sf_dir):
    facts = load(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return facts.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.min("s").cast("binary")).alias("first_digest"))


@register("X5_user_turns", r"WITH c AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1) SELECT conv_id, regexp_matches(body, '(?im)^[ \t\n\r\f]*(user|human)[ \t\n\r\f]*:') AS has_user, length(body) AS n_chars FROM c")
def x5(spark, sf_dir):
    line = F.concat_ws("", "role", F.lit(": "), F.coalesce("text", F.lit("")))
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"]), "\n").alias("body"))
    return turns.select("conv_id", text.has_user_turn(F.col("body")).alias("has_user"), F.char_length("body").cast("long").alias("n_chars"))


@register("K1_recency", f"SELECT event_id, round(greatest(0.35, power(2.0, -greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0) / 180)), 9) AS factor FROM events")
def k1(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(scores.recency_factor(F.col("ts"), now()), 9).alias("factor"))


@register("B1_build_nodes", "SELECT user_id, max_by(event_type, (ts, event_id)) AS name, min_by('s' || (value > 10)::INT, (ts, event_id)) AS source, count(DISTINCT event_id) AS observed_count, max(ts) AS last_observed_at FROM events GROUP BY 1")
def b1(spark, sf_dir):
    entities = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), F.concat(F.lit("s"), (F.col("value") > 10).cast("int")).alias("source"), "event_id", F.col("ts").alias("occurred_at"), F.lit("committed").alias("status"))
    return graph.build_nodes(entities, ["user_id"]).select("user_id", "name", "source", "observed_count", "last_observed_at")


def streamed(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """The rows that a stream over the events table leaves behind once it has read everything there is."""
    import uuid

    from annalist.sources.shared import shared_folder

    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if is_folder(spark, path) else f"{sf_dir}/events*.parquet")
    out = build(stream)
    out.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


def is_folder(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory()


@register("Z8_metrics_stream", "WITH d AS (SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2) SELECT event_type, n, total FROM d WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def z8(spark, sf_dir):
    from annalist.streaming.streams import metrics_stream

    stream = lambda s: metrics_stream(s.withColumn("ts", F.col("ts").cast("timestamp")), "event_type")
    return streamed(spark, sf_dir, stream).select("event_type", "n", "total")


@register("Z1_dedup_stream", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def z1(spark, sf_dir):
    from annalist.streaming.streams import dedup_stream

    kept = streamed(spark, sf_dir, lambda s: dedup_stream(s.withColumn("ts", F.col("ts").cast("timestamp"))).select("event_id", "ts"))
    return kept.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


@register("Z3_current_value_stream", "SELECT user_id, max_by(event_type, (ts, event_id)) AS dst FROM events GROUP BY 1")
def z3(spark, sf_dir):
    from annalist.streaming.streams import current_value_stream

    obs = lambda s: s.select("user_id", F.col("event_type").alias("dst"), F.col("ts").cast("timestamp").alias("valid_at"), "event_id")
    told = streamed(spark, sf_dir, lambda s: current_value_stream(obs(s)))
    return told.groupBy("user_id").agg(F.max_by("dst", "valid_at").alias("dst"))


@register("Z2_route_failures", "SELECT event_type, CASE WHEN value > 10 THEN 'ok' WHEN event_id % 6 + 1 >= 5 THEN 'dead' ELSE 'retry' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def z2(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    batch = events.select("event_id", "event_type", F.when(F.col("value") <= 10, "bad value").alias("error"))
    attempts = events.select("event_id", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 6).cast("int"))).alias("i")).where("i > 0").select("event_id")
    return ledger.route_failures(batch, attempts).groupBy("event_type", "status").agg(F.count("*").alias("n"))


@register("S8_audit_log", "SELECT CASE event_type WHEN 'click' THEN 'org.member_added' WHEN 'view' THEN 'org.role_changed' END AS action_type, CAST(user_id % 10 AS VARCHAR) AS scope_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def s8(spark, sf_dir):
    from annalist.sources.producers import from_audit_log

    action = F.when(F.col("event_type") == "click", "member_added").when(F.col("event_type") == "view", "member_role_changed").otherwise("other")
    log = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("organization_id"), F.col("user_id").alias("actor_user_id"), action.alias("action"), F.col("user_id").alias("target_user_id"), F.col("ts").alias("created_at"))
    return from_audit_log(log).groupBy("action_type", "scope_id").agg(F.count("*").alias("n"))


@register("S13_normalize_runs", "SELECT CASE WHEN event_id % 13 = 0 THEN 'contract' WHEN event_id % 11 = 0 THEN 'run_result' WHEN value > 20 AND event_id % 7 = 0 THEN 'failure_class_on_success' WHEN event_id % 5 = 0 THEN 'wall_ms' END AS reject_reason, count(*) AS n FROM events GROUP BY 1")
def s13(spark, sf_dir):
    from annalist.sources.producers import normalize_runs

    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    won = F.col("value") > 20
    runs = e.select(
        F.when(i % 13 == 0, "v11").otherwise("d11.4").alias("contract"), F.when(i % 11 == 0, "odd").when(won, "success").otherwise("error").alias("run_result"),
        F.when(won & (i % 7 != 0), None).otherwise("tool").alias("failure_class"), F.when(i % 5 != 0, F.lit(7)).alias("wall_ms"), F.lit("main").alias("role"), i.alias("run_id"),
    )
    ok, rejects = normalize_runs(runs)
    return ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects).groupBy("reject_reason").agg(F.count("*").alias("n"))


@register("S17_sessions_to_documents", "WITH d AS (SELECT conv_id AS session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content, count(*) FILTER (WHERE role = 'user') AS user_turns FROM conversations GROUP BY 1) SELECT session_id, user_turns, md5(content) AS digest FROM d WHERE user_turns >= 1 AND length(content) >= 2000")
def s17(spark, sf_dir):
    from annalist.sources.producers import sessions_to_documents

    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("n"), F.col("role").alias("type"), F.when(F.col("turn") == 0, "2024-01-01").alias("day"), "text", F.lit(False).alias("is_sidechain"))
    return sessions_to_documents(c).select("session_id", "user_turns", F.md5(F.col("content").cast("binary")).alias("digest"))


@register("G3_resolve_policy", "SELECT CAST(c_custkey AS VARCHAR) AS target, CASE WHEN c_nationkey % 2 = 0 THEN 'mail' ELSE '' END AS denied, CASE WHEN c_custkey % 3 = 0 THEN 'chat' ELSE 'chat,docs' END AS allowed, greatest(0.1, (c_custkey % 4) / 10.0) AS min_salience FROM customer")
def g3(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    one = lambda scope, i: c.select(key.alias("target"), F.lit(scope).alias("scope"), i.cast("string").alias("scope_id"))
    arr = lambda *x: F.array(*map(F.lit, x))
    org = c.select("c_nationkey").distinct().select(F.lit("org").alias("scope"), F.col("c_nationkey").cast("string").alias("scope_id"), F.when(F.col("c_nationkey") % 2 == 0, arr("mail")).alias("deny_sources"), arr("docs", "chat").alias("allow_sources"), F.lit(0.1).alias("min_salience"), F.lit(50).alias("budget"))
    user = c.select(F.lit("user").alias("scope"), key.alias("scope_id"), F.lit(None).cast("array<string>").alias("deny_sources"), F.when(F.col("c_custkey") % 3 == 0, arr("chat", "mail")).alias("allow_sources"), ((F.col("c_custkey") % 4) / 10.0).alias("min_salience"), F.lit(20).alias("budget"))
    found = governance.resolve_policy(one("org", F.col("c_nationkey")).unionByName(one("user", F.col("c_custkey"))), org.unionByName(user))
    return found.select("target", F.array_join("deny_sources", ",").alias("denied"), F.array_join("allow_sources", ",").alias("allowed"), "min_salience")


@register("B5_end_edges", f"{RUNS} SELECT user_id, count(*) FILTER (WHERE invalid_at IS NULL) AS n_open FROM (SELECT user_id, CASE WHEN invalid_at IS NULL AND user_id % 2 = 0 THEN (SELECT max(ts) FROM events) ELSE invalid_at END AS invalid_at FROM runs) GROUP BY 1")
def b5(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    edges = temporal.supersede(observations(events), ["user_id"])
    ends = events.where("user_id % 2 = 0").select("user_id").distinct().withColumn("ended_at", events.agg(F.max("ts")).scalar())
    return temporal.end_edges(edges, ends, ["user_id"]).groupBy("user_id").agg(F.count_if(F.col("invalid_at").isNull()).alias("n_open"))


@register("R15_merge_scopes", "WITH h AS (SELECT user_id % 9 AS query_id, event_type AS type, user_id % 30 AS key, event_id AS node_id, value AS score, ['org','team','user'][1 + event_id % 3] AS scope, [1,2,6][1 + event_id % 3] AS scope_rank FROM events) SELECT query_id, type, key, max_by(node_id, (scope_rank, score, node_id)) AS node_id, max_by(scope, (scope_rank, score, node_id)) AS scope, max(score) AS score, count(DISTINCT scope) AS n_scopes FROM h GROUP BY 1, 2, 3")
def r15(spark, sf_dir):
    scope = F.element_at(F.array(F.lit("org"), F.lit("team"), F.lit("user")), (1 + F.col("event_id") % 3).cast("int"))
    hits = load(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("query_id"), F.col("event_type").alias("type"), (F.col("user_id") % 30).alias("key"), F.col("event_id").alias("node_id"), F.col("value").alias("score"), scope.alias("scope"))
    found = retrieve.merge_scopes(hits.withColumn("scope_rank", governance.scope_rank(F.col("scope"))))
    return found.withColumn("n_scopes", F.col("n_scopes").cast("long"))


@register("A14_tune_due", "WITH t AS (SELECT event_type AS hop, min(ts) + INTERVAL 5 DAY AS last_at FROM events GROUP BY 1), p AS (SELECT hop, last_at, count(*) AS n_runs FROM events e JOIN t ON e.event_type = t.hop WHERE ts > last_at GROUP BY 1, 2) SELECT hop, n_runs, n_runs >= 30 AND last_at <= TIMESTAMP '2024-03-01' - INTERVAL 28 DAY AS due FROM p")
def a14(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("hop"), F.col("ts").alias("at"))
    turns = e.groupBy("hop").agg((F.min("at") + F.expr("INTERVAL 5 DAYS")).alias("at"))
    return feedback.tune_due(e, turns, F.lit(NOW).cast("timestamp_ntz")).select("hop", "n_runs", "due")


@register("V3_token_f1", "WITH p AS (SELECT p_partkey AS id, p_name AS predicted, p_type AS gold FROM part), a AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(predicted), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS t FROM p) WHERE t <> '' GROUP BY 1, 2), b AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(gold), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS t FROM p) WHERE t <> '' GROUP BY 1, 2), j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.id = b.id AND a.t = b.t) SELECT id, round(2.0 * sum(least(x, y)) / (sum(x) + sum(y)), 6) AS f1 FROM j GROUP BY 1")
def v3(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("predicted"), F.col("p_type").alias("gold"))
    return evaluate.token_f1(part)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text, a line for each turn."""
    line = F.concat_ws("", "role", F.lit(": "), F.coalesce("text", F.lit("")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"]), "\n")
    return load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(whole.alias("text"))


@register("X4_split_turns", r"""WITH t AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS x FROM conversations GROUP BY 1),
l AS (SELECT conv_id, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS pos FROM t),
h AS (SELECT *, CASE WHEN contains(line, ':') THEN regexp_replace(split_part(line, ':', 1), '^\s+|\s+$', '', 'g') END AS head FROM l WHERE regexp_matches(line, '\S')),
r AS (SELECT *, lower(head) IN ('user', 'human', 'assistant', 'ai', 'bot') AS is_role, count(*) OVER (PARTITION BY conv_id, head) AS times, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM h),
m AS (SELECT *, bool_or(coalesce(is_role, false)) OVER (PARTITION BY conv_id) AS by_role FROM r),
s AS (SELECT *, coalesce(CASE WHEN by_role THEN is_role ELSE regexp_matches(head, '^[A-Z][a-z]+(?: [A-Z][a-z]+)?$') AND times > 1 END, false) AS starts FROM m),
k AS (SELECT *, sum(CAST(starts OR n = 1 AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) AS turn FROM s)
SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS turn, max(CASE WHEN starts THEN head END) AS speaker, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM k GROUP BY 1, 2""")
def x4(spark, sf_dir):
    from annalist.operators.extract import split_turns

    return split_turns(transcripts(spark, sf_dir)).select("doc_id", F.col("turn").cast("long").alias("turn"), "speaker", F.md5(F.col("body").cast("binary")).alias("digest"))


@register("X12_extract_rules", """WITH e AS (SELECT event_id, user_id, ['agent.created','skill.used','chat.message','agent.deployed','fact.observed'][1 + event_id % 5] AS a FROM events)
SELECT type, count(*) AS n FROM (SELECT 'MEMBER_OF' AS type FROM e UNION ALL SELECT 'AUTHORED' FROM e WHERE a = 'agent.created' UNION ALL SELECT 'USED_SKILL' FROM e WHERE a = 'skill.used' UNION ALL SELECT 'PARTICIPATED_IN' FROM e WHERE a = 'chat.message' UNION ALL SELECT unnest(['DEPLOYED','HAS_STATUS']) FROM e WHERE a = 'agent.deployed' UNION ALL SELECT 'DECIDED' FROM e WHERE a = 'fact.observed') GROUP BY 1""")
def x12(spark, sf_dir):
    from annalist.operators.extract import extract_rules

    kinds = F.array(*map(F.lit, ["agent.created", "skill.used", "chat.message", "agent.deployed", "fact.observed"]))
    action = F.element_at(kinds, (1 + F.col("event_id") % 5).cast("int"))
    e = load(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("occurred_at"), action.alias("action_type"), (F.col("user_id") % 7).alias("org_id"), "user_id", (F.col("user_id") % 11).alias("agent_id"), F.lit(None).cast("string").alias("server_id"),
        F.col("event_type").alias("skill_id"), (F.col("user_id") % 13).alias("chat_id"), F.lit(None).cast("string").alias("target_user_id"), F.concat(F.lit("value is "), F.col("value").cast("string")).alias("statement"),
    )
    return extract_rules(e).groupBy("type").agg(F.count("*").alias("n"))


@register("X13_extract_claims", "SELECT ['state','pref','record'][1 + event_id % 3] || ':u/' || user_id || ':' || event_type AS anchor, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def x13(spark, sf_dir):
    from annalist.operators.extract import extract_claims

    kind = F.element_at(F.array(F.lit("state"), F.lit("preference"), F.lit("record")), (1 + F.col("event_id") % 3).cast("int"))
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").alias("occurred_at"), "user_id", kind.alias("kind"), F.lit("u/{me}").alias("topic"), F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"), F.lit(None).cast("array<string>").alias("evidence_ids"))
    return extract_claims(e).groupBy("anchor").agg(F.count("*").alias("n"), F.max(F.col("value").cast("double")).alias("top"))


@register("X22_session_insights")
def x22(spark, sf_dir):
    from annalist.operators.extract import session_insights

    docs = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\bthe\b", "must").alias("text"))
    return session_insights(docs)


@register("X24_fold_topics", """WITH d AS (SELECT user_id AS topic, event_id, CAST(ts AS DATE) AS date, value FROM events)
SELECT topic, '' AS unit, round(sum(value), 4) AS total, count(*) AS n FROM d GROUP BY 1""")
def x24(spark, sf_dir):
    from annalist.operators.extract import fold_topics

    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("topic"), F.col("event_id").cast("string").alias("fact"), F.to_date("ts").alias("date"), F.lit("add").alias("op"), F.col("value").alias("qty"), F.lit("").alias("unit"))
    return fold_topics(e).withColumn("total", F.round("total", 4))


@register("K3_rank_facts", f"""WITH f AS (SELECT user_id % 20 AS query_id, event_id AS node_id, round(value * CASE event_type WHEN 'click' THEN greatest(0.35, power(2.0, -greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0) / 365)) WHEN 'view' THEN 1.0 ELSE greatest(0.35, power(2.0, -greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0, 0) / 90)) END, 9) AS final FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, node_id) AS rank FROM f) SELECT query_id, node_id, final, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def k3(spark, sf_dir):
    from annalist.operators.compose import rank_facts

    kind = F.when(F.col("event_type") == "click", "learning").when(F.col("event_type") == "view", "state").otherwise("deviation")
    facts = load(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("query_id"), F.col("event_id").alias("node_id"), F.col("value").alias("score"), kind.alias("kind"), F.lit(None).cast("string").alias("half_life"), F.col("ts").alias("stamp"), F.lit(1).alias("observed_count"), F.lit("committed").alias("status"))
    return rank_facts(facts, now()).select("query_id", "node_id", "final", "rank")


@register("K10_projection", """WITH i AS (SELECT o_custkey AS caller_id, o_orderkey AS item_id, o_orderpriority || o_orderkey AS text, o_orderdate AS stamp, CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 ELSE 2.0 END AS tier FROM orders),
r AS (SELECT *, row_number() OVER w AS rank, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM i WINDOW w AS (PARTITION BY caller_id ORDER BY tier, stamp DESC, item_id))
SELECT caller_id, CAST(rank AS INTEGER) AS rank, item_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 80""")
def k10(spark, sf_dir):
    from annalist.operators.compose import projection

    tier = F.when(F.col("o_orderstatus") == "F", "endorsed").when(F.col("o_orderstatus") == "O", "corroborated").otherwise("probation")
    items = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("caller_id"), F.lit(0).alias("section"), tier.alias("tier"), F.lit(False).alias("unprompted"), F.col("o_orderdate").alias("stamp"), F.col("o_orderkey").alias("item_id"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("text"))
    return projection(items, 20)


@register("K8_packet")
def k8(spark, sf_dir):
    from annalist.operators.compose import packet

    chunks = retrieve.chunks_of(load(spark, sf_dir, "documents"))
    hits = retrieve.cap_per_doc(lexical(spark, sf_dir), 2, 5).join(chunks, ["doc_id", "ordinal"])
    facts = hits.select("query_id", "rank", F.concat_ws("#", "doc_id", "ordinal").alias("node_id"), F.substring("content", 1, 60).alias("fact"))
    return packet(facts, hits)


@register("N3_note_as_of", "SELECT user_id AS note_id, max_by(event_type, event_id) AS body, max(event_id) AS version FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 10 DAY FROM events) GROUP BY 1")
def n3(spark, sf_dir):
    from annalist.operators.compose import note_as_of

    e = load(spark, sf_dir, "events")
    cutoff = e.agg(F.max("ts") - F.expr("INTERVAL 10 DAYS")).scalar()
    return note_as_of(e.select(F.col("user_id").alias("note_id"), F.col("event_type").alias("body"), F.col("event_id").alias("version"), F.col("ts").alias("created_at")), cutoff)


@register("B17_unit_access", """WITH RECURSIVE u AS (SELECT 'r' || r_regionkey AS unit_id, CAST(NULL AS VARCHAR) AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
up(unit_id, ancestor_id, distance) AS (SELECT unit_id, unit_id, 0 FROM u UNION ALL SELECT up.unit_id, u.parent_id, up.distance + 1 FROM up JOIN u ON up.ancestor_id = u.unit_id WHERE u.parent_id IS NOT NULL),
m AS (SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 3 = 0 THEN 'r' || (s_nationkey % 5) ELSE 'n' || s_nationkey END AS unit_id, CASE WHEN s_suppkey % 2 = 0 THEN 'admin' ELSE 'member' END AS role FROM supplier)
SELECT user_id, up.unit_id, CASE WHEN distance = 0 THEN 'write' WHEN ancestor_id IN ('r0', 'r2') THEN 'read' ELSE 'administer' END AS access FROM m JOIN up ON m.unit_id = up.ancestor_id WHERE distance = 0 OR role = 'admin'""")
def b17(spark, sf_dir):
    tree = units(spark, sf_dir).where("unit_id not like 'c%'")
    key = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("r"), F.col("s_nationkey") % 5)).otherwise(F.concat(F.lit("n"), "s_nationkey"))
    members = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), key.alias("unit_id"), F.when(F.col("s_suppkey") % 2 == 0, "admin").otherwise("member").alias("role"))
    policies = tree.select("unit_id", F.col("unit_id").isin("r0", "r2").alias("read_descendants"))
    return graph.unit_access(graph.unit_closure(tree), members, policies)


@register("R8_title_leg", r"""WITH t AS (SELECT p_partkey AS doc_id, unnest(list_distinct(list_transform(regexp_extract_all(p_name, '[a-zA-Z0-9_]{3,}'), lambda x: lower(x)))) AS term FROM part),
q AS (SELECT DISTINCT s_suppkey AS query_id, lower(p_type_word) AS term FROM (SELECT s_suppkey, unnest(list_slice(regexp_extract_all(p_name, '[a-zA-Z0-9_]{3,}'), 1, 8)) AS p_type_word FROM supplier JOIN part ON p_partkey = s_suppkey)),
m AS (SELECT DISTINCT query_id, doc_id FROM t JOIN q USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM m)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def r8(spark, sf_dir):
    part, supplier = load(spark, sf_dir, "part"), load(spark, sf_dir, "supplier")
    asked = supplier.join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.col("p_name").alias("question"))
    return retrieve.title_leg(asked, part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title")))


@register("G20_sweep_working", "SELECT event_type, count(*) AS n FROM events WHERE NOT (value > 10 AND ts <= (SELECT max(ts) - INTERVAL 14 DAY FROM events)) GROUP BY 1")
def g20(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > 10, "working").otherwise("committed").alias("status"), (F.col("ts") + F.expr("INTERVAL 14 DAYS")).alias("expires_at"))
    return governance.sweep_working(e, load(spark, sf_dir, "events").agg(F.max("ts")).scalar()).groupBy("event_type").agg(F.count("*").alias("n"))


@register("A18_token_cost", "SELECT event_type AS model, round(sum(value * 2 + value * 3 + value * 2 * 0.1 + value * 2 * 1.25), 3) AS cost FROM events GROUP BY 1")
def a18(spark, sf_dir):
    e, v = load(spark, sf_dir, "events"), F.col("value")
    tokens = e.select(F.col("event_type").alias("model"), v.alias("input"), v.alias("output"), v.alias("cache_read"), v.alias("cache_write"))
    return feedback.price_tokens(tokens, e.select(F.col("event_type").alias("model")).distinct().select("model", F.lit(2.0).alias("input_price"), F.lit(3.0).alias("output_price"))).withColumn("cost", F.round("cost", 3))


@register("V9_ablation", "SELECT event_type AS arm, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_cost, round(avg(CAST(value > 20 AS INTEGER)), 6) AS accuracy FROM events GROUP BY 1")
def v9(spark, sf_dir):
    return evaluate.ablation(load(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.col("value").alias("cost"), (F.col("value") > 20).alias("correct")))


@register("V6_compare_runs", "WITH r AS (SELECT event_type AS run, user_id AS id, max(value) > 50 AS correct FROM events GROUP BY 1, 2), s AS (SELECT id FROM r GROUP BY 1 HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM r)) SELECT run, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy FROM r WHERE id IN (SELECT id FROM s) GROUP BY 1")
def v6(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("id")).agg((F.max("value") > 50).alias("correct"))
    return evaluate.compare_runs(rows)
