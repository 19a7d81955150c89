"""Visibility, lifecycle, extraction and composition on literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalist.operators import compose, extract, governance, graph, visibility
from annalist.sources import producers


def at(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def test_browse_filter(spark):
    df = spark.createDataFrame([(1, "o", "user", "me"), (2, "o", "user", "you"), (3, "o", "team", "t"), (4, "o", "team", "x"), (5, None, "global", None), (6, "p", "org", "p")], "id int, org_id string, scope string, scope_id string")
    assert sorted(r["id"] for r in visibility.browse_filter(df, "o", "me", ["t"]).collect()) == [1, 3, 5]


def test_topic_filter(spark):
    df = spark.createDataFrame([(1, "infra/state/cost"), (2, "person/me/pref"), (3, "person/you/pref"), (4, None)], "id int, topic string")
    grants = spark.createDataFrame([("me", "infra/*"), ("me", "person/{me}/*")], "caller_id string, pattern string")
    got = lambda who: sorted(r["id"] for r in visibility.topic_filter(df, grants, who).collect())
    assert got("me") == [1, 2, 4] and got("other") == [1, 2, 3, 4]


def test_authorize_writes(spark):
    e = spark.createDataFrame([(1, "u", "user", "u"), (2, "u", "user", "v"), (3, "u", "global", None), (4, "s", "global", None), (5, "u", "team", "t"), (6, "zz", "org", "o")], "id int, caller_id string, scope string, scope_id string")
    callers = spark.createDataFrame([("u", "member", "o", ["t"]), ("s", "service", "o", [])], "caller_id string, role string, org_id string, writable array<string>")
    got = {r["id"]: r["deny_reason"] for r in visibility.authorize_writes(e, callers).collect()}
    assert got == {1: None, 2: "scope:user", 3: "scope:global", 4: None, 5: None, 6: "scope:org"}


def test_entities_end_and_return(spark):
    nodes = spark.createDataFrame([("a", "Agent", "committed"), ("b", "Agent", "ended"), ("c", "Metric", "committed")], "key string, type string, status string")
    targets = spark.createDataFrame([("a", "present", 1), ("a", "absent", 2), ("b", "present", 3), ("c", "absent", 1)], "key string, presence string, at int")
    assert {r["key"]: r["status"] for r in graph.end_entities(nodes, targets).collect()} == {"a": "ended", "b": "committed", "c": "committed"}


def test_resolve_alias(spark):
    e = spark.createDataFrame([("b", ["c"]), ("c", ["d"]), ("a", []), ("d", ["e"])], "key string, aliases array<string>")
    assert {r["key"]: r["canonical"] for r in graph.resolve_alias(e).collect()} == {"a": "a", "b": "b", "c": "b", "d": "b", "e": "b"}


def test_invalidate_contradictions(spark):
    edges = spark.createDataFrame([("1", "s", "T", "x", "billing service runs daily", at(0), None), ("2", "s", "T", "y", "billing service no longer runs daily", at(5), None), ("3", "s", "T", "z", "something else", at(1), None)], "edge_id string, src_id string, type string, dst_id string, fact string, valid_at timestamp, invalid_at timestamp")
    got = {r["edge_id"]: r["invalid_at"] for r in graph.invalidate_contradictions(edges).collect()}
    assert got == {"1": at(5), "2": None, "3": None}


def test_endorse_publish_depart(spark):
    nodes = spark.createDataFrame([("n", ["a", "b"]), ("m", None)], "node_id string, endorsed_by array<string>")
    requests = spark.createDataFrame([("n", "b", "withdraw", 1), ("n", "c", "endorse", 1), ("m", "x", "endorse", 1), ("m", "x", "withdraw", 2)], "node_id string, user_id string, op string, at int")
    assert {r["node_id"]: r["endorsed_by"] for r in governance.endorse(nodes, requests).collect()} == {"n": ["a", "c"], "m": []}
    schema = "type string, key string, name string, summary string, user_id string"
    mine = spark.createDataFrame([("F", "k1", "same", "", "u"), ("F", "k2", "mine", "", "u"), ("F", "k3", "new", "", "u"), ("F", "k4", "a@b.org", "", "u")], schema)
    ours = spark.createDataFrame([("F", "k1", "same", "", "o"), ("F", "k2", "theirs", "", "o")], schema)
    assert {r["key"]: (r["outcome"], r["shared_key"]) for r in governance.publish(mine, ours).collect()} == {"k1": ("merged", "k1"), "k2": ("contested", "k2~u"), "k3": ("published", "k3"), "k4": ("refused", None)}
    t = spark.createDataFrame([("user", "u"), ("org", "o")], "scope string, scope_id string")
    kept, certificate = governance.depart({"nodes": t}, "u")
    assert kept["nodes"].count() == 1 and '"removed":1' in certificate.first()["counts"]


def test_dim_changes(spark):
    dim = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    changes = spark.createDataFrame([("a", "z", at(1)), ("a", "w", at(2)), ("b", None, at(1)), ("c", "n", at(1))], "k string, v string, at timestamp")
    assert {r["k"]: (r["v"], r["version"]) for r in governance.apply_dim_changes(dim, changes, ["k"], "v").collect()} == {"a": ("w", 3), "c": ("n", 1)}


def test_claims_and_presence(spark):
    rows = [("1", "state", "infra/state/cost-daily", "2026-09-15", "$398.08  MTD"), ("2", "preference", "person/{me}/pref/infra", "cost_format", "table"), ("3", "learning", "t", "k", "use the cache"), ("4", "deviation", "t", "k", "x"), ("5", "learning", "t", "k", "too short")]
    e = spark.createDataFrame([(i, at(0), "sai", k, t, y, v, None) for i, k, t, y, v in rows], "event_id string, occurred_at timestamp, user_id string, kind string, topic string, key string, value string, evidence_ids array<string>")
    got = {r["event_id"]: (r["anchor"], r["value"], r["confidence"]) for r in extract.extract_claims(e).collect()}
    assert got == {"1": ("state:infra/state/cost-daily:2026-09-15", "$398.08 MTD", None), "2": ("pref:person/sai/pref/infra:cost_format", "table", None), "3": ("use-the-cache", "use the cache", 0.4)}
    claims = spark.createDataFrame([("x/watch/y", "Ready."), ("plain", "ready"), ("plain", "gone since noon")], "topic string, value string")
    assert sorted((r["topic"], r["presence"]) for r in extract.presence_targets(claims).collect()) == [("plain", "absent"), ("x/watch/y", "present")]


FACTS = "topic string, fact string, date string, op string, qty double, unit string"


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("t", "a", "1", "add", 25.0, "usd"), ("t", "b", "2", "add", 40.0, "usd"), ("t", "c", "3", "add", 120.0, "usd")], ("usd", 185.0, 3)),
        ([("t", "a", "1", "add", 5.0, "x"), ("t", "s", "1", "set", 25.0, "x"), ("t", "b", "2", "add", 1.0, "x")], ("x", 26.0, 2)),
        ([("t", "a", "1", "add", 5.0, "x"), ("t", "a", "1", "add", 5.0, "x"), ("t", "b", "2", "remove", 9.0, "x")], ("x", 0.0, 2)),
    ],
)
def test_fold_topics(spark, rows, want):
    r = extract.fold_topics(spark.createDataFrame(rows, FACTS)).first()
    assert (r["unit"], r["total"], r["n"]) == want


def test_turns_insights_and_embedding(spark):
    docs = spark.createDataFrame([(1, "intro\nuser: hi there\nmore\nassistant: you must always restart it first. Fine.")], "doc_id int, text string")
    assert [(r["speaker"], r["body"].count("\n")) for r in extract.split_turns(docs).orderBy("turn").collect()] == [(None, 0), ("user", 1), ("assistant", 0)]
    assert [r["kind"] for r in extract.session_insights(docs).collect()] == ["convention"]
    asked = spark.createDataFrame([("What did you recommend?",), ("Where do I live?",), (None,)], "q string")
    assert [r[0] for r in asked.select(extract.question_speaker(F.col("q"))).collect()] == ["assistant", "user", "user"]
    v = extract.hash_embed(spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string"), 16).orderBy("id").collect()
    assert sum(x * x for x in v[0]["embedding"]) == pytest.approx(1) and not any(v[1]["embedding"])
    facts = spark.createDataFrame([(1, "hi   there more"), (1, "not in it at all")], "doc_id int, span string")
    assert extract.grounded(facts, docs).count() == 1


def test_packet_and_citations(spark):
    facts = spark.createDataFrame([(1, 1, "n1", "fact one"), (1, 2, "n2", "fact two")], "query_id int, rank int, node_id string, fact string")
    passages = spark.createDataFrame([(1, 1, 7, "word " * 100)], "query_id int, rank int, doc_id int, content string")
    p = compose.packet(facts, passages)
    body = p.first()["body"].split("\n")
    assert body[:3] == ["## Facts", "- fact one", "- fact two"] and body[4].endswith("…")
    answers = spark.createDataFrame([(1, "yes [n1] and [n9]")], "query_id int, answer string")
    r = compose.enforce_citations(answers, p).first()
    assert r["answer"] == "yes [n1] and " and r["n_false"] == 1


def test_notes(spark):
    body = "lost\n## Summary\nall well\n## Odd\nx\n## Summary\nagain"
    got = {(r["section"], r["error"]) for r in compose.parse_sections(spark.createDataFrame([("n", body)], "note_id string, body string")).collect()}
    assert got == {(None, "text_before_heading"), ("summary", None), ("odd", "unknown_section"), ("summary", "repeated_section")}
    notes = spark.createDataFrame([("n", "see [edge:e1] [edge:e2] [edge:e3]")], "note_id string, body string")
    edges = spark.createDataFrame([("e1", None), ("e2", at(1))], "edge_id string, invalid_at timestamp")
    assert sorted(r["edge_id"] for r in compose.stale_citations(notes, edges).collect()) == ["e2", "e3"]


def test_producers(spark):
    store = spark.createDataFrame([("user.1.project.2", "k", ("MESSAGE", ("hi", None)), at(0))], "prefix string, key string, value struct<type:string,data:struct<content:string,trace_type:string>>, updated_at timestamp")
    r = producers.from_conversation_store(store).first()
    assert r["subject"] == {"user": "1", "project": "2"} and r["action_type"] == "chat.message" and r["content"] == "hi"
    with pytest.raises(ValueError, match="target_user_id"):
        producers.from_audit_log(store)
    agents = spark.createDataFrame([(1, 9, "running", at(2), at(1), "u", None), (2, 9, "stopped", None, at(1), "u", None), (3, 9, "running", at(2), at(1), None, None)], "id int, project_id int, deployment_status string, deployed_at timestamp, created_at timestamp, author_user_id string, org_id string")
    projects = spark.createDataFrame([(9, "p")], "project_id int, project string")
    assert sorted(r["event_id"] for r in producers.from_agents(agents, projects).collect()) == ["agent:1:created", "agent:1:deployed", "agent:2:created"]
    listing = spark.createDataFrame([("r", f"a{i}.py") for i in range(3)] + [("r", "b.go"), ("r", "README.md")], "repo string, path string")
    assert producers.repo_cards(listing).first()["languages"] == "py, go"


def test_files(spark, tmp_path):
    (tmp_path / "ws").mkdir()
    (tmp_path / "ws" / "some-note.md").write_text("# hello")
    (tmp_path / "ws" / "data.bin").write_bytes(b"x")
    root = str(tmp_path)
    assert [(r["workspace"], r["text"]) for r in producers.markdown_documents(spark, root).collect()] == [("ws", "# hello")]
    known = spark.createDataFrame([], "ref string")
    found = producers.catalogue_files(spark, root, known)
    assert [r["title"] for r in found.collect()] == ["some note"]
    assert producers.catalogue_files(spark, root, found).count() == 0


def test_lift_and_registry(spark):
    nodes = spark.createDataFrame([("u", "learned x", "corroborated", None), ("v", "learned x", "corroborated", None), ("u", "mail a@b.org", "endorsed", None), ("u", "weak", "probation", None)], "unit_id string, name string, tier string, lifted boolean")
    units = spark.createDataFrame([("u", "top"), ("v", "top"), ("top", None)], "unit_id string, parent_id string")
    assert [(r["unit_id"], r["name"], r["observed_count"]) for r in graph.lift(nodes, units).collect()] == [("top", "learned x", 2)]
    regs = spark.createDataFrame([("o", "h", "1", "me", None, "c1", 1, "a"), ("o", "h", None, None, "auto", "c2", 2, "b")], "org_id string, name string, version string, owner string, mode string, contract string, at int, event_id string")
    assert tuple(graph.build_registry(regs).first()) == ("o", "h", "1", "me", "auto", "c2")
