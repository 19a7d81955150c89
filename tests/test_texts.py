"""Passages, insights and messages of all texts against plain versions, for the queries that have no SQL."""

import re

import pytest

from annalist.operators.extract import INSIGHT_MARKERS
from annalist.plans import queries
from annalist.plans.everything import QUERIES
from annalist.plans.queries import load

SF = "/root/testdata/sf0.001"


def strip(t):
    return re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", t)


def plain_paragraphs(content, size, cut):
    done, held = [], ""
    for p in (strip(x) for x in (content or "").split("\n\n")):
        if not p:
            continue
        if len(p) > size:
            done += ([held] if held else []) + cut(p, size)
            held = ""
        elif held and len(held) + len(p) + 2 > size:
            done.append(held)
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return done + ([held] if held else [])


def fixed(p, size):
    return [p[i : i + size] for i in range(0, len(p), size)]


def by_lines(p, size):
    done, held = [], []
    for line in (x for x in p.split("\n") if x.strip(" ")):
        used = sum(len(x) + 1 for x in held)
        if len(line) > size:
            done += (["\n".join(held)] if held else []) + fixed(line, size)
            held = []
        elif held and used + len(line) + 1 > size:
            done.append("\n".join(held))
            held = [x for x in held[-1:] if len(x) + len(line) + 1 <= size] + [line]
        else:
            held.append(line)
    return done + (["\n".join(held)] if held else [])


@pytest.mark.parametrize(("name", "size", "cut", "shape"), [("X1_chunks_paragraphs", 1000, fixed, lambda t: t.replace("\n", "\n\n")), ("X2_chunks_lines", 400, by_lines, lambda t: t)])
def test_passages_of_all_documents(spark, name, size, cut, shape):
    want = {(r["doc_id"], i, c) for r in load(spark, SF, "documents").select("doc_id", "text").collect() for i, c in enumerate(plain_paragraphs(shape(r["text"] or ""), size, cut))}
    assert {(r["doc_id"], r["ordinal"], r["content"]) for r in QUERIES[name](spark, SF).collect()} == want


def test_insights_of_all_documents(spark):
    got = QUERIES["X22_session_insights"](spark, SF).collect()
    assert got
    for *_, kind, name in map(tuple, got):
        words = re.split(r"\s+", name.lower())
        found = [INSIGHT_MARKERS[m] for m in INSIGHT_MARKERS if m in words]
        assert len(name) <= 120 and (found[:1] == [kind] or len(name) == 120)


def test_messages_of_all_conversations(spark):
    roles = {"user", "human", "assistant", "ai", "bot", "system"}
    told = {r["doc_id"]: r["text"] for r in queries.transcripts(spark, SF).collect()}
    got = QUERIES["X29_messages"](spark, SF).collect()
    per = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["message"])):
        per.setdefault(r["doc_id"], []).append(r)
    assert per.keys() == told.keys()
    for doc, messages in per.items():
        opened = [x for x in told[doc].split("\n") if x.split(":", 1)[0].strip().lower() in roles and ":" in x]
        assert len(messages) >= len([x for x in opened if not x.lower().startswith("system")])
        assert all(m["role"] in ("user", "assistant", "system") for m in messages)
