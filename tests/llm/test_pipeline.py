"""Every stage of the pipeline against a plain version, on the smallest tables."""

import collections

import pytest

pytest.importorskip("annalist.llm")

from test_llm_ops import plain_components, plain_hits, plain_spans, shingles  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from annalist.llm.common import materialise, table

    docs = table(spark, SF, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs := materialise(stage(spark, docs, SF))))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in stages[1:]] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    assert all(df.columns == COLUMNS for _, df in stages[:-1])


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_toxicity_stage_only_removes(stages):
    before, after = dict(texts(stages[0][1])), dict(texts(stages[1][1]))
    assert after.items() <= before.items() and len(after) > 0.7 * len(before)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1][1]), texts(stages[2][1])
    want = {c for d, n, c in plain_components(before) if n} | {d for d, t in before if not shingles(t)}
    assert sorted(d for d, _ in after) == sorted(want)


def test_contaminated_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in plain_hits(texts(stages[2][1]), items) if not r[-1]}
    assert sorted(d for d, _ in texts(stages[3][1])) == sorted(clean)


def test_secrets_are_masked(stages):
    before, after = dict(texts(stages[3][1])), {r["doc_id"]: r for r in stages[4][1].collect()}
    assert before.keys() == after.keys()
    for d, t in before.items():
        for a, b, _ in plain_spans(t or ""):
            assert t[a:b] not in after[d]["text"]
        if not plain_spans(t or "") and after[d]["text"] != t:
            assert "[secret]" in after[d]["text"]
        assert after[d]["n_chars"] == len(after[d]["text"])


def test_every_document_is_packed(stages):
    by_doc, by_sequence = collections.defaultdict(int), collections.defaultdict(list)
    for r in stages[5][1].collect():
        by_doc[r["doc_id"]] += r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == {d for d, _ in texts(stages[4][1])}
    for own in by_sequence.values():
        own.sort()
        assert all(o == sum(n for _, n in own[:i]) for i, (o, _) in enumerate(own))


def test_run_is_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()


def odd_documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_nulls_empties_repeats_and_very_long_texts(spark):
    """What each stage does with them: nothing is lost but toxic rows, copies and contaminated rows; rows without shingles stay."""
    import corpus_pipeline
    from annalist.llm.common import materialise, table

    base = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    long = "a quiet river runs under the old stone bridge near the small green town " * 15_000
    odd = [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "one two"), (None, None), (None, "lonely words of no name at all here"), (900_005, long), (900_006, long), base[0], base[0]]
    docs = materialise(odd_documents(spark, base + odd))
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialise(stage(spark, kept, SF))
        assert kept.columns == COLUMNS, name
        seen.append([(r["doc_id"], r["text"]) for r in kept.collect()])
    for rows in seen:
        held = collections.Counter(rows)
        assert all(held[x] for x in [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "one two"), (None, None), (None, "lonely words of no name at all here")])
    assert sum(i in (900_005, 900_006) for i, _ in seen[0]) == 2 and [i for i, _ in seen[1] if i in (900_005, 900_006)] == [900_005]
    assert all(collections.Counter(x)[base[0]] <= 1 for x in seen[1:])
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(i for i, _ in seen[-1])
    assert all(0 < r["length"] <= 2048 for r in packed)


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline
    from annalist.llm.common import materialise

    docs = odd_documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        assert docs.count() == 0
