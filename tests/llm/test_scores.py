"""Scores computed the long way: discriminant densities, log ratios of hashed features, the corrected risk, planted secrets."""

import math
import re
import struct

import numpy as np
import pytest

pytest.importorskip("annalist.llm")

from annalist.llm import discriminant, quality_rules, secrets, toxicity  # noqa: E402

WORDS = "the of and river stone light under over small great water house green field morning evening paper north south open".split()


def sentence(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in draw.integers(0, len(WORDS), n))


def test_discriminant_is_the_ratio_of_two_normal_densities():
    draw = np.random.default_rng(0)
    good = np.arange(300) < 120
    x = draw.normal(size=(300, 4)) @ draw.normal(size=(4, 4)) + np.where(good[:, None], 0.7, 0.0)
    model = discriminant.fit(x, good, pooling=0.25, ridge=0.05)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    cov = {k: np.cov(z[good == k], rowvar=False, bias=True) for k in (False, True)}
    pooled = sum((good == k).sum() * c for k, c in cov.items()) / len(z)
    logs = []
    for k, c in cov.items():
        s = 0.75 * c + 0.25 * pooled
        s = 0.95 * s + 0.05 * np.trace(s) / 4 * np.eye(4)
        off = z - z[good == k].mean(axis=0)
        logs.append(math.log((good == k).mean()) - 0.5 * math.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def spark_hash(*values) -> int:
    from xxhash import xxh64_intdigest

    seed = 42
    for v in values:
        if v is not None:
            seed = xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_log_ratio_of_hashed_features(spark):
    buckets, prior = 64, quality_rules.PRIOR
    table = [(i, sentence(i, 30) + (" !!" if i % 3 else " ...")) for i in range(60)] + [(90, None), (91, ""), (92, "Größe ² x"), (3, sentence(3, 30))]
    trusted = set(range(20))
    features = {}
    for i, t in table:
        h = [spark_hash(w) for w in re.findall(r"[^\W_]+|[^\w\s]+", t or "")]
        features.setdefault(i, []).append([(a & (buckets - 1), spark_hash(a, b) & (buckets - 1)) for a, b in zip(h, [*h[1:], None], strict=False)])
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for i, texts in features.items():
        for pair in (p for t in texts for p in t):
            for b in pair:
                raw[b] += 1
                target[b] += i in trusted
    share = raw / raw.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(raw > 0, np.log((target + prior * share) / (target.sum() + prior) / share), 0.0)
    want = sorted((i, round(sum(weight[b] for p in t for b in p) / max(1, 2 * len(t)), 6)) for i, texts in features.items() for t in texts)
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = quality_rules.quality_rules(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), buckets)
    assert sorted((r["doc_id"], round(r["log_ratio"], 6)) for r in got.collect()) == want
    assert all(r["kept"] == (not r["base_failed"] and r["log_ratio"] >= quality_rules.THRESHOLD) for r in got.collect())


def test_learning_with_unlabelled_rows_tells_the_classes_apart():
    """Unlabelled rows hold positives as well; with their share of these known they do no harm."""
    draw = np.random.default_rng(4)
    truth = np.arange(2000) < 600
    x = draw.normal(size=(2000, 6)) + np.where(truth[:, None], 1.2, 0.0)
    known = truth & (np.arange(2000) % 3 == 0)
    w, b = toxicity.fit_nnpu(x, known, float(truth[~known].mean()))
    called = x @ w + b > 0
    assert (called == truth).mean() > 0.9 and 0.2 < called.mean() < 0.4


@pytest.fixture(scope="module")
def models(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


ALPHABETS = {
    "hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "letters": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "base62": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
}


@pytest.mark.parametrize("alphabet", sorted(ALPHABETS))
def test_planted_secrets_are_found(models, alphabet):
    draw = np.random.default_rng(6)
    found = 0
    for i in range(200):
        token = "".join(draw.choice(list(ALPHABETS[alphabet]), 24 + i % 24))
        text = f"{sentence(i, 10)} {token} {sentence(i + 1, 10)}"
        _, spans = secrets.all_spans(text, models)
        found += any(text[s:e].strip("=") in token and e - s > 20 for s, e, _ in spans)
    assert found >= 0.9 * 200


def test_ordinary_identifiers_are_left_alone(models):
    draw = np.random.default_rng(7)
    alarms = 0
    for i in range(400):
        parts = [WORDS[k] for k in draw.integers(0, len(WORDS), 5)]
        token = [str.join("_", parts), str.join("-", parts), parts[0] + "".join(p.title() for p in parts[1:]), str.join("/", parts)][i % 4]
        _, spans = secrets.all_spans(f"{sentence(i, 5)} {token} {sentence(i + 1, 5)}", models)
        alarms += bool(spans)
    assert alarms <= 0.01 * 400
