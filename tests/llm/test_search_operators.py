"""SimHash near copies, hard negatives and spelling variants against plain versions, with nulls, empties, ties, repeats and clashing columns."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("annalist.llm")

from annalist.llm import hard_negatives, simhash, spelling  # noqa: E402
from annalist.llm.common import materialise  # noqa: E402

WORDS = "the of and river stone light under over small great water house green field morning evening paper north south open".split()
EXTRA = ", f long, least long, root string, kept int, content long, word string, n long, run string, range string"
CLASH = (1, 2, "x", 3, 4, "y", 5, "z", "w")


def sentence(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in draw.integers(0, len(WORDS), n))


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(i, sentence(i % 40, 60 + i % 7)) for i in range(120)]
    texts += [(200, None), (201, ""), (202, " \n\t"), (203, "One\x0btwo"), (204, "one TWO"), (205, "one two"), (None, sentence(3, 63)), (None, None), (3, sentence(3, 63)), (3, sentence(3, 63))]
    texts += [(300 + i, sentence(7, 400)[i:] + " tail") for i in range(20)] + [(400, "größe " * 30_000 + "x"), (401, "größe " * 30_000 + "y")]
    return materialise(spark.createDataFrame([(*t, *CLASH) for t in texts], "doc_id long, text string" + EXTRA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string" + EXTRA)


def plain_fingerprint(text) -> int:
    from xxhash import xxh64_intdigest

    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_copies(texts: list[tuple]) -> list[tuple]:
    prints = [plain_fingerprint(t) for _, t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, k in itertools.combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[k]).bit_count() <= 4:
            up[root(k)] = root(i)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((texts[i][0], f"{prints[i]:016x}", least.get(root(i))) for i in range(len(texts))), key=repr)


@pytest.mark.parametrize(("large", "hot"), [(simhash.LARGE, simhash.HOT), (2, 512), (2, 0), (simhash.LARGE, 0)])
def test_simhash(docs, large, hot, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLED", 2)
    want = plain_copies([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = simhash.near_copies(docs, large, hot)
    assert rows(got.select("doc_id", "component_id")) == sorted(((i, c) for i, _, c in want), key=repr)
    assert rows(simhash.near_copies_digest(docs)) == want


def test_simhash_of_nothing(empty, spark):
    assert simhash.near_copies_digest(empty).count() == 0
    blank = spark.createDataFrame([(5, None), (4, " ")], "doc_id int, text string")
    assert rows(simhash.near_copies_digest(blank)) == [(4, "0" * 16, 4), (5, "0" * 16, 4)]


def test_simhash_links_dense_balls_and_chains(spark):
    """Fingerprints themselves: chains with steps of up to four bits, and a ball whose every signature is crowded."""
    draw = np.random.default_rng(5)
    values = {int(x) for x in draw.integers(0, 1 << 63, 200)}
    for start in list(values)[:10]:
        x = start
        for _ in range(12):
            for b in draw.choice(64, 4, replace=False):
                x ^= 1 << int(b)
            values.add(x)
    values |= {(1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 64, (400, 2))}
    values = sorted(values)
    nodes = materialise(spark.createDataFrame([(simhash.signed(v),) for v in values], "f long"))
    up = {v: v for v in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            up[root(b)] = root(a)
    want = collections.Counter(collections.Counter(root(v) for v in values).values())
    for large in (simhash.LARGE, 8):
        links = simhash.links_between(nodes, large)
        assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links.collect())
        sizes = simhash.connected_components(links).groupBy("root").count().collect()
        got = collections.Counter(r["count"] for r in sizes)
        assert got == collections.Counter({k: n for k, n in want.items() if k > 1})


def test_pigeonring_keeps_every_near_pair():
    draw = np.random.default_rng(1)
    for n in range(5):
        x = np.zeros(3000, np.uint64)
        for i in range(3000):
            for b in draw.choice(64, n, replace=False):
                x[i] |= np.uint64(1) << np.uint64(b)
        for chain in range(1, 9):
            assert simhash.within_budgets(x, chain).all()
        assert all(any(not int(v) & (m % (1 << 64)) for m in simhash.MASKS) for v in x)
    far = draw.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert simhash.within_budgets(far, simhash.CHAIN).mean() < 0.01
    exact = np.bitwise_count(far) <= 4
    assert (simhash.within_budgets(far, 8) == exact).all()


EMBEDDINGS = "vec_id long, embedding array<float>, label int, bucket int, row long, anchor long, score long"


def plain_negatives(table: list[tuple]) -> list[tuple]:
    kept = []
    for vec_id, v, label in table:
        if label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, [int(np.floor(256 * float(c))) for c in v], label))
    out = []
    for i, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, b, strict=False)), other is None, other, lab) for k, (other, b, lab) in enumerate(kept) if other != anchor)
        for s, _, positive, _ in [x for x in scored if x[3] == label][:5]:
            fit = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(anchor, positive, n, x[2], -s, -x[0]) for n, x in enumerate(fit[:3], 1)]
    return sorted(out, key=repr)


def vectors(seed: int, n: int, dim: int = 16) -> list[tuple]:
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(3, dim))
    return [(i, (centre[i % 3] + draw.normal(size=dim)).astype(np.float32).tolist(), int(draw.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_hard_negatives(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    table = vectors(seed, 400)
    same = table[50][1]
    table += [(1000 + i, same, i % 3) for i in range(40)]  # ties
    table += [(2000, None, 1), (2001, same, None), (2002, [1.0, None] + same[2:], 1), (2003, [float("nan")] + same[1:], 1), (2004, [float("inf")] + same[1:], 1)]
    table += [(2005, [], 1), (2006, same[:5], 2), (2007, same + [1.0, 2.0], 0), (None, same, 0), (None, same, 1), (2050, [0.0] * 16, 1)]
    df = materialise(spark.createDataFrame([(*t, 1, 2, 3, 4) for t in table], EMBEDDINGS))
    assert rows(hard_negatives.mine(df)) == plain_negatives(table)


def test_hard_negatives_of_large_components_and_of_nothing(spark):
    """Scores beyond what doubles hold exactly are whole numbers all the same."""
    table = [(i, [float((i * 37 + k * 11) % 19) * 2.0**14 + 1 / 256 for k in range(6)], i % 2) for i in range(0, 300, 5)]
    df = spark.createDataFrame([(i, [float(x) for x in v], lab) for i, v, lab in table], "vec_id long, embedding array<double>, label int")
    assert rows(hard_negatives.mine(df)) == plain_negatives(table)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], "vec_id int, embedding array<float>, label int")
    assert hard_negatives.mine(lone).count() == 0


def test_segment_summaries_bound_every_score():
    draw = np.random.default_rng(2)
    a, b = (hard_negatives.Vectors(np.arange(40), np.zeros(40, int), draw.integers(-500, 500, (40, 19))) for _ in range(2))
    scores = a.values @ b.values.T
    width = []
    for level in range(len(hard_negatives.SEGMENTS)):
        low, high = hard_negatives.bounds(a, b, level)
        assert (low <= scores).all() and (scores <= high).all()
        width.append((high - low).mean())
    assert width == sorted(width, reverse=True)


def test_equal_rows_of_anchors(spark):
    """A row that stands twice is two rows: neither is the other's partner, and each is asked for."""
    table = [(50, [1.0, 0.2], 1), (50, [1.0, 0.2], 1), (51, [1.0, 0.1], 1), (52, [0.8, 0.1], 2)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    assert rows(hard_negatives.mine(df)) == plain_negatives(table)


def plain_variants(texts: list[tuple], least: int = 5) -> list[tuple]:
    count: collections.Counter = collections.Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in found.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(found[w]), n[form[w]] if w in form else None) for w in n), key=repr)


def misspelt() -> list[tuple]:
    base = {"government": 700, "goverment": 130, "governmant": 30, "governmment": 6, "govrnmant": 5, "ärztliche": 40, "arztliche": 7, "ärztlich": 8, "rather": 90, "father": 90, "gather": 18, "lather": 6, "rathers": 5, "aaaaaa": 60, "aaaaaaa": 10, "aaaaaaaa": 5, "straÿe": 5, "stra×e": 50}
    words = [w for w, k in base.items() for _ in range(k)]
    np.random.default_rng(0).shuffle(words)
    texts = [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(-(-len(words) // 20))]
    return texts + [(900, None), (901, ""), (None, "Government GOVERNMENT government, father"), (902, "short 12345 !!"), (5, texts[5][1]), (5, texts[5][1]), (903, "Father " * 50_000)]


def test_spelling_variants(spark, empty):
    table = misspelt()
    df = materialise(spark.createDataFrame([(*t, *CLASH) for t in table], "doc_id long, text string" + EXTRA))
    got = rows(spelling.spelling_variants(df))
    assert got == plain_variants(table)
    roots = {r[0]: r[2] for r in got}
    assert roots["govrnmant"] == "government" and roots["arztliche"] == "ärztliche" and roots["father"] == "father"
    assert spelling.spelling_variants(empty).count() == 0
    plan = spelling.near_words(spark.createDataFrame([("a", 1)], "word string, n long"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_spelling_of_random_words(spark):
    draw = np.random.default_rng(3)
    words = {"".join("abé"[i] for i in draw.integers(0, 3, n)) for n in draw.integers(6, 9, 300)}
    table = [(i, (w + " ") * int(draw.choice([5, 6, 30, 200]))) for i, w in enumerate(sorted(words))]
    df = spark.createDataFrame(table, "doc_id int, text string")
    assert rows(spelling.spelling_variants(df)) == plain_variants(table)
