import math

import numpy as np
import pytest

from tallyspark.llm import simhash, wide_simhash
from tallyspark.llm.simhash import deduplicated, shingle_hashes
from tallyspark.llm.wide_simhash import bit_counts, index_keys, similar_documents, tree_links, wide_fingerprint


def closure(nodes, links):
    low = {n: n for n in nodes}

    def root(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def corpus():
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    rows = []
    for n in (6, 12, 40, 150, 400):
        for _ in range(6):
            text = words(n)
            rows.append(text)
            for share in (0.02, 0.04, 0.08, 0.3):  # a changed word takes five shingles
                changed = list(text)
                for k in rng.choice(n, max(1, int(share * n / 5 * 2)), replace=False):
                    changed[k] = f"new{k}"
                rows.append(changed)
            rows.append(text + words(max(1, n // 12)))
    base = words(200)
    for k in range(120):  # a group whose members differ by one place each
        rows.append([*base[:k], f"hot{k}", *base[k + 1 :]])
    texts = [" ".join(r) for r in rows]
    return [*enumerate(texts), (900, None), (901, ""), (902, " \n"), (903, texts[0].upper().replace(" ", "\n")), (904, "one"), (905, "one"), (3, texts[40]), (None, texts[0])]


@pytest.mark.parametrize("longest", [16_384, 32])
def test_similar_documents_equal_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(simhash, "LIST_ROWS", longest)
    rows = corpus()
    df = spark.createDataFrame([(i, t, b"x", 1, 2) for i, t in rows], "doc_id long, text string, wide binary, rep int, _kept int")
    got = {(r["doc_id"], r["component_id"]) for r in similar_documents(df).collect()}
    sets = [(i, frozenset(shingle_hashes(t, 5).tolist())) for i, t in rows if i is not None]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a == b or len(a & b) / len(a | b) >= 0.8]
    low = closure({i for i, _ in sets}, links)
    assert got == {*low.items(), (None, None)}
    kept = deduplicated(df, shingle_words=5, similarity=0.8)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i in low if low[i] == i)
    assert kept.where("doc_id is null").count() == 1
    assert similar_documents(df.limit(0)).count() == 0


def test_adders_count_bits():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 17, 100, 1000):
        rows = rng.integers(0, 2**63, (n, 3), dtype=np.uint64)
        assert (bit_counts(rows) == np.unpackbits(rows.view(np.uint8).reshape(n, 24), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)).all()
    assert wide_fingerprint(np.array([], np.uint64)) == bytes(8 * wide_simhash.WORDS)


def test_threes_share_one_position_at_most():
    n = 8 * wide_simhash.WORDS
    assert index_keys(np.zeros((1, n), np.uint8)).shape[1] == n * len(wide_simhash.STEPS)
    gaps = [g for x, y in wide_simhash.STEPS for g in (x, y, y - x)]
    both = [g % n for x in gaps for g in (x, -x)]
    assert len(set(both)) == len(both)


def test_trees_connect_what_pairs_connect():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    values = np.concatenate([values, values ^ np.uint64(5), values[:2] ^ np.uint64(1 << 40)])
    rep = np.arange(100, 100 + len(values))
    edges = tree_links(8)(values, rep, np.array([0]), np.array([len(values)]))
    apart = np.bitwise_count(values[:, None] ^ values[None, :]).sum(axis=2, dtype=int)
    want = closure(rep.tolist(), [(int(rep[i]), int(rep[j])) for i in range(len(rep)) for j in range(i) if apart[i, j] <= 8])
    assert closure(rep.tolist(), edges) == want
    assert len(edges) < len(values)


def test_expected_bits():
    mean, deviation = wide_simhash.differing_bits(0.8, 768)
    assert math.isclose(mean, 116.3, abs_tol=0.5) and 9 < deviation < 11


def test_common_shingles_equal_intersections(monkeypatch):
    monkeypatch.setattr(wide_simhash, "MULTIPLIED", 7)
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.int64)) for n in (0, 1, 5, 30, 60, 12)]
    got = wide_simhash.common_shingles(sets, sets[2:])
    assert (got == [[len(np.intersect1d(x, y)) for y in sets[2:]] for x in sets]).all()
    assert wide_simhash.common_shingles(sets[:1], sets[:1]).tolist() == [[0]]


def test_shared_bytes_are_counted(spark):
    rng = np.random.default_rng(10)
    a = rng.integers(0, 256, (50, 8 * wide_simhash.WORDS), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.4, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    rows = [(x.view(np.int64).tolist(), y.view(np.int64).tolist(), int((x == y).sum())) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert df.where(wide_simhash.shared_bytes("a", "b") != df.n).count() == 0
    assert 3 <= wide_simhash.least_shared_bytes(0.8) < 10


@pytest.mark.parametrize("block", [512, 64])
def test_pairs_inside_a_group_of_a_common_template(spark, monkeypatch, block):
    """Thousands of texts at about 0.7 of each other, and among them pairs at 0.8 and more."""
    monkeypatch.setattr(wide_simhash, "BLOCK_ROWS", block * 8)
    monkeypatch.setattr(wide_simhash, "BLOCK_SHINGLES", block << 9)
    rng = np.random.default_rng(21)
    template = [f"t{k}" for k in range(300)]

    def member():
        text = list(template)
        for k in range(5):
            text[10 + 58 * k + int(rng.integers(0, 40))] = f"x{rng.integers(0, 1 << 40)}"
        return text

    def partner(text):
        out = list(text)
        for k in (5, 55, 113, 171, 229, 287):  # outside the members' places
            out[k] = f"y{rng.integers(0, 1 << 40)}"
        return out

    rows = [member() for _ in range(2000)]
    rows += [partner(rows[k]) for k in range(0, 2000, 20)]
    hashes = [np.unique(shingle_hashes(" ".join(r), 5)) for r in rows]
    _, column = np.unique(np.concatenate(hashes), return_inverse=True)
    sizes = np.array([len(h) for h in hashes])
    has = np.zeros((len(rows), column.max() + 1), np.float32)
    has[np.repeat(np.arange(len(rows)), sizes), column] = 1
    common = has @ has.T
    share = common / (sizes[:, None] + sizes - common)
    assert 0.65 < np.median(share[:2000, :2000]) < 0.75 and all(share[k, 2000 + n] >= 0.8 for n, k in enumerate(range(0, 2000, 20)))
    links = [(int(i), int(j)) for i, j in np.argwhere(share >= 0.8) if i < j]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    low = {r["doc_id"]: r["component_id"] for r in similar_documents(df).collect()}
    whole = closure(range(len(rows)), links)
    assert all(whole[i] == whole[c] for i, c in low.items())  # nothing is joined that has no links
    joined = sum(low[i] == low[j] for i, j in links)
    assert joined >= 0.95 * len(links), (joined, len(links))
