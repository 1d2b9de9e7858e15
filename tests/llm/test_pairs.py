import math

import numpy as np
import pytest
import xxhash

from tallyspark.llm import bitslice, simhash, vector_join
from tallyspark.llm.shared import components
from pyspark.sql import functions as F


def closure(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = np.random.default_rng(1)
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(7, i) for i in range(2000, 2300)]
    other = [tuple(map(int, x)) for x in rng.integers(0, 400, (250, 2))]
    edges = path + star + other + [(1, 1), (None, 3), (1030, 1000)]
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = closure({x for e in real for x in e}, real)
    assert got == want


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    hot = base[0] + 0.02 * rng.normal(size=(120, 16))
    chain = [np.cos(a) * np.eye(16)[0] + np.sin(a) * np.eye(16)[1] for a in np.linspace(0, 2.5, 12)]
    near = base[:40] + 0.05 * rng.normal(size=(40, 16))
    x = np.concatenate([base, hot, chain, near, base[3:5], base[3:4] * 7]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [1.0] * 15 + [None]), (n + 5, [float("inf")] + [1.0] * 15), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_near_vectors_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, m string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_join.near_vectors(df, 0.95, block_rows=block).collect()}
    fit = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in fit]
    links = [(i, j) for i, a in unit for j, b in unit if i != j and len(a) == len(b) and a @ b >= 0.95]
    low = closure([i for i, _ in rows if i is not None], links)
    for i, _ in rows:
        if i is not None:
            assert got[i] == (sum(a == i for a, _ in links), low[i], low[i] == i)
    assert got[None] == (0, None, False) and len(got) == len(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_join.near_vectors(df).count() == 0
    df = spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_join.near_vectors(df).collect()] == [(4, 0, 4, True)]
    assert bitslice.top_k(df, F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize("rows_each", [64, 16_384])
def test_top_k_equals_brute_force(spark, rows_each):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 6)), 1).astype(np.float32)
    x[50:80] = x[0]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)] + [(400, None), (401, [float("nan")] * 6), (402, [1.0]), (403, [2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in bitslice.top_k(df, F.col("vec_id") % 50 == 0, k=5, segment_rows=rows_each).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    q = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i is not None and v and all(map(math.isfinite, v))}
    for i in q:
        if i % 50 == 0:
            s = sorted((-(q[i] @ v), j) for j, v in q.items() if j != i and len(v) == len(q[i]))[:5]
            assert got[i] == [(j, -s_) for s_, j in s]


def test_scores_that_overflow_raise(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="62 bits"):
        bitslice.top_k(df, F.col("vec_id") == 0).collect()
    df = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="62 bits"):
        bitslice.top_k(df, F.col("vec_id") == 0).collect()


def plain_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"W{i}é" for i in range(300)]
    texts = []
    for _ in range(60):
        w = list(rng.choice(words, int(rng.integers(0, 120))))
        texts.append(" ".join(w))
        for _ in range(int(rng.integers(0, 6))):
            v = list(w)
            if v:
                v[int(rng.integers(len(v)))] = "new"
            texts.append("\t ".join(v))
    texts += [None, "", " \n\x0b", "a", "A", "a b c", "a\x85b c d", texts[0]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_documents(df).collect()}
    fp = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    low = closure(range(len(fp)), links)
    assert got[None][1] is None
    for i in range(len(fp)):
        assert got[i] == (f"{fp[i]:016x}", low[i])
    kept = {r["doc_id"] for r in simhash.deduplicated(df).collect()}
    assert kept == {low[i] for i in low} | {None}


def test_long_posting_lists_are_cut_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(400)} | {int(x) for x in rng.integers(0, 2**63, 200)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    reps = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = closure(range(len(fps)), links)
    for rows in (16_384, 64):
        monkeypatch.setattr(simhash, "LIST_ROWS", rows)
        edges = [(r["src"], r["dst"]) for r in simhash.posting_edges(reps).collect()]
        assert closure(range(len(fps)), edges) == want


def test_every_pair_within_four_bits_shares_a_list():
    rng = np.random.default_rng(6)
    for _ in range(500):
        a = int(rng.integers(0, 2**63))
        b = a ^ sum(1 << int(x) for x in rng.choice(64, 4, replace=False))
        keys = simhash.index_keys(np.array([a, b], np.uint64))
        assert (keys[0] == keys[1]).any()


def test_dealt_rows_go_one_way(spark, monkeypatch):
    """Vectors without clusters: a row is at home once and visits about half of the other blocks."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:1040] = x[0] + 0.01 * rng.normal(size=(40, 24))
    x[1100] = 3 * x[5]
    monkeypatch.setattr(vector_join, "STRIPE", 7)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for block in (100, 5000, None):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.near_vectors(df, 0.9, block_rows=block).collect()}
        unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        near = unit @ unit.T >= 0.9
        np.fill_diagonal(near, False)
        low = closure(range(len(x)), [(int(i), int(j)) for i, j in np.argwhere(near)])
        assert got == {i: (int(near[i].sum()), low[i]) for i in range(len(x))}


def test_the_smallest_row_of_a_repeated_id_stays(spark):
    rows = [(1, "b c d e f", 2, {"k": 1}), (1, "a c d e f", 9, None), (1, "a c d e f", 3, {"k": 2}), (2, "z y x w", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, m map<string,int>")
    for part in (df, df.orderBy("n"), df.orderBy("text", "n")):
        assert sorted((r["doc_id"], r["text"], r["n"]) for r in simhash.deduplicated(part).collect()) == [(1, "a c d e f", 3), (2, "z y x w", 1)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tallyspark.llm.shared import shared_folder

    conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://h:7077"))
    assert shared_folder(session) == "hdfs://x/y"
    conf.clear()
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://h"):
        session.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session)
    session.sparkContext.master = "local[4]"
    assert shared_folder(session)


def test_components_with_hubs(spark, monkeypatch):
    from tallyspark.llm import shared

    monkeypatch.setattr(shared, "HUB_EDGES", 3)
    rng = np.random.default_rng(11)
    edges = [(0, i) for i in range(1, 80)] + [(500, i) for i in range(60, 130)] + [(i, 9000) for i in range(2000, 2040)] + [tuple(map(int, x)) for x in rng.integers(3000, 3200, (150, 2))]
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == closure({x for e in edges for x in e if e[0] != e[1]}, edges)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_documents(none).count() == 0 and simhash.deduplicated(none).count() == 0
    assert simhash.deduplicated(none, shingle_words=5, similarity=0.8).count() == 0


def test_few_edges_take_few_jobs_and_end_as_the_rounds_do(spark, monkeypatch):
    from tallyspark.llm import shared

    monkeypatch.setattr(shared, "HUB_EDGES", 3)
    rng = np.random.default_rng(12)
    edges = [(i, i + 1) for i in range(-5, 40)] + [(900 - i, 901 - i) for i in range(30)] + [(0, i) for i in range(60, 130)] + [tuple(map(int, x)) for x in rng.integers(3000, 3200, (150, 2))] + [(1, 1), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    context = spark.sparkContext
    context.setJobGroup("few edges", "")
    few = dict(map(tuple, components(df).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup("few edges"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert few == dict(map(tuple, components(df, few_edges=0).collect())) and jobs <= 8
    assert few == closure({x for e in edges for x in e if None not in e and e[0] != e[1]}, [e for e in edges if None not in e])
    assert components(df.where("src = dst")).count() == 0
