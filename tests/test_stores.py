import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evaluation, retrieval, texts
from tallyspark.sources import sinks


def test_replacing_a_folder_and_recovering_it(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace_folder(spark.range(3), path)
    sinks.replace_folder(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["t"]
    os.rename(path, f"{path}.old-1")  # a job that died between its two renames
    sinks.upsert(spark.createDataFrame([(1, "a")], "id long, note string"), path, ["id"])
    got = {(r["id"], r["note"]) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "a"), (2, None)}
    assert not sinks.recovered(spark, f"{tmp_path}/never")


def test_reports_refuse_unknown_kinds(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown kind"):
        sinks.file_report(spark.range(1), f"{tmp_path}/x", ["id"], "pdf")


def test_progress(spark):
    rows = spark.createDataFrame([(0, 0), (1, 4), (4, 4), (9, 4), (None, 3)], "a int, b int").select(sinks.progress(F.col("a"), F.col("b"), 4).alias("p")).collect()
    assert [r["p"] for r in rows] == ["[....] 0.0%", "[#...] 25.0%", "[####] 100.0%", "[####] 100.0%", "[....] 0.0%"]


def test_passages_are_found_as_stretches_of_characters(spark):
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "xone two three four fivey"), (3, "one two  three four five"), (4, None), (5, "a b"), (6, "one two three four")], "doc_id int, text string")
    passages = spark.createDataFrame([(1, "one two three four five"), (2, "a b"), (3, None), (4, "e two three four f"), (5, "b")], "qid int, passage string")
    assert {tuple(r) for r in texts.holding(docs, passages).collect()} == {(1, 1), (1, 2), (2, 5), (4, 1), (4, 2), (5, 5)}


@pytest.mark.parametrize("block", [3, 1000])
def test_dense_equals_all_pairs(spark, block):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(40, 3)), 1)
    x[10:20] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(50, None), (51, [1.0])]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    got = {}
    for r in retrieval.dense(v, q, 4, block_rows=block).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["vec_id"], r["score"]))
    for i in (0, 10, 20, 30):
        s = sorted((-max(0.0, round(float(x[i] @ x[j]), 6)), j) for j in range(40) if j != i)[:4]
        assert [j for j, _ in got[i]] == [j for _, j in s] and all(abs(a + b) < 1e-9 for (_, a), (b, _) in zip(got[i], s))
    assert set(got) == {0, 10, 20, 30}


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(400)] + [(999, None)], "k int, v double")
    row = evaluation.bootstrap_interval(df, "v", "k", rounds=500).first()
    assert 0.43 < row["low"] < 0.5 < row["high"] < 0.57
    empty = evaluation.bootstrap_interval(df.limit(0), "v", "k").first()
    assert empty["low"] is None and empty["high"] is None


def test_bm25_takes_a_given_tokeniser_and_counts_all_texts(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, ""), (3, None), (4, "plum")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "apple apple plum")], "qid int, question string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(docs, asked, 5).collect()}
    assert set(got) == {1, 4}
    letters = lambda c: F.split(F.coalesce(c, F.lit("")), "")
    assert {r["doc_id"] for r in retrieval.bm25(docs, asked, 5, tokeniser=letters).collect()} == {1, 4}
    assert retrieval.bm25(docs.limit(0), asked, 5).count() == 0
