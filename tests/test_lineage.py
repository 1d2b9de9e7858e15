from tallyspark.operators.lineage import numbered


def test_numbered(spark):
    d = spark.range(0, 1000, 1, 7).selectExpr("id * 7919 % 1000 as k", "id % 3 as g")
    got = numbered(d, ["k"], "place").collect()
    assert len(got) == 1000 and all(r["place"] == r["k"] for r in got)
    ties = sorted(r["place"] for r in numbered(d, ["g"], "place").collect())
    assert ties == list(range(1000))
    assert numbered(d.where("k < 0"), ["k"], "place").collect() == []
    empty = spark.createDataFrame([(None,), (1,), (None,)], "k int")
    assert sorted((r["place"], r["k"]) for r in numbered(empty, ["k"], "place").collect()) == [(0, None), (1, None), (2, 1)]
