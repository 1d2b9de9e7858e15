import hashlib
import math
import os
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import fixity, html_text, mixing, quality

SF = "/root/testdata/sf0.1"


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.training_model(docs, labels)
    rows = docs.join(labels.where(quality.held_out()), "doc_id").select("doc_id", "quality", quality.scored(model, F.col("text")).alias("s")).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    good, bad = [r["s"] for r in rows if r["quality"] == 1], [r["s"] for r in rows if r["quality"] == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.98
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97 and sum(s < 0.3 for s in bad) / len(bad) > 0.8
    assert all(0 <= r["s"] <= 1 for r in rows)


def test_classifier_without_enough_labels(spark):
    docs = spark.createDataFrame([(i, "some text here" if i % 2 else "!!! ### $$$", "z") for i in range(40)] + [(40, None, None), (41, "", ""), (None, "x", "")], "doc_id long, text string, score string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    score = lambda m: [r["s"] for r in docs.select(quality.scored(m, F.col("text")).alias("s")).collect()]
    assert set(score(quality.fit(docs, empty))) == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert len(set(score(quality.fit(docs, one)))) == 1
    both = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 0)], "doc_id long, quality int")
    s = score(quality.fit(docs, both))
    assert s[1] > s[0] and len(s) == 43


def laid(df):
    return fixity.laid_out(df, F.floor(F.col("id") / 10), ["id"], F.coalesce("body", F.lit("")), "id")


def leaf_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, body string, hash string")
    return df, laid(df)


@pytest.mark.parametrize("n", [1, 7, 10, 95, 700])
def test_audit_finds_exactly_the_damage(spark, n):
    rows = [(i, f"body {i}" if i % 9 else None, "x") for i in range(n)]
    _, catalogue = leaf_rows(spark, rows)
    for broken in ([], [0], [n - 1], sorted({0, n // 2, n - 1}), list(range(n))):
        replica = spark.createDataFrame([(i, "bad" if i in broken and i % 2 else b, h) for i, b, h in rows if i not in broken or i % 2], "id long, body string, hash string")
        got = fixity.audit(catalogue, laid(replica)).collect()
        assert {r["record_id"]: r["status"] for r in got} == {i: "altered" if i % 2 else "missing" for i in broken}
    offsets = {r["record_id"]: (r["offset"], r["length"], r["hash"]) for r in catalogue.collect()}
    at = 0
    for i, b, _ in rows:
        at = 0 if i % 10 == 0 else at
        assert offsets[i] == (at, len(b or ""), hashlib.sha256((b or "").encode()).hexdigest())
        at += len(b or "")


def test_audit_pairs_repeated_records_and_finds_surplus(spark):
    rows = [(1, "a", ""), (1, "b", ""), (1, "b", ""), (2, "c", ""), (None, "n", "")]
    df, catalogue = leaf_rows(spark, rows)
    assert fixity.audit(catalogue, laid(df)).count() == 0
    replica = [(1, "a", ""), (1, "z", ""), (1, "b", ""), (2, "c", ""), (2, "d", ""), (9, "e", ""), (None, "n", ""), (None, "m", "")]
    got = fixity.audit(catalogue, laid(spark.createDataFrame(replica, df.schema))).collect()
    sha = lambda x: x and hashlib.sha256(x.encode()).hexdigest()
    want = {(1, sha("b"), sha("z"), "altered"), (2, "", sha("d"), "repeated"), (9, "", sha("e"), "surplus"), (None, "", sha("m"), "repeated")}
    assert {(r["record_id"], r["expected_hash"], r["found_hash"], r["status"]) for r in got} == want and len(got) == 4


def test_nodes_hash_the_ranges_of_their_children(spark):
    _, leaves = leaf_rows(spark, [(i, str(i), "") for i in range(5)])
    shifted = leaves.withColumn("offset", F.col("offset") + (F.col("ordinal") == 3).cast("long"))
    open_leaves, differ = fixity.mismatches(leaves, shifted)
    assert differ == [1, 1] and open_leaves.count() == 10


def test_only_branches_that_differ_are_descended(spark):
    _, catalogue = leaf_rows(spark, [(i, str(i), "") for i in range(3000)])
    bad, differ = fixity.mismatches(catalogue, catalogue)
    assert bad.count() == 0 and differ == [0]
    assert fixity.mismatches(catalogue.limit(0), catalogue.limit(0))[0].count() == 0
    changed = catalogue.withColumn("hash", F.when(F.col("record_id") == 1234, "x").otherwise(F.col("hash")))
    bad, differ = fixity.mismatches(catalogue, changed)
    assert differ == [1, 1, 1, 1] and bad.count() == 20


def test_moved_records_null_files_and_empty_sides(spark):
    schema = "file long, at int, id long, body string"
    rows = [(f, k, 100 * (f or 0) + k, f"b{f}{k}") for f in (None, -1, 0, 5) for k in range(40)]
    moved = [(f, 40 if (f, k) == (0, 3) else k, i, b) for f, k, i, b in rows if (f, k) != (5, 7)] + [(-1, 50, 507, "b57")]
    left, right = (fixity.laid_out(spark.createDataFrame(x, schema), F.col("file"), ["at"], F.col("body"), "id") for x in (rows, moved))
    got = {(r["record_id"], r["file"], r["status"]) for r in fixity.audit(left, right).collect()}
    # the record put last and those that it leaped over are at another place among the pairs of their file
    assert got == {(507, 5, "moved")} | {(k, 0, "moved") for k in range(3, 40)}
    assert fixity.audit(left, left).count() == 0
    assert {r["status"] for r in fixity.audit(left, left.limit(0)).collect()} == {"missing"}
    assert {r["status"] for r in fixity.audit(left.limit(0), left).collect()} == {"surplus"}


def test_a_damaged_copy_is_found_whatever_its_hash(spark):
    for body in ("a", "q", "zz", "0"):
        rows = [(1, "same", ""), (1, "same", ""), (2, "x", "")]
        _, catalogue = leaf_rows(spark, rows)
        _, replica = leaf_rows(spark, [(1, "same", ""), (1, body, ""), (2, "x", "")])
        assert [(r["record_id"], r["status"]) for r in fixity.audit(catalogue, replica).collect()] == [(1, "altered")]


def test_mixing_counts_follow_the_inverse_poisson(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "big" if i % 3 else ("small" if i % 2 else None), i) for i in range(3000)] + [(None, None, "big", 0)], "doc_id long, text string, source string, copy long")
    got = {}
    for r in mixing.mix(docs, seed=7, exponent=0.5).collect():
        got[(r["doc_id"], r["text"])] = max(got.get((r["doc_id"], r["text"]), 0), r["copy"])
    counts = {"big": 2001, "small": 500, None: 500}
    mass = sum(math.sqrt(c) for c in counts.values())
    for i in range(3000):
        s = "big" if i % 3 else ("small" if i % 2 else None)
        rate = math.sqrt(counts[s]) / mass * 3001 / counts[s]
        u = int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:8], 16) / 2**32
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert got.get((i, f"t{i}"), 0) == k
    assert abs(sum(got.values()) - 3001) < 200


def test_mixing_weights_and_large_rates(spark):
    docs = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(2000)], "doc_id long, source string")
    out = mixing.mix(docs, weights={"a": 1.0}, total=10_000.0)
    assert {r["source"] for r in out.select("source").distinct().collect()} == {"a"} and abs(out.count() - 10_000) < 500
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, weights={"z": 1.0}).count() == 0


def test_mixing_of_an_unsaved_frame_is_the_first_call_of_a_session():
    code = """
from pyspark.sql import SparkSession, functions as F
from tallyspark.llm import mixing
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "tiny").otherwise("big").alias("source"))
print("rows", mixing.mix(docs).count())
"""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": root})
    assert 300 < int(done.stdout.split("rows ")[1]) < 700, done.stderr[-2000:]


@pytest.mark.parametrize("rate", [0.0, 1e-9, 0.4, 3.0, 700.0, 1e5, 1e8])
def test_distribution_of_every_rate(spark, rate):
    rates = spark.createDataFrame([("a", rate), (None, 1.0)], "_source string, _rate double")
    (row,) = mixing.poisson_cdf(rates).where("_source = 'a'").collect()
    cdf = row["_cdf"]
    assert cdf == sorted(cdf) and math.isclose(cdf[-1], 1, abs_tol=1e-5) and len(cdf) <= 24 * math.sqrt(rate) + 63
    assert row["_first"] == 0 or cdf[0] < 2**-40
    if rate:
        above = next(k for k, c in enumerate(cdf) if c > 0.5) + row["_first"]
        assert abs(above - rate) <= 1 + rate * 1e-6
    else:
        assert cdf == [1.0]


def test_counts_at_equal_sums(spark):
    rows = [(0, [0.25, 0.5, 0.5, 1.0], u) for u in (0.0, 0.25, 0.3, 0.5, 0.75)]
    df = spark.createDataFrame(rows, "f long, c array<double>, u double")
    assert [r["n"] for r in df.select(mixing.count_up_to("f", "c", "u").alias("n")).collect()] == [0, 1, 1, 3, 3]


def test_one_row_of_a_very_high_rate(spark):
    docs = spark.createDataFrame([(i, "tiny" if i == 7 else "big") for i in range(2000)], "doc_id long, source string")
    out = mixing.mix(docs, weights={"tiny": 1.0}, total=1e5)
    assert abs(out.count() - 1e5) < 3000 and out.select("doc_id").distinct().count() == 1


def test_main_text():
    menu, foot = "<nav><ul><li><a href=/a>One</a><li><a>Two</a></ul></nav>", "<footer>&copy; x</footer></body></html>"
    page = f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{menu}<div class=ad>Buy</div><article><header><h1>Title &amp;\n more</h1></header><p><b>First<br><p>Second  one.<p>Ok.<aside>Side</aside><form><p>Name</form><section class='comments'><p>Nice!</section></article>{foot}"
    assert html_text.main_text(page) == "Title & more\nFirst\nSecond one.\nOk."
    long = "word " * 40
    plain = f"<body>{menu}<div id=cookie-notice>We use cookies {long}</div><div id=content><h2>Head</h2><p>{long}</p><p>Short.</p></div><div id='sidebar'>x {long}</div>{foot}"
    assert html_text.main_text(plain) == f"Head\n{long.strip()}\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<article><p>cut &am") == "cut &am"
    for hard in ("<" * 9000, "<a" * 9000, '<a "' * 9000, "<!--" * 9000, "<b><p>" * 9000):
        html_text.main_text(hard)


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é x</p></article>", 5), (2, None, None, 6), (None, "v", "", 7), (1, "u", "<p>one", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()))
    assert got == [(0, "v", "", 0), (1, "u", "one", 3), (1, "u", "é x", 3), (2, "", "", 0)]


def test_scores_equal_a_plain_version(spark):
    from tests.llm.test_pipeline import plain_scores

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.training_model(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert not model.raw
    rows = docs.select("text", quality.scored(model, F.col("text")).alias("s")).collect()
    assert all(math.isclose(r["s"], s, abs_tol=1e-9) for r, s in zip(rows, plain_scores(model, [r["text"] for r in rows]), strict=True))
    none = docs.limit(0)
    assert none.select(quality.scored(model, F.col("text"))).count() == 0
