"""Extra columns may have any name, those that operators use inside included."""

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bitslice, fixity, html_text, mixing, packing, pii, quality, secret_scan, simhash, vector_join
from tallyspark.llm.entries import tokenizer_path

NAMES = "_id _label _text _dict _source _n _rate _cdf _u _times _order _kept _rows _fp _hash _group _q _v _count copy score rank fp rep m v cell far raw n spans hash file ordinal record_id offset length segment block asks vec_query piece start component_id fingerprint node src dst key count label block_no held_out".split()


def widened(df):
    """``df`` with a column of every such name that it lacks, before and after its own."""
    extra = [F.lit("x").alias(c) for c in NAMES if c not in df.columns]
    half = len(extra) // 2
    return df.select(*extra[:half], *df.columns, *extra[half:])


def rows(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    lorem = "the quick brown fox jumps over the lazy dog near the river bank today"
    data = [(i, f"{lorem} {i % 5} token=abcdefghijklmnop{i} mail a{i}@b.org", "en", "ab"[i % 2], 60 + i) for i in range(40)]
    data += [(40, None, None, None, None), (41, "", "en", "a", 0), (41, "", "en", "a", 0), (None, lorem, "en", "b", 5)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def vectors(spark):
    data = [(i, [float(i % 4), 1.0, float(i % 3)]) for i in range(60)] + [(60, None), (None, [1.0, 2.0, 3.0])]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def test_packing(docs):
    got = [rows(packing.pack_documents(d, tokenizer_path(), 64), "doc_id", "piece", "ids_crc32", "length") for d in (docs, widened(docs))]
    assert got[0] == got[1]


def test_quality(docs):
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    a, b = quality.training_model(docs, labels), quality.training_model(widened(docs), widened(labels))
    assert a == b
    assert rows(widened(docs).select("doc_id", quality.scored(b, F.col("text")).alias("s")), "doc_id", "s") == rows(docs.select("doc_id", quality.scored(a, F.col("text")).alias("s")), "doc_id", "s")


def test_fixity(docs):
    found = []
    for d in (docs, widened(docs)):
        content = fixity.warc_record(F.col("lang"), F.col("doc_id"), F.col("text"))
        sides = [fixity.laid_out(x, F.floor(F.col("doc_id") / 16), ["doc_id"], content, "doc_id") for x in (d, d.where("doc_id <> 7"))]
        found.append(rows(fixity.audit(*sides), "file", "record_id", "status"))
    assert found[0] == found[1] and ("0", "7", "missing") in found[0]


def test_scans(docs):
    assert rows(secret_scan.scan(widened(docs)), "doc_id", "spans") == rows(secret_scan.scan(docs), "doc_id", "spans")
    w = widened(docs)
    assert rows(pii.find(w, pii.train(w)), "doc_id", "spans") == rows(pii.find(docs, pii.train(docs)), "doc_id", "spans")
    kept = pii.redact(w, pii.train(w))
    assert kept.columns == w.columns
    assert rows(kept, "doc_id", "text", "n_chars", "score") == rows(pii.redact(docs, pii.train(docs)).withColumn("score", F.lit("x")), "doc_id", "text", "n_chars", "score")


def test_mixing(docs):
    w = widened(docs)
    out = mixing.mix(w)
    assert out.columns == [c for c in w.columns if c != "copy"] + ["copy"]
    assert rows(out, "doc_id", "copy", "source") == rows(mixing.mix(docs), "doc_id", "copy", "source")
    assert {r[c] for r in out.collect() for c in w.columns if c in NAMES and c != "copy"} <= {"x"}


def test_pages(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert rows(html_text.extract(widened(pages)), "page_id", "text") == rows(html_text.extract(pages), "page_id", "text")


def test_vectors(vectors):
    w = widened(vectors)
    assert rows(vector_join.near_vectors(w), "vec_id", "n_links", "component_id") == rows(vector_join.near_vectors(vectors), "vec_id", "n_links", "component_id")
    got = [rows(bitslice.top_k(v, F.col("vec_id") % 10 == 0, 3), "query_id", "rank", "vec_id", "score") for v in (vectors, w)]
    assert got[0] == got[1]


def test_near_documents(docs):
    w = widened(docs)
    assert rows(simhash.near_documents(w), "doc_id", "fingerprint", "component_id") == rows(simhash.near_documents(docs), "doc_id", "fingerprint", "component_id")
    kept = simhash.deduplicated(w)
    assert kept.columns == w.columns
    assert rows(kept, "doc_id", "text", "score") == rows(simhash.deduplicated(docs).withColumn("score", F.lit("x")), "doc_id", "text", "score")
