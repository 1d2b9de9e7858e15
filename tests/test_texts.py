import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import retrieval, texts
from tallyspark.sources import files, sinks
from tallyspark.streaming.sessions import stream_sessions


def test_fusion_and_quota(spark):
    a = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.9, 2)], "qid int, doc_id string, score double, rank int")
    b = spark.createDataFrame([(1, "b", 0.95, 1), (1, "c", 0.94, 2)], "qid int, doc_id string, score double, rank int")
    order = lambda df: [r["doc_id"] for r in df.orderBy("rank").collect()]
    assert order(retrieval.fused({"bm25": a, "vector": b}, "weighted")) == ["b", "c", "a"]
    assert order(retrieval.fused({"bm25": a, "vector": b}, "rrf")) == ["b", "a", "c"]
    found = spark.createDataFrame([(1, f"c{i}", d, i) for i, d in enumerate(("d1", "d1", "d1", "d2"), 1)], "qid int, c string, doc_id string, rank int")
    kept = lambda m: [r["c"] for r in retrieval.quota(found, m).orderBy("rank").collect()]
    assert kept(2) == ["c1", "c2", "c4"] and kept(0) == ["c1", "c2", "c3", "c4"]
    scores = spark.createDataFrame([(1, "c1", 0.1), (1, "c2", 0.9), (1, "c3", 0.5)], "qid int, c string, rerank double")
    assert [r["c"] for r in retrieval.reranked(found, lambda f: scores, 3, id_col="c").orderBy("rank").collect()] == ["c2", "c3", "c1"]


def test_html_tables():
    page = "<table><tr><th colspan=2>A &amp; B</th><th>C</th></tr><tr><td rowspan='2'>x</td><td>1<br>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr><tr><td></td></tr></table>"
    assert texts.html_tables_of(page) == [[["A & B", "", "C"], ["x", "1 2", "3"], ["x", "4", "5"]]]
    assert texts.html_tables_of(None) == [] == texts.html_tables_of("<td>x")


def test_pages_sections_and_tables(spark):
    d = spark.createDataFrame([(1, "lost\n## Page 1\none\n# 第2页\ntwo\n| a | b |\n|---|---|\n| 1\\|2 | |"), (2, "all"), (3, None)], "doc_id int, text string")
    assert sorted((r["doc_id"], r["page_number"], *r["text"].split("\n")[:2]) for r in texts.pages(d).collect()) == [(1, 1, "## Page 1", "one"), (1, 2, "# 第2页", "two"), (2, 1, "all")]
    assert [r["rows"] for r in texts.pipe_tables(d).collect()] == [[["a", "b"], ["1|2", ""]]]
    s = spark.createDataFrame([(1, "before\n# T\n\n## U\nx\ny")], "doc_id int, text string")
    assert sorted((r["section_title"], r["text"]) for r in texts.sections(s, fallback="F").collect()) == [("F", "before"), ("U", "x\ny")]
    row = s.select(texts.table_markdown(F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("1"), F.lit("2")))).alias("m"), texts.document_title(F.lit("\n# Hi"), F.lit("stem")).alias("t"), texts.section_title(F.lit("利润表\nx\n现金流量表\ny")).alias("s")).first()
    assert tuple(row) == ("| a\\|b | c |\n| --- | --- |\n| 1 | 2 |", "Hi", "现金流量表")


def test_chunks_cover_the_text():
    rng = random.Random(1)
    for _ in range(50):
        parts = ["".join(rng.choices("abc", k=rng.choice((5, 60, 300)))) for _ in range(rng.randint(0, 12))]
        got = texts.chunks_of("\n\n".join(parts), 100, 20)
        assert all(len(c) <= 121 for c in got)
        whole = "".join(got)
        assert all(p[:15] in whole for p in parts)
    assert texts.chunks_of(None) == []


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "q.csv").write_text('﻿编号,问题类型,问题\n1,多意图,"[{""Q"": ""a?""}, {""Q"": ""b?""}]"\n2,数据校验,"[{""Q"": ""c?""}]"\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("﻿股票代码,A股简称,公司名称,上市交易所,所属证监会行业\n332,旧,x,y,z\n332, 新 ,x,y,z\n,无,,,\n", encoding="utf-8")
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(x) for x in ({"id": "1", "question": "q", "relevant_docs": [{"doc_id": "d", "title": "t"}], "confirmed": True}, {"id": "2", "question": "q", "relevant_docs": [], "confirmed": False})))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "r.md").write_text("# T\nx")
    with zipfile.ZipFile(tmp_path / "docs" / "a.zip", "w") as z:
        z.writestr("x.md", "no")
        z.writestr("out/full.md", "yes")
    return tmp_path


def test_sources(spark, folder):
    q = files.question_set(spark, str(folder / "q.csv"))
    assert sorted(map(tuple, q.collect())) == [("1", "多意图", 1, "a?"), ("1", "多意图", 2, "b?"), ("2", "数据校验", 1, "c?")]
    assert files.evidence_questions(q, "a").count() == 1 and files.evidence_questions(q, "zzz").count() == 0
    assert [(r["stock_code"], r["stock_abbr"]) for r in files.company_registry(spark, str(folder / "c.csv")).collect()] == [("000332", "新")]
    assert [r["doc_id"] for r in files.golden_set(spark, str(folder / "g.jsonl"), True).collect()] == ["d"] and files.golden_set(spark, str(folder / "none.jsonl")).count() == 0
    assert [(r["stem"], r["text"]) for r in files.report_texts(spark, str(folder / "docs")).collect()] == [("r", "# T\nx")]
    assert [r["text"] for r in files.zipped_markdown(files.binary_files(spark, str(folder / "docs"), "*.zip")).collect()] == ["yes"]
    ranges = files.page_ranges(spark.createDataFrame([(1, 450)], "id int, n int"), "n").collect()
    assert [(r["first_page"], r["last_page"]) for r in ranges] == [(1, 200), (201, 400), (401, 450)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k string, x int")
    sinks.upsert(frame([("a", 1), ("b", 2)]), path, ["k"])
    sinks.upsert(frame([("a", None), ("c", 3)]), path, ["k"], keep_nulls=False)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    runs = str(tmp_path / "runs")
    for rows in ([(1, 1), (2, 1)], [(1, 9)], [(1, 9)]):
        sinks.rebuild_runs(spark.createDataFrame(rows, "run_id int, x int"), runs)
    assert sorted((r["run_id"], r["x"]) for r in spark.read.parquet(runs).collect()) == [(1, 9), (2, 1)]
    new = sinks.with_ids(frame([("y", 1), ("x", 1)]), spark.createDataFrame([(7,)], "id long"), "id", ["k"])
    assert sorted((r["k"], r["id"]) for r in new.collect()) == [("x", 8), ("y", 9)]
    meta = sinks.with_metadata(spark.createDataFrame([('{"a":"1"}',), (None,)], "m string"), "m", "p", "2")
    assert [json.loads(r["m"]) for r in meta.collect()] == [{"a": "1", "p": "2"}, {"p": "2"}]


def test_streamed_sessions(spark, tmp_path):
    turns = [(1, 1, "2024年年报营收前5是多少"), (2, 1, "净利润"), (2, 2, "2024年年报最高的公司")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, this_year=2026).writeStream.format("memory").queryName("turns_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["conv_id"], r["turn"]): r["missing"] for r in spark.table("turns_out").collect()}
    assert got[(1, 1)] is None and got[(2, 1)] == "year" and len(got) == 3


def test_names_of_reports_and_companies(spark):
    from tallyspark.functions import report_names
    from tallyspark.operators import companies

    d = spark.createDataFrame([("600000_20240430.pdf", "2022年年度报告"), ("600000_20240501", None), ("x_20240501", "2023 年\n半年度报告 证券代码：000001"), ("1234567_20241331", ""), (None, None)], "name string, body string")
    got = d.select(report_names.refined(report_names.file_report(F.col("name")), F.col("body")).alias("r")).select("r.stock_code", "r.report_year", "r.report_period").collect()
    assert [tuple(r) for r in got] == [("600000", 2022, "FY"), ("600000", 2024, "HY"), ("000001", 2023, "HY"), ("234567", None, None), (None, None, None)]
    c = spark.createDataFrame([("000001", "Alpha"), ("000002", "Alpha Beta"), ("000003", None), ("000004", "alpha")], "stock_code string, stock_abbr string")
    t = spark.createDataFrame([(1, "of ALPHA beta"), (2, "alpha"), (3, "证券代码 600001 alpha"), (4, None), (5, "")], "doc_id int, text string")
    assert sorted(map(tuple, companies.mentioned(t, c).collect())) == [(1, "000002"), (2, "000001"), (3, "600001"), (4, None), (5, None)]
    n = spark.createDataFrame([("1",), (" ALPHA",), ("zzz",), ("",), (None,)], "name string")
    assert [tuple(r) for r in companies.resolved(n, c).collect()] == [("1", "000001"), (" ALPHA", "000001"), ("zzz", None), ("", None), (None, None)]
    two = spark.createDataFrame([("1", 1, "a"), ("000001", 2, "b"), (" ", 3, "c")], "stock_code string, n int, name string")
    assert [tuple(r) for r in companies.newest(two, "n").collect()] == [("000001", 2, "b")]


def test_names_that_begin_alike(spark):
    from tallyspark.operators import companies

    long = "x" * 70
    listed = [(f"{i:06d}", f"Supplier#{i:09d}") for i in range(3000)] + [("100001", "ab"), ("100002", "?ab"), ("100003", "a\\E"), ("100004", long + "y"), ("100005", long + "z1"), ("100006", long + "z"), ("100007", "b😀c😀"), ("100008", "x" * 64)]
    c = spark.createDataFrame(listed, "stock_code string, stock_abbr string")
    said = ["of SUPPLIER#00000 2999", "supplier#000000007 supplier#000000005", "supplier#00000", "😀ab", "is a\\e", long + " z1", "!" + long + "z", long, "😀b😀c😀", "sup", "supplier#000003000 ab"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "doc_id int, text string")
    want = ["002999", "000005", None, "100001", "100003", "100005", "100006", "100008", "100007", None, "100001"]
    assert [r["stock_code"] for r in companies.mentioned(t, c).orderBy("doc_id").collect()] == want
    many = spark.range(2000).select("id", F.concat(F.lit("on supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("text"))
    assert companies.mentioned(many, c, "id").where(F.col("stock_code") == F.lpad(F.col("id").cast("string"), 6, "0")).count() == 2000
