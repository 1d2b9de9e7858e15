"""Registered queries on files that a query writes first, on numbers in cells, on parsed questions and reports, with their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.facade import Engine
from tallyspark.functions import catalog, scalars
from tallyspark.operators import evaluation, retrieval, staging, texts
from tallyspark.operators.lineage import shared_folder
from tallyspark.plans import dsl, presentation, questions, text_queries
from tallyspark.plans.panel_queries import WITH_FACTS
from tallyspark.sources import files, index, panel, sinks

COMPANIES = [questions.Company("600332", "白云山", "广州白云山医药"), questions.Company("300347", "泰格医药")]
THIS_YEAR = 2026


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def of(n: str, *values: str) -> Column:
    """One of the values by the remainder of a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(n) % len(values) + 1).cast("int"))


def sql_of(n: str, *values: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][{n} % {len(values)} + 1]"


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as CSV with a byte-order mark, padded header and cells, quoted line breaks and empty cells, read again."""
    path = f"{fresh_folder(spark)}/nation.csv"
    rows = panel.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    body = "".join(f'{r["n_nationkey"]}, {r["n_name"]} ,"a ""q""\n{r["n_regionkey"]}",\n' for r in rows)
    sinks.put_text(spark, path, files.BOM + " n_nationkey ,n_name, note,empty\n" + body)
    return files.csv_table(spark, path)


def field_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of fields by table with units and aliases from their labels."""
    folder = fresh_folder(spark)
    names = [r["n_name"] for r in panel.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    head = "字段名称,中文名称,字段类型（长度）\n"
    sinks.put_text(spark, f"{folder}/a.csv", head + "".join(f"{n},{n}-总额（万元）,decimal\n" for n in names) + ",无名,x\n")
    sinks.put_text(spark, f"{folder}/b.csv", head + "".join(f"{n},{n}/同比增长(%),decimal\n" for n in names) + "eps,每股收益,decimal\n")
    found = files.field_registry(spark, {"a": f"{folder}/a.csv", "b": f"{folder}/b.csv"}, (names[0],))
    return found.select("table_name", "field_name", "chinese_name", "data_type", "unit", F.array_join("aliases", "|").alias("aliases"), "is_dimension")


def company_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with short codes, one of them twice, and rows without a code."""
    path = f"{fresh_folder(spark)}/companies.csv"
    names = [(r["n_nationkey"], r["n_name"]) for r in panel.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    lines = [f"{k},旧{n},{n},x,y\n{k}, {n} ,{n},x,y\n,{n},z,,\n" for k, n in names]
    sinks.put_text(spark, path, "股票代码,A股简称,公司名称,上市交易所,所属证监会行业\n" + "".join(lines))
    return files.company_registry(spark, path)


def zip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markdown that is chosen from a parser's archive of several files."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, t in zip(f["doc_id"], f["text"], strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for name in (("a.md", "x/full.md"), ("b.md", "c.md"), ("n.txt",))[n % 3]:
                        z.writestr(name, t if name in ("x/full.md", "b.md") else "other")
                out.append(data.getvalue() if n % 4 else b"broken")
            yield pd.DataFrame({"path": f["doc_id"].astype(str), "content": out})

    made = text_queries.documents(spark, sf_dir).select("doc_id", "text").mapInPandas(packed, "path string, content binary")
    return files.zipped_markdown(made).select("path", F.md5(F.col("text").cast("binary")).alias("tag"))


def report_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of reports in markdown, one for each nation, and their metadata as CSV."""
    folder = fresh_folder(spark)
    for r in panel.read(spark, sf_dir, "nation").collect():
        sinks.put_text(spark, f"{folder}/reports/{r['n_regionkey']}/R {r['n_name']}.md", f"# Title {r['n_name']}\nText of {r['n_nationkey']}")
        sinks.put_text(spark, f"{folder}/reports/{r['n_regionkey']}/{r['n_name']}.txt", "no report")
    names = [(r["n_nationkey"], r["n_name"]) for r in panel.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    stock = "".join(f"title {n.lower()},Stock {n},{k},Org,2024-03-0{k % 9 + 1} 00:00:00\n" for k, n in names if k % 2 == 0)
    industry = "".join(f"R{n},Industry {n},2023-01-01,B\n" for k, n in names if k % 3 == 0)
    sinks.put_text(spark, f"{folder}/stock.csv", "title,stockName,stockCode,orgSName,publishDate\n" + stock)
    sinks.put_text(spark, f"{folder}/industry.csv", "title,industryName,publishDate,sRatingName\n" + industry)
    return folder


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.report_texts(spark, f"{report_folder(spark, sf_dir)}/reports").select("stem", "text")


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.binary_files(spark, f"{report_folder(spark, sf_dir)}/reports", "*.md")
    return found.select("sha256", "length")


def research_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with the metadata of their title, or else of their file's name, those of stocks first."""
    folder = report_folder(spark, sf_dir)
    reports = files.report_texts(spark, f"{folder}/reports").withColumn("doc_title", texts.document_title(F.col("text"), F.col("stem")))
    stock, industry = (files.report_metadata(spark, f"{folder}/{kind}.csv", kind) for kind in ("stock", "industry"))
    return files.research_documents(reports, "doc_title", stock, industry).select("doc_title", "report_type", "stock_name", "stock_code", "org_name", "publish_date", "industry_name", "rating")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read again; a path that isn't there adds nothing."""
    folder = fresh_folder(spark)
    schema = "doc_id long, lang string, n_chars int"
    text_queries.documents(spark, sf_dir).select("doc_id", "lang", F.col("n_chars").cast("int")).write.json(f"{folder}/d")
    return files.json_lines(spark, f"{folder}/d", schema).unionByName(files.json_lines(spark, f"{folder}/missing", schema))


def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from a CSV whose cells are JSON arrays."""
    path = f"{fresh_folder(spark)}/q.csv"
    rows = panel.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    sinks.put_text(spark, path, "编号,问题类型,问题\n" + "".join(f'{r["n_nationkey"]},k{r["n_regionkey"]},"[{{""Q"": "" {r["n_name"]}? ""}}, {{""Q"": """"}}, {{""Q"": ""more""}}]"\n' for r in rows))
    return files.question_set(spark, path)


def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed golden questions with documents, from JSON lines."""
    folder = fresh_folder(spark)
    doc = F.struct(F.concat(F.lit("doc-"), F.col("item_id").cast("string")).alias("doc_id"), F.lit("t").alias("title"))
    n = F.col("item_id") % 3
    made = panel.read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(n == 0, F.array()).when(n == 1, F.array(doc)).otherwise(F.array(doc, doc)).alias("relevant_docs"), (F.col("item_id") % 2 == 0).alias("confirmed"))
    made.write.json(folder)
    return files.golden_set(spark, folder, confirmed_only=True).select("qid", "doc_id")


CELLS = ("1,234.50", "(12.30)", "（7.5）", "--", "不适用", "−5", "12%", " 3 ", "十九、4", "", "(-3)", "－0.25", "1 234")
NUMBERS = (1234.5, -12.3, 7.5, None, None, -5.0, 12.0, 3.0, None, None, -3.0, -0.25, 1234.0)


def numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables as numbers: those of fixed forms, and every price with commas, in parentheses or with a sign."""
    o = panel.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    shown = F.format_number("p", 2)
    cell = F.when(F.col("o_orderkey") % 4 == 0, of("o_orderkey", *CELLS)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit(" －"), shown)).otherwise(F.concat(shown, F.lit(" %")))
    return o.select("o_orderkey", scalars.numeric(cell).cast("double").alias("value"))


def header_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header that holds for each column of a sparse header row."""
    n = panel.read(spark, sf_dir, "nation")
    header = F.array(F.lit("项目"), F.lit(""), F.lit(" "), F.col("n_name"), F.lit(""), F.lit(""), F.lit(""))
    return n.select("n_nationkey", header.alias("header"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("place")).select("n_nationkey", "place", staging.header_at(F.col("place")).alias("found"))


def note_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of details are left out unless they name a statement; kinds of the others by title."""
    o = panel.read(spark, sf_dir, "nation")
    title = of("n_nationkey", "重要合营企业 利润表", "合并利润表", "合营企业 合并资产负债表", "合并现金流量表", "无关")
    rows = F.array(F.array(F.lit("项目"), F.lit("2023年度")), F.array(F.col("n_name"), F.lit("5")), F.array(F.lit("其他"), F.lit("6")))
    tables = o.select(
        F.col("n_nationkey").cast("long").alias("document_id"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("stock_code"), F.lit(2023).alias("report_year"), F.lit("FY").alias("report_period"),
        F.lit(1).alias("page_number"), F.lit(1).alias("table_index"), title.alias("section_title"), rows.alias("rows"), F.lit("").alias("markdown"), F.lit("").alias("page_text"),
    )
    return staging.typed_rows(staging.table_rows(tables)).select("stock_code", "label", "table_type")


def cell_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit of a table: named, spoken of, or the commonest in its cells, the first seen of equals."""
    n = panel.read(spark, sf_dir, "nation")
    title = of("n_nationkey", "单位：万元 x", "以元表示", "", "", "单位: 未知")
    cells = F.array(F.array(F.lit("收入（千元）"), F.lit("费用(元)")), F.array(F.when(F.col("n_nationkey") % 2 == 0, "税（元）").otherwise("每股（元/股）"), F.lit("1")))
    return n.select("n_nationkey", title.alias("section_title"), F.lit("").alias("markdown"), F.lit("").alias("page_text"), cells.alias("rows")).select("n_nationkey", staging.table_unit().alias("unit"))


def period_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders").select("o_orderkey")
    return o.select("o_orderkey", scalars.period_scope(of("o_orderkey", "balance_sheet", "income_sheet", "cash_flow_sheet"), of("o_orderkey", "FY", "HY", "Q1", "Q3", "Q2")).alias("scope"))


def safe_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over an allowed table, and what is refused: changes, subqueries, other tables."""
    panel.read(spark, sf_dir, "nation").createOrReplaceTempView("nation_view")
    tried = ["select n_name from nation_view where n_regionkey = 1", "drop view nation_view", "select * from other_view", "select 1 where exists (select 1 from nation_view)", "insert into nation_view values (1)", "select 1; select 2"]
    out = []
    for k, statement in enumerate(tried):
        try:
            out.append((k, "ok", dsl.safe_select(spark, statement, {"nation_view"}).count()))
        except Exception:  # noqa: BLE001  a refusal of ours or of the parser
            out.append((k, "refused", None))
    return spark.createDataFrame(out, "statement int, outcome string, n long")


PARSED = (
    "白云山2024年年报营收是多少", "2024年年报净利润最高的5家公司", "2024年年报净利润超过2亿的公司有哪些", "白云山近三年营收趋势图", "泰格医药2022-2025年各报告期扣非净利润", "你好", "2024年第三季度营业利润柱状图", "白云山和泰格医药2023年毛利率比较",
)


def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of questions: intent, metrics, years, periods, limit, chart, warnings and what is missing, as JSON that comes back the same."""
    made = [questions.parse(q, COMPANIES, THIS_YEAR) for q in PARSED]
    rows = [(k, questions.to_json(s)) for k, s in enumerate(made)]
    got = spark.createDataFrame(rows, "question int, slots string")
    j = lambda path: F.get_json_object("slots", path)
    listed = lambda name: F.concat_ws(",", F.from_json(j(f"$.{name}"), "array<string>"))
    return got.select("question", j("$.intent").alias("intent"), listed("metrics").alias("metrics"), listed("years").alias("years"), listed("periods").alias("periods"), j("$.limit").cast("int").alias("n"), j("$.chart").alias("chart"), j("$.missing").alias("missing"), (F.size(F.from_json(j("$.warnings"), "array<string>"))).alias("warnings"))


REPLIES = (
    '{"metrics": ["营收"], "company_codes": ["332", "600332"], "years": [2024, 1800], "periods": ["fy", "zz"], "limit": 9999}',
    '```json\n{"metrics": ["毛利率", "nonsense"], "years": [2023], "periods": ["FY"], "intent_type": "ranking_query", "sort_direction": "ASC"}\n```',
    "no object",
    "",
)


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's replies checked against the closed lists; without a usable one the rules answer."""
    out = []
    for k, reply in enumerate(REPLIES):
        s = questions.parse_with(lambda _, r=reply: r, "白云山2024年年报营收是多少", COMPANIES, THIS_YEAR)
        q = questions.to_query(s)
        out.append((k, s.source, s.intent, ",".join(s.metrics), ",".join(s.codes), ",".join(map(str, s.years)), ",".join(s.periods), q.limit, q.descending))
    return spark.createDataFrame(out, "reply int, source string, intent string, metrics string, codes string, years string, periods string, n int, descending boolean")


def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows for an answer: whole decimals as integers, others as floats, with the unit of their column."""
    n = panel.read(spark, sf_dir, "nation")
    wide = n.select(F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("stock_code"), F.col("n_name").alias("stock_abbr"), F.lit(2024).alias("report_year"), F.lit("FY").alias("report_period"), (F.col("n_nationkey").cast("decimal(20,4)") / 2).cast("decimal(20,2)").alias("total_operating_revenue"))
    store = dsl.Store({catalog.CORE: wide}, {catalog.CORE: ["total_operating_revenue"]})
    query = dsl.Query(metrics=("营收",), years=(2024,), periods=("FY",), limit=500)
    unit = dsl.units_of(query, store)["total_operating_revenue"]
    rows = [(r["stock_code"], str(r["total_operating_revenue"]), unit) for r in dsl.json_rows(dsl.compiled(query, store))]
    return spark.createDataFrame(rows, "stock_code string, shown string, unit string")


def rebuilt_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by run stored, two runs replaced by others of fewer rows, and the replacement done twice."""
    path = f"{fresh_folder(spark)}/facts"
    facts = panel.staging_facts(spark, sf_dir).select(F.col("report_year").cast("int").alias("run_id"), "stock_code", "target_field", F.col("standard_value").cast("double").alias("value"))
    sinks.rebuild_runs(facts, path)
    newer = facts.where("run_id in (1994, 1996) and target_field = 'revenue'").withColumn("value", F.col("value") * 2)
    for _ in range(2):
        sinks.rebuild_runs(newer, path)
    return spark.read.parquet(path).groupBy("run_id", "target_field").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one run with their tables in order; pages without tables have none."""
    d = text_queries.documents(spark, sf_dir).select((F.col("doc_id") % 3).cast("int").alias("run_id"), F.col("doc_id").cast("int").alias("page_number"), F.col("source").alias("text"), "lang")
    two = F.explode(F.array(F.lit(2), F.lit(1)))
    tables = d.where("page_number % 2 = 0").select("run_id", "page_number", two.alias("table_index"), F.array(F.array("lang")).alias("rows"))
    found = texts.stored_pages(d.select("run_id", "page_number", "text"), tables, 1)
    return found.select("page_number", "text", F.array_join(F.transform("tables", lambda t: F.concat_ws("~", t["table_index"].cast("string"), F.get(F.get(t["rows"], F.lit(0)), F.lit(0)))), ";").alias("tables"))


def offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents read in parts of 200, counted through."""
    d = text_queries.documents(spark, sf_dir).select("doc_id", (F.col("n_chars") % 450).cast("int").alias("pages"))
    parts = files.page_ranges(d, "pages")
    local = parts.withColumn("page_number", F.explode(F.sequence(F.lit(1), F.col("last_page") - F.col("first_page") + 1)))
    return texts.offset_pages(local.select("doc_id", "first_page", "page_number"))


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space tidied, fields joined for a search channel, the nearest statement's name, a stable id."""
    d = text_queries.documents(spark, sf_dir)
    raw = F.concat(F.lit("  a \t b\n\n\n\n"), F.col("source"), F.lit("  x\n"))
    fields = retrieval.search_text(F.col("source"), F.lit(" "), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.lit("end"))
    title = texts.section_title(F.concat(F.lit("# 合并利润表 "), F.col("lang"), F.lit(" #\nx\n"), F.when(F.col("doc_id") % 2 == 0, "## 现金流量表").otherwise("y")))
    return d.select("doc_id", texts.tidy(raw).alias("tidy"), fields.alias("fields"), title.alias("title"), scalars.stable_id(F.col("lang"), F.col("source")).alias("id"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as CSV, JSON, markdown and text, and how many lines of each are read again."""
    folder = fresh_folder(spark)
    n = panel.read(spark, sf_dir, "nation").withColumn("bar", sinks.progress(F.col("n_nationkey"), F.lit(24)))
    for kind in ("csv", "json", "markdown", "text"):
        sinks.file_report(n.coalesce(1), f"{folder}/{kind}", ["n_name", "n_nationkey", "bar"], kind)
    out = None
    for kind in ("csv", "json", "markdown", "text"):
        part = spark.read.text(f"{folder}/{kind}").select(F.lit(kind).alias("kind"), F.md5(F.col("value").cast("binary")).alias("tag"))
        out = part if out is None else out.unionByName(part)
    return out


def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documents, chunks and vectors written and read again; without its vectors it still answers."""
    folder = fresh_folder(spark)
    d = text_queries.documents(spark, sf_dir).select("doc_id", "text", "source")
    vectors = panel.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    chunks = d.select(F.concat(F.col("doc_id").cast("string"), F.lit("-0")).alias("chunk_id"), "doc_id", F.md5(F.col("text").cast("binary")).alias("chunk"))
    index.write(f"{folder}/a", d, chunks, vectors, "m")
    index.write(f"{folder}/b", d, chunks)
    out = []
    for name in ("a", "b", "missing"):
        got = index.read(spark, f"{folder}/{name}", "doc_id long, text string, source string", "chunk_id string, doc_id long, chunk string")
        out.append((name, *((None,) * 4 if got is None else (got.documents.count(), got.chunks.select("chunk").distinct().count(), got.vectors.count() if got.vectors is not None else None, got.meta["chunks"]))))
    return spark.createDataFrame(out, "name string, documents long, texts long, vectors long, chunks long")


def blind_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of answers, half of them turned around by a hash, judged by their first letter and turned back."""
    d = text_queries.documents(spark, sf_dir)
    pairs = evaluation.blind_pairs(d.select("doc_id", "source", "lang"), "doc_id", "source", "lang", 7)
    judged = pairs.withColumn("verdict", F.when(F.col("first") < F.col("second"), "A").when(F.col("first") > F.col("second"), "B").otherwise("?"))
    return evaluation.win_rates(judged.withColumn("kind", F.lit("all")), "kind")


def whole_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged batches without the questions of which one batch failed."""
    e = panel.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("qid"), F.when(F.col("event_id") % 50 != 0, F.col("event_type")).alias("reply"))
    return evaluation.whole_judgements(e).groupBy("qid").agg(F.count("*").alias("n"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each question as snippets of 30 characters."""
    found = text_queries.bm25_topk(spark, sf_dir).join(text_queries.documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    long = found.withColumn("text", F.concat(F.col("source"), F.lit("  is the source of document "), F.col("doc_id").cast("string")))
    return retrieval.evidence(long, "text", 3, 30).select("qid", "doc_id", "text")


def chart_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cut for an axis, numbers on it, images as addresses, and the range that a chart's axis has."""
    rows = []
    for r in panel.read(spark, sf_dir, "nation").collect():
        k = r["n_nationkey"]
        low, high = presentation.bounds([float(k), float(k % 5)], "bar" if k % 2 else "line")
        rows.append((k, presentation.short(r["n_name"], 5), presentation.axis_number(k * 123.456), presentation.data_url(r["n_name"]), low, high))
    return spark.createDataFrame(rows, "n_nationkey int, label string, tick string, url string, low double, high double")


def nation_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Nations as companies with a revenue for 2024, and a text for each."""
    n = panel.read(spark, sf_dir, "nation")
    code = F.lpad(F.col("n_nationkey").cast("string"), 6, "0")
    wide = n.select(code.alias("stock_code"), F.col("n_name").alias("stock_abbr"), F.lit(2024).alias("report_year"), F.lit("FY").alias("report_period"), F.col("n_nationkey").cast("decimal(20,2)").alias("total_operating_revenue"))
    chunks = n.select(F.concat(F.lit("c"), code).alias("chunk_id"), F.concat(F.lit("d"), code).alias("doc_id"), code.alias("stock_code"), F.concat(F.lit("outlook of "), F.col("n_name")).alias("text"))
    known = [questions.Company(r["stock_code"], r["stock_abbr"]) for r in wide.select("stock_code", "stock_abbr").collect()]
    return Engine(spark, dsl.Store({catalog.CORE: wide}, {catalog.CORE: ["total_operating_revenue"]}), known, chunks, this_year=THIS_YEAR)


def engine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine makes of questions: route, status, asked slot, rows and the first value, errors told and not raised."""
    engine = nation_engine(spark, sf_dir)
    names = [c.stock_abbr for c in engine.companies if c.stock_code in ("000003", "000007")]
    asked = [*[f"{n} 2024年年报营收是多少" for n in sorted(names)], "2024年年报营收最高的3家公司", "2024年年报营收是多少", f"{names[0]} 2021年年报营收是多少", f"{names[0]} 2024年年报毛利率", "outlook"]
    rows = []
    for k, q in enumerate(asked):
        got = engine.query(q)
        found = [r for part in got.get("results", ()) for r in part["rows"]]
        rows.append((k, engine.route(q), got["status"], got.get("slot"), len(found), float(found[0]["total_operating_revenue"]) if found else None))
    return spark.createDataFrame(rows, "question int, route string, status string, slot string, n int, first double")


def agent_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of an agent that queries, calculates, errs and answers, and the status of one that reaches its limit."""
    engine = nation_engine(spark, sf_dir)
    moves = iter(
        [
            {"tool": "query_financial_data", "arguments": {"metrics": ["营收"], "years": [2024], "periods": ["FY"], "companies": ["3"]}},
            {"tool": "calculate", "arguments": {"expression": "a*2", "variables": {"a": 3}}},
            {"tool": "query_financial_data", "arguments": {"metrics": ["营收"], "years": [2024], "periods": ["FY"], "companies": ["999999"]}},
            {"tool": "none", "arguments": {}},
            {"answer": "six"},
        ]
    )
    last = engine.agent(lambda _: next(moves), lambda _: None).run("q")
    rows = [(t["step"], t["tool"], t["status"]) for t in last["trace"]] + [(0, last["answer"], last["status"])]
    endless = engine.agent(lambda _: {"tool": "calculate", "arguments": {"expression": "1+1"}}, lambda _: "so far").run("q")
    rows.append((-1, f"{endless['answer']} {len(endless['trace'])}", endless["status"]))
    return spark.createDataFrame(rows, "step int, tool string, status string")


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the wide tables as their CREATE TABLE texts say, counted by type once Spark has applied them."""
    rows = []
    for table in catalog.TABLES:
        name = f"made_{table}_{uuid.uuid4().hex}"
        spark.sql(f"{catalog.ddl(table).replace(table, name, 1)} LOCATION '{fresh_folder(spark)}'")
        rows += [(table, f.dataType.simpleString()) for f in spark.table(name).schema]
        spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(rows, "table_name string, kind string").groupBy("table_name", "kind").agg(F.count("*").alias("n"))


OWN = (
    engine_answers, agent_trace, table_columns,
    csv_cells, field_registry, company_registry, zip_markdown, report_texts, file_hashes, research_documents, json_lines, question_set, golden_set, numeric_cells, header_search, note_tables, cell_units, period_scopes, safe_select,
    parsed_questions, model_replies, json_results, rebuilt_runs, stored_pages, offset_pages, text_forms, report_lines, index_round_trip, blind_pairs, whole_judgements, evidence, chart_parts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OWN}


# How many columns of each size a wide table has, beside three texts and two whole numbers.
TABLE_KINDS = {
    catalog.CORE: {"decimal(20,2)": 3, "decimal(10,4)": 12},
    catalog.INCOME: {"decimal(20,2)": 14, "decimal(10,4)": 2},
    catalog.BALANCE: {"decimal(20,2)": 13, "decimal(10,4)": 3},
    catalog.CASH: {"decimal(20,2)": 9, "decimal(10,4)": 4},
}


def _rows(columns: str, rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def oracle_sql() -> dict[str, str]:
    core = f"{catalog.CORE}."
    numbers = f"[{', '.join('NULL' if n is None else str(n) for n in NUMBERS)}]"
    full = "floor(n_nationkey / 24.0::DOUBLE * 20)::INT"
    bar = f"'[' || repeat('#', {full}) || repeat('.', 20 - {full}) || '] ' || printf('%.1f', n_nationkey / 24.0::DOUBLE * 100) || '%'"
    bm25 = text_queries._BM25
    return {
        "engine_answers": """WITH q AS (SELECT row_number() OVER (ORDER BY n_name) - 1 AS question, n_nationkey FROM nation WHERE n_nationkey IN (3, 7))
SELECT question::INT AS question, 'figures' AS route, 'ok_nonempty' AS status, NULL AS slot, 1 AS n, n_nationkey::DOUBLE AS first FROM q
UNION ALL SELECT 2, 'figures', 'ok_nonempty', NULL, 3, (SELECT max(n_nationkey)::DOUBLE FROM nation) UNION ALL SELECT 3, 'clarification', 'clarification', 'company', 0, NULL
UNION ALL SELECT 4, 'figures', 'ok_empty', NULL, 0, NULL UNION ALL SELECT 5, 'figures', 'error', NULL, 0, NULL UNION ALL SELECT 6, 'texts', 'clarification', 'metric', 0, NULL""",
        "agent_trace": _rows("step, tool, status", [(1, "query_financial_data", "ok"), (2, "calculate", "ok"), (3, "query_financial_data", "error"), (4, "none", "error"), (0, "six", "answered"), (-1, "so far 8", "limit")]),
        "table_columns": _rows("table_name, kind, n", [(t, kind, n) for t, decimals in TABLE_KINDS.items() for kind, n in (("string", 3), ("int", 2), *decimals.items())]),
        "csv_cells": "SELECT n_nationkey::VARCHAR AS n_nationkey, trim(n_name) AS n_name, 'a \"q\"' || chr(10) || n_regionkey AS note, '' AS empty FROM nation",
        "field_registry": """SELECT 'a' AS table_name, n_name AS field_name, n_name || '-总额（万元）' AS chinese_name, 'decimal' AS data_type, '万元' AS unit, n_name || '|' || n_name || '-总额（万元）|' || n_name || '-总额|总额' AS aliases, n_nationkey = 0 AS is_dimension FROM nation
UNION ALL SELECT 'b', n_name, n_name || '/同比增长(%)', 'decimal', '%', n_name || '|' || n_name || '/同比增长(%)|' || n_name || '/同比增长', n_nationkey = 0 FROM nation UNION ALL SELECT 'b', 'eps', '每股收益', 'decimal', NULL, 'eps|每股收益""" + "".join(f"|{a}" for a in catalog.MANUAL_ALIASES.get("eps", ()) if a != "每股收益") + """', false""",
        "company_registry": "SELECT lpad(n_nationkey::VARCHAR, 6, '0') AS stock_code, trim(n_name) AS stock_abbr, trim(n_name) AS company_name, 'x' AS exchange, 'y' AS industry FROM nation",
        "zip_markdown": "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 2 THEN NULL ELSE md5(text) END AS tag FROM documents",
        "report_texts": "SELECT 'R ' || n_name AS stem, '# Title ' || n_name || chr(10) || 'Text of ' || n_nationkey AS text FROM nation",
        "file_hashes": "SELECT sha256(t) AS sha256, strlen(t) AS length FROM (SELECT '# Title ' || n_name || chr(10) || 'Text of ' || n_nationkey AS t FROM nation)",
        "research_documents": """SELECT 'Title ' || n_name AS doc_title, CASE WHEN n_nationkey % 2 = 0 THEN 'stock' WHEN n_nationkey % 3 = 0 THEN 'industry' END AS report_type,
CASE WHEN n_nationkey % 2 = 0 THEN 'Stock ' || n_name WHEN n_nationkey % 3 = 0 THEN '' END AS stock_name, CASE WHEN n_nationkey % 2 = 0 THEN lpad(n_nationkey::VARCHAR, 6, '0') WHEN n_nationkey % 3 = 0 THEN '' END AS stock_code,
CASE WHEN n_nationkey % 2 = 0 THEN 'Org' WHEN n_nationkey % 3 = 0 THEN '' END AS org_name, CASE WHEN n_nationkey % 2 = 0 THEN '2024-03-0' || (n_nationkey % 9 + 1) WHEN n_nationkey % 3 = 0 THEN '2023-01-01' END AS publish_date,
CASE WHEN n_nationkey % 2 = 0 THEN '' WHEN n_nationkey % 3 = 0 THEN 'Industry ' || n_name END AS industry_name, CASE WHEN n_nationkey % 2 = 0 THEN '' WHEN n_nationkey % 3 = 0 THEN 'B' END AS rating FROM nation""",
        "json_lines": "SELECT doc_id, lang, n_chars::INT AS n_chars FROM documents",
        "question_set": "SELECT n_nationkey::VARCHAR AS id, 'k' || n_regionkey AS kind, 1 AS turn, trim(n_name) || '?' AS question FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'k' || n_regionkey, 3, 'more' FROM nation",
        "golden_set": "SELECT item_id::VARCHAR AS qid, 'doc-' || item_id AS doc_id FROM benchmark, range(item_id % 3) WHERE item_id % 2 = 0",
        "numeric_cells": f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {numbers}[o_orderkey % {len(CELLS)} + 1] WHEN 3 THEN o_totalprice::DECIMAL(18,2)::DOUBLE ELSE -(o_totalprice::DECIMAL(18,2)::DOUBLE) END::DOUBLE AS value FROM orders",
        "header_search": "SELECT n_nationkey, place::INT AS place, CASE place WHEN 0 THEN '项目' WHEN 6 THEN '' ELSE n_name END AS found FROM nation, range(7) r(place)",
        "note_tables": f"""SELECT lpad(n_nationkey::VARCHAR, 6, '0') AS stock_code, unnest([n_name, '其他']) AS label, {sql_of('n_nationkey', '', 'income', 'balance', 'cash_flow', '')} AS table_type FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)""",
        "cell_units": "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '万元' WHEN 1 THEN '元' ELSE CASE WHEN n_nationkey % 2 = 0 THEN '元' ELSE '千元' END END AS unit FROM nation",
        "period_scopes": f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'point_in_time' ELSE {sql_of('o_orderkey', 'full_year', 'year_to_date', 'single_period', 'year_to_date', 'unknown')} END AS scope FROM orders",
        "safe_select": "SELECT 0 AS statement, 'ok' AS outcome, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n UNION ALL SELECT range::INT, 'refused', NULL FROM range(1, 6)",
        "parsed_questions": _rows(
            "question, intent, metrics, years, periods, n, chart, missing, warnings",
            [
                (0, "metric_query", f"{core}total_operating_revenue", "2024", "FY", 100, None, None, 0),
                (1, "ranking_query", f"{core}net_profit_10k_yuan", "2024", "FY", 5, None, None, 1),
                (2, "ranking_query", f"{core}net_profit_10k_yuan", "2024", "FY", 10, None, None, 1),
                (3, "trend_query", f"{core}total_operating_revenue", "2023,2024,2025", "FY", 100, "line", None, 0),
                (4, "metric_query", f"{core}net_profit_excl_non_recurring", "2022,2023,2024,2025", "", 100, None, None, 0),
                (5, "unsupported", "", "", "", 100, None, "metric", 0),
                (6, "metric_query", f"{catalog.INCOME}.operating_profit", "2024", "Q3", 100, "bar", "company", 0),
                (7, "comparison_query", f"{core}gross_profit_margin", "2023", "FY", 100, None, None, 0),
            ],
        ),
        "model_replies": _rows(
            "reply, source, intent, metrics, codes, years, periods, n, descending",
            [
                (0, "llm", "metric_query", f"{core}total_operating_revenue", "600332", "2024", "FY", 500, "t"),
                (1, "llm", "ranking_query", f"{core}gross_profit_margin", "", "2023", "FY", 100, "f"),
                (2, "rule_fallback", "metric_query", f"{core}total_operating_revenue", "600332", "2024", "FY", 100, "t"),
                (3, "rule_fallback", "metric_query", f"{core}total_operating_revenue", "600332", "2024", "FY", 100, "t"),
            ],
        ).replace("'t')", "true)").replace("'f')", "false)"),
        "json_results": "SELECT lpad(n_nationkey::VARCHAR, 6, '0') AS stock_code, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey // 2)::VARCHAR ELSE (n_nationkey / 2.0::DOUBLE)::VARCHAR END AS shown, '万元' AS unit FROM nation",
        "rebuilt_runs": f"""{WITH_FACTS} SELECT report_year::INT AS run_id, target_field, count(*) AS n, round(sum(standard_value::DOUBLE * CASE WHEN report_year IN (1994, 1996) THEN 2 ELSE 1 END), 2) AS total FROM facts
WHERE report_year NOT IN (1994, 1996) OR target_field = 'revenue' GROUP BY ALL""",
        "stored_pages": "SELECT doc_id::INT AS page_number, source AS text, CASE WHEN doc_id % 2 = 0 THEN '1~' || lang || ';2~' || lang ELSE '' END AS tables FROM documents WHERE doc_id % 3 = 1",
        "offset_pages": "SELECT doc_id, unnest(range(1, greatest(n_chars % 450, 1) + 1))::INT AS page_number FROM documents",
        "text_forms": """SELECT doc_id, 'a b' || chr(10) || chr(10) || source || ' x' AS tidy, source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) ELSE '' END || 'end' AS fields,
CASE WHEN doc_id % 2 = 0 THEN '现金流量表' ELSE '合并利润表 ' || lang END AS title, 'doc-' || md5(lang || '|' || source)[1:16] AS id FROM documents""",
        "report_lines": f"""WITH n AS (SELECT n_name, n_nationkey, {bar} AS bar FROM nation)
SELECT 'csv' AS kind, md5(n_name || ',' || n_nationkey || ',' || bar) AS tag FROM n UNION ALL SELECT 'csv', md5('n_name,n_nationkey,bar') UNION ALL
SELECT 'json', md5('{{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"bar":"' || bar || '"}}') FROM n UNION ALL
SELECT 'markdown', md5('| ' || n_name || ' | ' || n_nationkey || ' | ' || bar || ' |') FROM n UNION ALL SELECT 'markdown', md5('| n_name | n_nationkey | bar |') UNION ALL SELECT 'markdown', md5('| --- | --- | --- |') UNION ALL
SELECT 'text', md5('n_name: ' || n_name || '  n_nationkey: ' || n_nationkey || '  bar: ' || bar) FROM n""",
        "index_round_trip": """SELECT name, CASE WHEN name <> 'missing' THEN (SELECT count(*) FROM documents) END AS documents, CASE WHEN name <> 'missing' THEN (SELECT count(DISTINCT md5(text)) FROM documents) END AS texts,
CASE WHEN name = 'a' THEN (SELECT count(*) FROM embeddings) END AS vectors, CASE WHEN name <> 'missing' THEN (SELECT count(*) FROM documents) END AS chunks FROM (VALUES ('a'), ('b'), ('missing')) t(name)""",
        "blind_pairs": """WITH v AS (SELECT CASE WHEN source < lang THEN 'A' WHEN source > lang THEN 'B' ELSE 'T' END AS w FROM documents)
SELECT 'all' AS kind, count(*) AS total, count(*) FILTER (w = 'A') AS wins, count(*) FILTER (w = 'B') AS losses, count(*) FILTER (w = 'T') AS ties, round(count(*) FILTER (w = 'A') / count(*), 6) AS win_rate FROM v""",
        "whole_judgements": "SELECT user_id AS qid, count(*) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 50 = 0) = 0",
        "evidence": f"WITH {bm25}, t AS (SELECT qid, doc_id, source || ' is the source of document ' || doc_id AS s FROM bm JOIN documents USING (doc_id) WHERE rank <= 3) SELECT qid, doc_id, CASE WHEN length(s) > 30 THEN rtrim(s[1:29]) || '…' ELSE s END AS text FROM t",
        "chart_parts": """WITH n AS (SELECT n_nationkey, n_name, n_nationkey * 123.456::DOUBLE AS v, n_nationkey::DOUBLE AS a, (n_nationkey % 5)::DOUBLE AS b FROM nation),
r AS (SELECT *, CASE WHEN n_nationkey % 2 = 1 THEN least(0, a, b) ELSE least(a, b) END AS low0, CASE WHEN n_nationkey % 2 = 1 THEN greatest(0, a, b) ELSE greatest(a, b) END AS high0 FROM n)
SELECT n_nationkey::INT AS n_nationkey, CASE WHEN length(n_name) > 5 THEN n_name[1:4] || '…' ELSE n_name END AS label,
CASE WHEN v >= 1000 THEN format('{:,.0f}', v) ELSE rtrim(rtrim(printf('%.2f', v), '0'), '.') END AS tick, 'data:image/svg+xml;base64,' || base64(n_name::BLOB) AS url,
CASE WHEN low0 = high0 THEN low0 - greatest(abs(low0) * 0.05::DOUBLE, 1) ELSE low0 END::DOUBLE AS low, CASE WHEN low0 = high0 THEN high0 + greatest(abs(low0) * 0.05::DOUBLE, 1) ELSE high0 END::DOUBLE AS high FROM r""",
    }
