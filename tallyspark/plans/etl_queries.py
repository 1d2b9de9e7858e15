"""Registered queries on statement tables, report texts, companies, validation and stores, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import catalog, report_names, scalars
from tallyspark.operators import companies, evaluation, facts, retrieval, staging, texts
from tallyspark.plans import text_queries
from tallyspark.plans.panel_queries import WITH_FACTS, WITH_WIDE, doubles
from tallyspark.sources import files, panel, sinks

KEY = panel.KEY
#: The panel's years begin in 1992; headers are read as dates only from 2000 on.
LATER = 30


def statement_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raw tables for each company and year: an income statement in 元 with a note column and ragged and blank rows,
    and a balance sheet in 万元 whose columns change places half-way and whose last label takes two rows."""
    w = panel.wide_facts(spark, sf_dir).where("report_period = 'FY'")
    whole = [F.floor(c).cast("long").alias(c) for c in panel.PANEL_METRICS]
    w = w.select("stock_code", (F.col("report_year") + LATER).cast("int").alias("report_year"), "report_period", *whole)
    n = lambda c: F.col(c).cast("string")
    year, before = F.col("report_year").cast("string"), (F.col("report_year") - 1).cast("string")
    word = F.lit
    line = lambda *cells: F.array(*[c if isinstance(c, Column) else F.lit(c) for c in cells])
    dated = [F.concat(y, word("年12月31日")) for y in (year, before)]
    income = F.array(
        line("项目", "附注", F.concat(year, word("年度")), F.concat(before, word("年度"))),
        line("一、营业总收入", "5", n("revenue"), "1"),
        line("其中：营业成本（元）", "", n("cost")),
        line(" ", "", ""),
        line("三、税金及附加", "", n("tax"), ""),
    )
    q = lambda k: (F.col("quantity") * k).cast("string")
    balance = F.array(
        line("项目", *dated),
        line("资产总计", q(10), q(9)),
        line("", dated[1], dated[0]),
        line("负债合计", q(3), q(4)),
        line("归属于上市公司股东", q(5), q(6)),
        line("的所有者权益", "", ""),
    )
    two = F.array(
        F.struct(F.lit(1).alias("page_number"), F.lit(1).alias("table_index"), F.lit("合并利润表 单位：元").alias("section_title"), income.alias("rows")),
        F.struct(F.lit(2).alias("page_number"), F.lit(2).alias("table_index"), F.lit("合并资产负债表 单位：万元").alias("section_title"), balance.alias("rows")),
    )
    key = F.xxhash64("stock_code", "report_year").alias("document_id")
    return w.select(key, *KEY, F.inline(two)).withColumns({"markdown": F.lit(""), "page_text": F.lit("")})


def split_label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the statement tables padded to one width, without blank ones, continued labels joined."""
    rows = staging.table_rows(statement_tables(spark, sf_dir))
    return rows.select("stock_code", "report_year", "table_index", "row_pos", "label", F.size("row").alias("width"), "raw_unit")


def header_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with the kind of their table and the header that holds for them."""
    rows = staging.typed_rows(staging.table_rows(statement_tables(spark, sf_dir)))
    return rows.select("stock_code", "report_year", "table_index", "row_pos", "label", "table_type", F.get("header", F.lit(1)).alias("header"))


def statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of the statement tables: read, standardised, filled from the other table and derived."""
    found = staging.staging_facts(statement_tables(spark, sf_dir), panel.companies(spark, sf_dir))
    return found.select("stock_code", "report_year", "target_table", "target_field", F.col("standard_value").cast("double").alias("value"), "is_derived", "period_scope", "standard_unit")


def catalogue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long facts under names of the catalogue, with units, labels, pages and runs by year that break some rules."""
    to = {"revenue": (catalog.CORE, "total_operating_revenue"), "cost": (catalog.INCOME, "operating_expense_cost_of_sales"), "tax": (catalog.INCOME, "operating_expense_taxes_and_surcharges"), "quantity": (catalog.BALANCE, "asset_total_assets")}
    names = F.create_map(*[x for m, (t, f) in to.items() for x in (F.lit(m), F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")))])
    m = F.col("target_field")
    f = panel.staging_facts(spark, sf_dir).withColumn("name", names[m])
    return f.select(
        F.col("report_year").cast("long").alias("run_id"),
        *KEY,
        F.col("name.t").alias("target_table"),
        F.col("name.f").alias("target_field"),
        F.when(~((m == "tax") & (F.col("report_year") == 1997)), F.col("standard_value")).alias("standard_value"),
        F.when(m == "cost", "元").otherwise("万元").alias("standard_unit"),
        F.when(m == "tax", "x").otherwise("本期").alias("source_period_label"),
        F.when(~((m == "quantity") & (F.col("report_year") == 1993)), 1).alias("page_number"),
        F.lit(1).alias("table_index"),
        F.when(F.col("report_period") == "FY", "full_year").otherwise("single_period").alias("period_scope"),
        "is_derived",
        F.lit(None).cast("string").alias("derivation_formula"),
        m.alias("source_label"),
        "confidence",
        F.col("run_id").alias("origin"),
    )


def runs_of(found: DataFrame) -> DataFrame:
    """A run for each year and one without facts."""
    y = F.col("run_id")
    years = found.select("run_id").distinct().select(y, F.lit(10).alias("page_count"), F.when(y % 2 == 0, 10).otherwise(9).alias("pages"), F.when(y == 1998, 0).otherwise(3).alias("tables"))
    return years.unionByName(found.sparkSession.createDataFrame([(9999, None, 1, 1)], "run_id long, page_count int, pages int, tables int"))


def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogue_facts(spark, sf_dir)
    return facts.issues_of(found, runs_of(found)).groupBy("run_id", "rule_name", "status").agg(F.count("*").alias("n"))


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogue_facts(spark, sf_dir)
    runs = runs_of(found)
    return facts.gate(runs, facts.issues_of(found, runs))


def coverage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogue_facts(spark, sf_dir)
    ratios = facts.coverage(found, runs_of(found))
    return ratios.select("run_id", F.round("field_ratio", 6).alias("field_ratio"), F.round("required_ratio", 6).alias("required_ratio"))


def growth_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of every company's revenue against the best fact of the prior period, by year and by quarter."""
    found = catalogue_facts(spark, sf_dir).where(F.col("target_table") == catalog.CORE).withColumn("run_id", F.col("origin"))
    return doubles(facts.growth_facts(found).select(*KEY, "target_field", F.col("standard_value").alias("growth")))


def equivalent_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net profit of the core table over that of the income sheet (even years differ, every third lacks it); revenue fills only."""
    w = panel.wide_facts(spark, sf_dir).where("report_period = 'FY'")
    y = F.col("report_year")
    v = lambda c: F.col(c).cast("decimal(24,6)")
    rows = [
        (catalog.CORE, "net_profit_10k_yuan", v("cost")),
        (catalog.INCOME, "net_profit", F.when(y % 3 != 0, F.when(y % 2 == 0, v("tax")).otherwise(v("cost")))),
        (catalog.INCOME, "total_operating_revenue", v("revenue")),
        (catalog.CORE, "total_operating_revenue", F.when(y % 2 == 0, v("quantity"))),
    ]
    listed = F.array(*[F.struct(F.lit(t).alias("target_table"), F.lit(f).alias("target_field"), value.alias("standard_value")) for t, f, value in rows])
    given = w.select(F.xxhash64("stock_code", "report_year").alias("document_id"), *KEY, F.inline(listed)).where("standard_value is not null")
    none = F.lit(None).cast("string")
    full = given.select(
        *staging.DOCUMENT, "target_table", "target_field", F.lit("x").alias("source_label"), none.alias("raw_value"), F.lit("万元").alias("raw_unit"), "standard_value", F.lit("万元").alias("standard_unit"),
        F.lit("full_year").alias("period_scope"), none.alias("source_period_label"), F.lit(False).alias("is_derived"), none.alias("derivation_formula"), F.lit(1).alias("page_number"), F.lit(1).alias("table_index"),
        F.lit(0.9).cast("decimal(8,6)").alias("confidence"),
    )
    return doubles(staging.reconciled(full).select(*KEY, "target_table", "target_field", "standard_value", "is_derived"))


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows overwritten whole by key, nulls included."""
    wide = panel.wide_facts(spark, sf_dir)
    current = wide.where("report_period in ('FY', 'Q1')").select(*KEY, "revenue", "cost")
    fresh = wide.where("report_period in ('FY', 'Q2')").select(*KEY, (F.col("revenue") * 2).cast(panel.MONEY).alias("revenue"), F.when(F.col("report_year") % 2 == 1, F.col("cost")).alias("cost"))
    return doubles(facts.merged(current, fresh, KEY, keep_nulls=True))


def mapping_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.mapping_log(catalogue_facts(spark, sf_dir)).groupBy("target_table", "target_field", "source_label", "method").agg(F.count("*").alias("n"))


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.with_metadata(panel.read(spark, sf_dir, "events").select("event_id", "props"), "props", "promotion", "done")


def assigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = panel.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return sinks.with_ids(panel.read(spark, sf_dir, "region").select(F.col("r_name").alias("name")), current, "id", ["name"])


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_queries.documents(spark, sf_dir).select("doc_id", F.col("n_chars").cast("int").alias("pages"))
    return files.page_ranges(d, "pages").select("doc_id", "first_page", "last_page")


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in markdown for each document: two pages with a table each, in one of them."""
    parts = [F.lit("lost"), F.lit("# Page 1"), F.concat(F.lit("## 合并利润表 "), F.col("lang")), F.lit("| a | b |"), F.col("lang"), F.lit(""), F.lit("## 第 2 页"), F.lit(""), F.lit("<table><tr><td>x</td></tr>"), F.lit("</table>"), F.col("source"), F.lit("")]
    return text_queries.documents(spark, sf_dir).select("doc_id", F.concat_ws("\n", *parts).alias("text"))


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the reports, with their text without tables and the statement that they name."""
    p = texts.pages(report_documents(spark, sf_dir))
    return p.select("doc_id", "page_number", F.col("text"), texts.without_tables(F.col("text")).alias("bare"), texts.section_title(F.col("text")).alias("section_title"))


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = report_documents(spark, sf_dir)
    return d.select("doc_id", texts.document_title(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("no heading"), F.concat(F.lit("stem-"), F.col("doc_id").cast("string"))).alias("title"))


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_queries.documents(spark, sf_dir)
    rows = F.array(F.array(F.lit("a|b"), F.col("source")), F.array(F.lit(""), F.col("lang")))
    return d.select("doc_id", texts.table_markdown(rows).alias("markdown"), texts.cell_text(F.concat(F.lit(" x\n"), F.col("lang"), F.lit("  y "))).alias("cell"))


def review_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panel.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("# review\n## q-"), F.col("item_id").cast("string"), F.lit("\n**问题**: x\n- [x] `doc-1` t\n- [ ] `doc-2` t\nother")).alias("text"))
    return texts.checklist(b, "doc_id", "text")


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels around a part's name cleaned, and their units under both readings."""
    p = panel.read(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey").cast("string")
    lead = F.element_at(F.array(*[F.lit(x) for x in ("一、", "（二）", "其中：", "3.", "")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    unit = F.element_at(F.array(*[F.lit(x) for x in ("亿元", "万元", "千元", "元/股", "%", "x")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    label = F.concat(lead, F.lit("利 润"), k, F.lit("（"), unit, F.lit("）"))
    inside = scalars.first_parenthesis(F.concat(F.lit("a("), unit, F.lit(")")))
    return p.select("o_orderkey", scalars.clean_label(label).alias("label"), inside.alias("inside"), scalars.unit_name(inside).alias("unit"), scalars.checked_unit(inside).alias("checked"), scalars.period_scope(F.when(F.col("o_orderkey") % 2 == 0, "balance_sheet").otherwise("x"), F.element_at(F.array(*map(F.lit, ("FY", "Q1", "HY", "Q3", "Q9"))), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("scope"))


def value_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders").select("o_orderkey")
    v = (F.col("o_orderkey").cast("decimal(18,2)") / 4).cast("decimal(18,2)")
    shown = scalars.shown_value(F.when(F.col("o_orderkey") % 5 != 0, v), F.lit("万元"))
    return o.select("o_orderkey", scalars.plain_number(v).alias("plain"), shown.alias("shown"), scalars.chart_number(v.cast("double")).alias("axis"), scalars.period_label(F.element_at(F.array(*map(F.lit, ("FY", "Q1", "HY", "Q3", "Q9"))), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("period"))


def fenced_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panel.read(spark, sf_dir, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit("[1]"))
    return e.select("event_id", F.get_json_object(scalars.fenced_json(reply), "$.k").try_cast("int").alias("k"))


def report_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company, year and period of reports by name and text: a title in the text wins, a code in the name does."""
    o = panel.read(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 4 < 3, F.concat(F.lit("r"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise("某公司2022年半年度报告")
    body = F.when(F.col("o_orderkey") % 3 == 0, "2021 年第三季度报告 2020年年度报告").when(F.col("o_orderkey") % 3 == 1, "证券代码： 000777").otherwise("2021")
    got = report_names.refined(report_names.file_report(name), body)
    kind = report_names.report_kind(F.lit(None).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "x"), F.lit(""), name)
    return o.select("o_orderkey", got.alias("r"), kind.alias("kind")).select("o_orderkey", "r.stock_code", "r.report_year", "r.report_period", "kind")


def company_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = panel.companies(spark, sf_dir)
    asked = panel.read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit(" "), F.lower("s_name")), F.lit("nobody"), F.lit(""))).alias("name"))
    return companies.resolved(asked, c)


def company_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders").join(panel.read(spark, sf_dir, "supplier"), F.col("o_custkey") == F.col("s_suppkey"), "left")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("about "), F.coalesce("s_name", F.lit("nobody")), F.lit(" today"))).when(F.col("o_orderkey") % 3 == 1, "证券代码:000777").otherwise("nothing")
    return companies.mentioned(o.select(F.col("o_orderkey").alias("doc_id"), said.alias("text")), panel.companies(spark, sf_dir))


def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = panel.read(spark, sf_dir, "nation")
    said = F.element_at(F.array(F.lit(" 营 收"), F.lit("roe"), F.lit("总资产"), F.col("n_name")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return catalog.canonical_keys(n.select("n_nationkey", said.alias("name")), "name").select("n_nationkey", "key")


def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = text_queries.slot_diff(spark, sf_dir).join(text_queries.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source"), "id")
    return evaluation.match_rates(compared.withColumn("differs", F.filter(F.split("differs", ","), lambda x: x != "")), "source")


def questions_taken_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First questions of sets that are JSON arrays in a cell; checks of data and, without an evidence word, mixed intents are left out."""
    o = panel.read(spark, sf_dir, "orders").select("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("数据校验", "多意图", "单意图"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    cell = F.concat(F.lit('[{"Q": " '), F.when(F.col("o_orderkey") % 2 == 0, "研报 ").otherwise("问 "), F.col("o_orderkey").cast("string"), F.lit('"}, {"Q": ""}, {"Q": "再问"}]'))
    rows = o.select(F.col("o_orderkey").cast("string").alias("编号"), kind.alias("问题类型"), cell.alias("问题"))
    return files.evidence_questions(files.asked_questions(rows), "研报").select("id", "turn", "question")


def coarse_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = {"bm25": text_queries.bm25_topk(spark, sf_dir), "vector": text_queries.second_channel(spark, sf_dir)}
    return evaluation.coarse_recall({how: retrieval.fused(channels, how) for how in ("weighted", "rrf")}, text_queries.golden(spark, sf_dir), (1, 3, 10))


def judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.judging_batches(text_queries.bm25_topk(spark, sf_dir), 4).select("qid", "doc_id", "batch")


def metadata_filter_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates filtered after ranking: two languages as codes, a part of the source's name as the industry."""
    found = text_queries.with_source(spark, sf_dir).select("qid", "doc_id", "rank", F.col("lang").alias("stock_code"), F.col("source").alias("industry_name"))
    return retrieval.matching(found, ["en", "de"], "1").select("qid", "doc_id", "rank")


def hybrid_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of both channels in threefold number fused, filtered by language, two of each source, the first eight."""
    d, q = text_queries.documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), text_queries.questions(spark, sf_dir)
    second = retrieval.keyword_overlap(d, q, retrieval.pool_sizes(8, False, True)[1])
    return retrieval.hybrid(d, q, 8, 2, "doc_id", "source", vector=second, condition=F.col("lang") == "en").select("qid", "doc_id", "rank")


OWN = (
    split_label_merge, header_forward_fill, statement_facts, validation_findings, promotion_gate, coverage_ratios, growth_latest_run, equivalent_fields, upsert_rows, mapping_log, metadata_merge, assigned_ids, page_ranges,
    markdown_pages, document_titles, markdown_tables, review_checklist, label_texts, value_formats, fenced_replies, report_file_names, company_lookup, company_mentions, canonical_keys, match_rates, questions_taken_apart,
    coarse_grid, judge_batches, metadata_filter_post, hybrid_pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OWN}


_STATEMENTS = """, s AS (SELECT stock_code, (report_year + 30)::INT AS report_year, floor(revenue)::BIGINT AS rev, floor(cost)::BIGINT AS cost, floor(tax)::BIGINT AS tax, floor(quantity)::BIGINT AS qty FROM wide WHERE report_period = 'FY')"""
_CATALOGUE = """, c AS (SELECT report_year::BIGINT AS run_id, stock_code, report_year, report_period, target_field AS m, is_derived, confidence,
  CASE target_field WHEN 'revenue' THEN 'core_performance_indicators_sheet' WHEN 'quantity' THEN 'balance_sheet' ELSE 'income_sheet' END AS target_table,
  CASE target_field WHEN 'revenue' THEN 'total_operating_revenue' WHEN 'cost' THEN 'operating_expense_cost_of_sales' WHEN 'tax' THEN 'operating_expense_taxes_and_surcharges' ELSE 'asset_total_assets' END AS target_field,
  CASE WHEN NOT (target_field = 'tax' AND report_year = 1997) THEN standard_value END AS standard_value FROM facts),
runs AS (SELECT DISTINCT run_id FROM c UNION ALL SELECT 9999)"""
_ROUNDED_UNIT = "['亿元', '万元', '千元', '元/股', '%', 'x'][o_orderkey % 6 + 1]"
_FY = "['FY', 'Q1', 'HY', 'Q3', 'Q9'][o_orderkey % 5 + 1]"


def oracle_sql() -> dict[str, str]:
    bm25, second, gold = text_queries._BM25, text_queries._SECOND, text_queries._GOLD
    facts_sql, wide_sql = f"{WITH_FACTS}{_CATALOGUE}", f"{WITH_WIDE}{_STATEMENTS}"
    page = "'# Page 1' || chr(10) || '## 合并利润表 ' || lang"
    return {
        "split_label_merge": f"""{wide_sql}, r AS (SELECT stock_code, report_year, unnest([
 {{'table_index': 1, 'row_pos': 0, 'label': '项目', 'width': 4, 'raw_unit': '元'}}, {{'table_index': 1, 'row_pos': 1, 'label': '营业总收入', 'width': 4, 'raw_unit': '元'}},
 {{'table_index': 1, 'row_pos': 2, 'label': '营业成本', 'width': 4, 'raw_unit': '元'}}, {{'table_index': 1, 'row_pos': 3, 'label': '税金及附加', 'width': 4, 'raw_unit': '元'}},
 {{'table_index': 2, 'row_pos': 0, 'label': '项目', 'width': 3, 'raw_unit': '万元'}}, {{'table_index': 2, 'row_pos': 1, 'label': '资产总计', 'width': 3, 'raw_unit': '万元'}},
 {{'table_index': 2, 'row_pos': 2, 'label': '', 'width': 3, 'raw_unit': '万元'}}, {{'table_index': 2, 'row_pos': 3, 'label': '负债合计', 'width': 3, 'raw_unit': '万元'}},
 {{'table_index': 2, 'row_pos': 4, 'label': '归属于上市公司股东的所有者权益', 'width': 3, 'raw_unit': '万元'}}], recursive := true) FROM s) SELECT * FROM r""",
        "header_forward_fill": f"""{wide_sql}, r AS (SELECT stock_code, report_year, unnest([
 {{'table_index': 1, 'row_pos': 1, 'label': '营业总收入', 'table_type': 'income', 'header': '附注'}}, {{'table_index': 1, 'row_pos': 2, 'label': '营业成本', 'table_type': 'income', 'header': '附注'}},
 {{'table_index': 1, 'row_pos': 3, 'label': '税金及附加', 'table_type': 'income', 'header': '附注'}}, {{'table_index': 2, 'row_pos': 1, 'label': '资产总计', 'table_type': 'balance', 'header': report_year || '年12月31日'}},
 {{'table_index': 2, 'row_pos': 3, 'label': '负债合计', 'table_type': 'balance', 'header': (report_year - 1) || '年12月31日'}},
 {{'table_index': 2, 'row_pos': 4, 'label': '归属于上市公司股东的所有者权益', 'table_type': 'balance', 'header': (report_year - 1) || '年12月31日'}}], recursive := true) FROM s) SELECT * FROM r""",
        "statement_facts": f"""{wide_sql}, r AS (SELECT stock_code, report_year, unnest([
 {{'target_table': 'income_sheet', 'target_field': 'total_operating_revenue', 'v': rev / 10000, 'is_derived': false, 'period_scope': 'full_year', 'standard_unit': '万元'}},
 {{'target_table': 'income_sheet', 'target_field': 'operating_expense_cost_of_sales', 'v': cost / 10000, 'is_derived': false, 'period_scope': 'full_year', 'standard_unit': '万元'}},
 {{'target_table': 'income_sheet', 'target_field': 'operating_expense_taxes_and_surcharges', 'v': tax / 10000, 'is_derived': false, 'period_scope': 'full_year', 'standard_unit': '万元'}},
 {{'target_table': 'income_sheet', 'target_field': 'total_operating_expenses', 'v': (cost + tax) / 10000, 'is_derived': true, 'period_scope': 'full_year', 'standard_unit': '万元'}},
 {{'target_table': 'core_performance_indicators_sheet', 'target_field': 'total_operating_revenue', 'v': rev / 10000, 'is_derived': true, 'period_scope': 'full_year', 'standard_unit': '万元'}},
 {{'target_table': 'core_performance_indicators_sheet', 'target_field': 'gross_profit_margin', 'v': (rev - cost) / rev * 100, 'is_derived': true, 'period_scope': 'full_year', 'standard_unit': '%'}},
 {{'target_table': 'balance_sheet', 'target_field': 'asset_total_assets', 'v': qty * 10, 'is_derived': false, 'period_scope': 'point_in_time', 'standard_unit': '万元'}},
 {{'target_table': 'balance_sheet', 'target_field': 'liability_total_liabilities', 'v': qty * 4, 'is_derived': false, 'period_scope': 'point_in_time', 'standard_unit': '万元'}},
 {{'target_table': 'balance_sheet', 'target_field': 'equity_total_equity', 'v': qty * 6, 'is_derived': false, 'period_scope': 'point_in_time', 'standard_unit': '万元'}},
 {{'target_table': 'balance_sheet', 'target_field': 'asset_liability_ratio', 'v': 40, 'is_derived': true, 'period_scope': 'point_in_time', 'standard_unit': '%'}}], recursive := true) FROM s) SELECT * EXCLUDE v, v::DECIMAL(24,6)::DOUBLE AS value FROM r""",
        "validation_findings": f"""{facts_sql}, i AS (
 SELECT run_id, 'raw_page_count_match' AS rule_name, 'fail' AS status FROM runs WHERE run_id % 2 = 1 AND run_id <> 9999 UNION ALL SELECT run_id, 'raw_tables_present', 'fail' FROM runs WHERE run_id = 1998
 UNION ALL SELECT 9999, 'staging_rows_present', 'fail' UNION ALL SELECT run_id, 'standard_value_present', 'fail' FROM c WHERE standard_value IS NULL
 UNION ALL SELECT run_id, 'source_trace_present', 'fail' FROM c WHERE m = 'quantity' AND report_year = 1993 UNION ALL SELECT run_id, 'confidence_threshold', 'warn' FROM c WHERE confidence < 0.7
 UNION ALL SELECT run_id, 'standard_unit_match', 'warn' FROM c WHERE m = 'cost' UNION ALL SELECT run_id, 'source_period_label_plausible', 'warn' FROM c WHERE m = 'tax')
SELECT run_id, rule_name, status, count(*) AS n FROM i GROUP BY ALL UNION ALL SELECT run_id, 'core_field_present', 'warn', CASE run_id WHEN 9999 THEN 17 ELSE 15 END FROM runs""",
        "promotion_gate": f"{facts_sql} SELECT run_id FROM runs WHERE run_id % 2 = 0 AND run_id <> 1998",
        "coverage_ratios": f"{facts_sql} SELECT run_id, round((SELECT count(DISTINCT m) FROM c WHERE c.run_id = runs.run_id AND standard_value IS NOT NULL) / 60, 6) AS field_ratio, CASE run_id WHEN 9999 THEN 0 ELSE round(2 / 17, 6) END::DOUBLE AS required_ratio FROM runs",
        "growth_latest_run": f"""{facts_sql}, n AS (SELECT *, CASE WHEN report_period LIKE 'Q%' THEN report_year * 4 + report_period[2]::INT END AS q FROM long WHERE target_field = 'revenue'),
g AS (SELECT a.stock_code, a.report_year, a.report_period, 'operating_revenue_yoy_growth' AS target_field, a.standard_value AS x, b.standard_value AS y FROM n a JOIN n b ON a.stock_code = b.stock_code AND a.report_period = b.report_period AND a.report_year = b.report_year + 1
 UNION ALL SELECT a.stock_code, a.report_year, a.report_period, 'operating_revenue_qoq_growth', a.standard_value, b.standard_value FROM n a JOIN n b ON a.stock_code = b.stock_code AND a.q = b.q + 1)
SELECT stock_code, report_year, report_period, target_field, ((x::DOUBLE - y::DOUBLE) * 100 / abs(y::DOUBLE))::DECIMAL(24,6)::DOUBLE AS growth FROM g""",
        "equivalent_fields": f"""{WITH_WIDE}, w AS (SELECT * FROM wide WHERE report_period = 'FY'), r AS (
 SELECT *, 'core_performance_indicators_sheet' AS target_table, 'net_profit_10k_yuan' AS target_field, cost AS v, false AS is_derived FROM w
 UNION ALL SELECT *, 'income_sheet', 'net_profit', cost, report_year % 3 = 0 OR report_year % 2 = 0 FROM w
 UNION ALL SELECT *, 'income_sheet', 'total_operating_revenue', CASE WHEN report_year % 2 = 0 THEN quantity ELSE revenue END, report_year % 2 = 0 FROM w
 UNION ALL SELECT *, 'core_performance_indicators_sheet', 'total_operating_revenue', CASE WHEN report_year % 2 = 0 THEN quantity ELSE revenue END, report_year % 2 = 1 FROM w)
SELECT stock_code, report_year, report_period, target_table, target_field, v::DOUBLE AS standard_value, is_derived FROM r""",
        "upsert_rows": f"""{WITH_WIDE} SELECT stock_code, report_year, report_period, CASE report_period WHEN 'Q1' THEN revenue ELSE revenue * 2 END::DOUBLE AS revenue, CASE WHEN report_period = 'Q1' OR report_year % 2 = 1 THEN cost END::DOUBLE AS cost FROM wide WHERE report_period IN ('FY', 'Q1', 'Q2')""",
        "mapping_log": f"{facts_sql} SELECT target_table, target_field, m AS source_label, CASE WHEN is_derived THEN 'derived_formula' ELSE 'deterministic_alias' END AS method, count(*) AS n FROM c GROUP BY ALL",
        "metadata_merge": """SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","promotion":"done"}' AS props FROM events""",
        "assigned_ids": "SELECT r_name AS name, row_number() OVER (ORDER BY r_name) + (SELECT max(n_nationkey) FROM nation)::BIGINT AS id FROM region",
        "page_ranges": "WITH r AS (SELECT doc_id, greatest(n_chars, 1) AS n, unnest(range(1, greatest(n_chars, 1) + 1, 200)) AS p FROM documents) SELECT doc_id, p::INT AS first_page, least(p + 199, n)::INT AS last_page FROM r",
        "markdown_pages": f"""SELECT doc_id, 1 AS page_number, {page} || chr(10) || '| a | b |' || chr(10) || lang AS text, {page} || chr(10) || lang AS bare, '合并利润表 ' || lang AS section_title FROM documents
UNION ALL SELECT doc_id, 2, '## 第 2 页' || chr(10) || chr(10) || '<table><tr><td>x</td></tr>' || chr(10) || '</table>' || chr(10) || source, '## 第 2 页' || chr(10) || chr(10) || chr(10) || source, NULL FROM documents""",
        "document_titles": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Page 1' ELSE 'stem-' || doc_id END AS title FROM documents",
        "markdown_tables": r"SELECT doc_id, '| a\|b | ' || source || ' |' || chr(10) || '| --- | --- |' || chr(10) || '|  | ' || lang || ' |' AS markdown, 'x ' || lang || ' y' AS cell FROM documents",
        "review_checklist": "SELECT item_id AS doc_id, 'q-' || item_id AS question_id, 'doc-1' AS doc, true AS confirmed FROM benchmark UNION ALL SELECT item_id, 'q-' || item_id, 'doc-2', false FROM benchmark",
        "label_texts": f"""SELECT o_orderkey, '利润' || o_orderkey AS label, {_ROUNDED_UNIT} AS inside, CASE o_orderkey % 6 WHEN 3 THEN '元' ELSE {_ROUNDED_UNIT} END AS unit, CASE o_orderkey % 6 WHEN 1 THEN '万元' WHEN 4 THEN '%' WHEN 5 THEN 'x' ELSE '元' END AS checked,
 CASE WHEN o_orderkey % 2 = 0 THEN 'point_in_time' ELSE ['full_year', 'single_period', 'year_to_date', 'year_to_date', 'unknown'][o_orderkey % 5 + 1] END AS scope FROM orders""",
        "value_formats": f"""WITH v AS (SELECT o_orderkey, (o_orderkey // 4)::BIGINT AS w, ['', '.25', '.5', '.75'][o_orderkey % 4 + 1] AS f, o_orderkey / 4 AS x FROM orders)
SELECT o_orderkey, w || f AS plain, CASE WHEN o_orderkey % 5 = 0 THEN '暂无数据' ELSE format('{{:,}}', w) || f || '万元' END AS shown, CASE WHEN x >= 1000 THEN format('{{:,}}', round_even(x, 0)::BIGINT) ELSE w || f END AS axis, ['年报', '第一季度', '半年度', '第三季度', 'Q9'][o_orderkey % 5 + 1] AS period FROM v""",
        "fenced_replies": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k')::INT END AS k FROM events",
        "report_file_names": """WITH f AS (SELECT *, o_orderkey % 4 < 3 AS coded, (year(o_orderdate) - (month(o_orderdate) <= 4)::INT)::INT AS y, CASE WHEN month(o_orderdate) <= 4 THEN 'FY' WHEN month(o_orderdate) <= 8 THEN 'HY' WHEN month(o_orderdate) <= 10 THEN 'Q3' ELSE 'FY' END AS p FROM orders)
SELECT o_orderkey, CASE WHEN coded THEN lpad((o_custkey % 10000)::VARCHAR, 6, '0') WHEN o_orderkey % 3 = 1 THEN '000777' END AS stock_code, CASE WHEN o_orderkey % 3 = 0 THEN 2020 WHEN coded THEN y ELSE 2022 END::INT AS report_year,
 CASE WHEN o_orderkey % 3 = 0 THEN 'FY' WHEN coded THEN p ELSE 'HY' END AS report_period, 'stock' AS kind FROM f""",
        "company_lookup": """SELECT s_suppkey, s_suppkey::VARCHAR AS name, lpad(s_suppkey::VARCHAR, 6, '0') AS stock_code FROM supplier UNION ALL SELECT s_suppkey, ' ' || lower(s_name), lpad(s_suppkey::VARCHAR, 6, '0') FROM supplier
UNION ALL SELECT s_suppkey, 'nobody', NULL FROM supplier UNION ALL SELECT s_suppkey, '', NULL FROM supplier""",
        "company_mentions": "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN lpad(s_suppkey::VARCHAR, 6, '0') WHEN 1 THEN '000777' END AS stock_code FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey",
        "canonical_keys": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'core_performance_indicators_sheet.total_operating_revenue' WHEN 1 THEN 'core_performance_indicators_sheet.roe' WHEN 2 THEN 'balance_sheet.asset_total_assets' ELSE 'unresolved:' || n_name END AS key FROM nation",
        "match_rates": "SELECT source, count(*) AS total, count(*) FILTER (doc_id % 10 <> 3 AND doc_id % 4 <> 0) AS matched, round(count(*) FILTER (doc_id % 10 <> 3 AND doc_id % 4 <> 0) / count(*), 6) AS rate FROM documents GROUP BY ROLLUP (source)",
        "questions_taken_apart": "SELECT o_orderkey::VARCHAR AS id, 1 AS turn, CASE WHEN o_orderkey % 2 = 0 THEN '研报 ' ELSE '问 ' END || o_orderkey AS question FROM orders WHERE o_orderkey % 3 = 2 OR o_orderkey % 3 = 1 AND o_orderkey % 2 = 0",
        "coarse_grid": f"""WITH {bm25}{second}{gold}, u AS (SELECT qid, doc_id, 'bm25' AS c, score, rank FROM bm UNION ALL SELECT qid, doc_id, 'vector', score, rank FROM se),
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, round(sum(CASE c WHEN 'bm25' THEN 0.45::DOUBLE ELSE 0.55::DOUBLE END * score), 9) AS weighted FROM u GROUP BY qid, doc_id),
o AS (SELECT qid, doc_id, 'rrf' AS fusion, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id) AS r FROM f UNION ALL SELECT qid, doc_id, 'weighted', row_number() OVER (PARTITION BY qid ORDER BY weighted DESC, doc_id) FROM f),
g AS (SELECT qid, doc_id, fusion, k::INT AS k FROM gold, (SELECT unnest(['rrf', 'weighted']) AS fusion), (SELECT unnest([1, 3, 10]) AS k)),
q AS (SELECT qid, fusion, k, count(*) AS n, count(r) FILTER (r <= k) AS hit FROM g LEFT JOIN o USING (qid, doc_id, fusion) GROUP BY ALL) SELECT fusion, k, round(avg(hit / n), 6) AS recall FROM q GROUP BY ALL""",
        "judge_batches": f"WITH {bm25} SELECT qid, doc_id, ((rank - 1) // 4)::INT AS batch FROM bm",
        "metadata_filter_post": f"WITH {bm25} SELECT qid, doc_id, rank FROM bm JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') AND contains(source, '1')",
        "hybrid_pipeline": f"""WITH {bm25}, one AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0),
shared AS (SELECT qid, doc_id, count(*) AS score FROM (SELECT DISTINCT doc_id, token FROM toks) JOIN (SELECT DISTINCT qid, token FROM qs) USING (token) WHERE length(token) > 1 GROUP BY ALL),
two AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM shared),
fused AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (FROM one WHERE rank <= 600 UNION ALL FROM two WHERE rank <= 600) GROUP BY ALL),
pool AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fused),
f AS (SELECT qid, doc_id, source, rank, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS n FROM pool JOIN documents USING (doc_id) WHERE lang = 'en')
SELECT qid, doc_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM f WHERE n <= 2) WHERE r <= 8""",
    }
