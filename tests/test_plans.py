import pytest
from pyspark.sql import functions as F

from tallyspark.facade import Engine, compact
from tallyspark.functions import catalog, scalars
from tallyspark.functions.calculator import CalculationError, compile_expression
from tallyspark.plans.dsl import Condition, Query, QueryError, Store, compiled, joined, safe_select, split
from tallyspark.plans.questions import Company, Memory, from_reply, parse, parse_with, step, to_query

COMPANIES = [Company("600332", "白云山", "广州白云山医药"), Company("300347", "泰格医药")]
YEAR = 2026
REVENUE = f"{catalog.CORE}.total_operating_revenue"
PROFIT = f"{catalog.CORE}.net_profit_10k_yuan"


@pytest.fixture(scope="module")
def store(spark):
    rows = [("600332", "白云山", y, p, float(v), float(v) / 10) for y, p, v in ((2023, "FY", 90), (2024, "FY", 100), (2024, "HY", 40))] + [("300347", "泰格医药", 2024, "FY", 300.0, 250.0), ("000001", "无", 2024, "FY", None, 1.0)]
    core = spark.createDataFrame(rows, "stock_code string, stock_abbr string, report_year int, report_period string, total_operating_revenue double, net_profit_10k_yuan double")
    balance = core.select("stock_code", "stock_abbr", "report_year", "report_period", F.col("total_operating_revenue").alias("asset_total_assets"))
    return Store({catalog.CORE: core, catalog.BALANCE: balance}, {catalog.CORE: ["total_operating_revenue", "net_profit_10k_yuan"], catalog.BALANCE: ["asset_total_assets"]})


def test_questions():
    s = parse("白云山2024年年报营收是多少", COMPANIES, YEAR)
    assert (s.intent, s.metrics, s.codes, s.years, s.periods, s.missing) == ("metric_query", (REVENUE,), ("600332",), (2024,), ("FY",), None)
    s = parse("2024年年报净利润最高的5家公司", COMPANIES, YEAR)
    assert (s.intent, s.limit, s.descending, s.metrics) == ("ranking_query", 5, True, (PROFIT,)) and s.warnings
    s = parse("2024年年报净利润超过200万的公司有哪些", COMPANIES, YEAR)
    assert s.conditions == (Condition(PROFIT, ">", 200.0),)
    assert parse("2024年年报净利润超过2亿的公司有哪些", COMPANIES, YEAR).conditions[0].value == 20_000
    assert parse("2024年净利润不超过3亿的公司", COMPANIES, YEAR).conditions[0].operator == "<="
    s = parse("白云山近三年营收趋势图", COMPANIES, YEAR)
    assert (s.intent, s.years, s.chart, s.periods) == ("trend_query", (2023, 2024, 2025), "line", ("FY",))
    s = parse("泰格医药2022-2025年各报告期扣非净利润", COMPANIES, YEAR)
    assert s.years == (2022, 2023, 2024, 2025) and s.periods == () and s.all_periods and s.missing is None
    assert parse("2024年半年度营收前3", COMPANIES, YEAR).periods == ("HY",)
    assert parse("2024年半年度营收前3", COMPANIES, YEAR, literal_periods=True).periods == ("FY", "HY")
    assert parse("你好", COMPANIES, YEAR).missing == "metric"


def test_two_turns():
    memory, s = step(Memory(), parse("2024年年报营收是多少", COMPANIES, YEAR))
    assert s.missing == "company" and memory.pending
    memory, s = step(memory, parse("白云山", COMPANIES, YEAR))
    assert s.missing is None and s.codes == ("600332",) and s.years == (2024,) and s.metrics == (REVENUE,) and memory.pending is None


def test_replies_are_checked():
    s = from_reply('```json\n{"metrics": ["营收", "x y z", 3], "company_codes": ["332", "600332"], "years": [2024, 1800, "a"], "periods": ["fy", "zz"], "limit": 9999, "metric_filters": [{"metric": "营收", "operator": "!=", "value": 1}, {"metric": "营收", "operator": ">", "value": "5"}]}\n```', "q", COMPANIES)
    assert (s.metrics, s.codes, s.years, s.periods, s.limit, s.conditions) == ((REVENUE,), ("600332",), (2024,), ("FY",), 500, (Condition(REVENUE, ">", 5.0),))
    assert from_reply("[1]", "q", COMPANIES) is None and from_reply("no", "q", COMPANIES) is None
    assert parse_with(lambda q: None, "白云山2024年营收", COMPANIES, YEAR).source == "rule_fallback"


def test_compiler(store):
    q = Query("ranking_query", ("营收",), years=(2024,), periods=("FY",), limit=2)
    assert [r["stock_code"] for r in compiled(q, store).collect()] == ["300347", "600332"]
    assert compiled(Query(metrics=("营收",), codes=("332", "600332"), years=(2024,), periods=("fy", "hy")), store).count() == 2
    for bad in (Query(periods=("FY",)), Query(metrics=("营收",)), Query(metrics=("营收", "asset_total_assets"), periods=("FY",)), Query(metrics=("zzz",), periods=("FY",)), Query(metrics=("营收",), periods=("FY",), conditions=(Condition("营收", "; drop", 1),))):
        with pytest.raises(QueryError):
            compiled(bad, store).count()
    parts = split(to_query(parse("白云山2024年年报营收和总资产", COMPANIES, YEAR)), store)
    assert [len(p.metrics) for p in parts] == [1, 1]


def test_parts_meet_before_the_limit(spark):
    rows = spark.range(1, 1201).select(F.format_string("%06d", "id").alias("stock_code"), F.lit(None).cast("string").alias("stock_abbr"), F.lit(2024).alias("report_year"), F.lit("FY").alias("report_period"), F.col("id").alias("x"), (-F.col("id")).alias("y"))
    rows = rows.withColumn("stock_code", F.when(F.col("x") < 1200, F.col("stock_code")))
    s = Store({"a": rows, "b": rows}, {"a": ["x"], "b": ["y"]})
    q = Query("comparison_query", ("x", "y"), years=(2024,), periods=("FY",), limit=500)
    assert [tuple(r) for r in joined(q, s).collect()] == [(f"{i:06d}", 2024, "FY", i, -i) for i in range(1, 501)]
    few = Store({t: rows.where("x > 1190") for t in ("a", "b")}, s.metrics)
    assert [tuple(r) for r in joined(q, few).collect()] == [(f"{i:06d}" if i < 1200 else None, 2024, "FY", i, -i) for i in range(1191, 1201)]


def test_plan_is_a_top_n(store):
    plan = compiled(Query("ranking_query", ("营收",), years=(2024,), periods=("FY",), limit=2), store)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_safe_select(spark, store):
    store.tables[catalog.CORE].createOrReplaceTempView("facts_view")
    assert safe_select(spark, "select stock_code from facts_view where report_year = 2024", {"facts_view"}).count() == 4
    for bad in ("drop view facts_view", "select * from other", "select 1; select 2", "select * from facts_view where stock_code in (select stock_code from other)", "insert into facts_view values (1)"):
        with pytest.raises(Exception):  # noqa: B017  a refusal of ours or of the parser
            safe_select(spark, bad, {"facts_view"})


def test_facade(spark, store):
    chunks = spark.createDataFrame([("c1", "d1", "600332", "白云山 营收 增长 good year"), ("c2", "d1", "600332", "nothing"), ("c3", "d2", "300347", "good outlook")], "chunk_id string, doc_id string, stock_code string, text string")
    e = Engine(spark, store, COMPANIES, chunks, this_year=YEAR)
    out = e.query("白云山2024年年报营收是多少")
    assert out["status"] == "ok_nonempty" and out["results"][0]["rows"][0]["total_operating_revenue"] == 100 and "100万元" in out["results"][0]["answer"]
    assert e.query("2024年年报营收是多少", "s")["slot"] == "company" and e.query("白云山", "s")["status"] == "ok_nonempty"
    assert "<svg" in e.query("白云山2023-2024年营收趋势图")["results"][0]["chart"]
    assert e.calculate("(a-b)/b*100", {"a": 120, "b": 100}) == {"result": 20.0} and e.calculate("median(xs)", {"xs": [3, 1, 2]}) == {"result": 2.0}
    assert "error" in e.calculate("__import__('os')") and "error" in e.calculate("1/0")
    assert [r["chunk_id"] for r in e.search("good outlook")][0] == "c3"
    assert "error" in e.tool_query(["营收"], [2024], ["FY"], ["999999"]) and e.tool_query(["营收"], [2024], ["FY"])["results"][0][0]["stock_code"] == "300347"
    assert [t["status"] for t in e.run_tools([("calculate", {"expression": "1+1"}), ("nope", {})])] == ["ok", "error"]
    assert e.analysis("白云山2024年年报营收")["evidence"][0]["stock_code"] == "600332"
    assert [e.route(q) for q in ("白云山2024年年报营收", "2024年营收是多少", "good outlook?")] == ["figures", "clarification", "texts"]
    moves = iter([{"tool": "calculate", "arguments": {"expression": "2*3"}}, {"answer": "6"}])
    out = e.agent(lambda m: next(moves), lambda m: None).run("q")
    assert out["answer"] == "6" and out["trace"][0]["result"] == {"result": 6.0}
    assert "100万元" in e.agent(lambda m: None, lambda m: None).run("白云山2024年年报营收是多少")["answer"]


def test_evidence_is_cut_and_on_one_line():
    found = compact([{"text": "a\n b " + "c" * 300, "rank": 1}] * 7 + [{"text": None}])
    assert len(found) == 5 and found[0]["text"].startswith("a b c") and len(found[0]["text"]) == 160 and found[0]["text"].endswith("…")


def test_calculator_refuses():
    for bad in ("a.b", "open('x')", "[x for x in y]", "lambda: 1", "1 if 2 else 3", "'s'", "x := 1", "sum(a, b)"):
        with pytest.raises(CalculationError):
            compile_expression(bad, {"a": F.lit(1.0), "b": F.lit(2.0)}) if False else compile_expression(bad, {})


@pytest.mark.parametrize("cell, want", [("1,234.50", 1234.5), ("(12.30)", -12.3), ("（12.3）", 12.3), ("十九、4", None), ("--", None), ("不适用", None), ("−5", -5), ("12%", 12), ("", None), ("(-3)", -3)])
def test_numeric(spark, cell, want):
    got = spark.createDataFrame([(cell,)], "c string").select(scalars.numeric(F.col("c")).cast("double")).first()[0]
    assert got == want


def test_scalars(spark):
    row = spark.createDataFrame([("二、其中：营业收入（元）", "2023-03-31", 150.0, 100.0)], "l string, d string, a double, b double").select(
        scalars.stock_code(F.lit("332")), scalars.stock_code(F.lit("1234567")), scalars.clean_label(F.lit("其中：利息收入（元")), scalars.growth(F.col("a"), F.col("b")), scalars.growth(F.lit(-30.0), F.lit(-60.0)), scalars.growth(F.lit(10.0), F.lit(0.0)),
        scalars.disclosed_year(F.to_date("d")), scalars.fits(F.lit(1000000), 10, 4), scalars.shown_value(F.lit(1234.5), F.lit("元")), scalars.chart_number(F.lit(2.5)), scalars.plain_number(F.lit("10.500")), scalars.fenced_json(F.lit('```json\n{"a":1}\n```')), scalars.fenced_json(F.lit("[1]")),
    ).first()
    assert list(row) == ["000332", "1234567", "利息收入", 50.0, 50.0, None, 2022, None, "1,234.5元", "2.5", "10.5", '{"a":1}', None]
