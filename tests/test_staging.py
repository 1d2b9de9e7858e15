from decimal import Decimal

import pytest

from tallyspark.functions import catalog
from tallyspark.operators import facts
from tallyspark.operators.staging import staging_facts
from tallyspark.sources.panel import TABLE_TYPE

SCHEMA = "document_id long, stock_code string, report_year int, report_period string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLE_TYPE)


CASES = []


def case(rows, title="", year=2024, period="FY", code="600332", markdown="", page_text=""):
    """Registers a document; the decorated check gets its facts from the one run over all documents."""

    def keep(check):
        CASES.append((check.__name__, rows if rows and isinstance(rows[0], tuple) else [(title, rows)], year, period, code, markdown, page_text, check))

    return keep


def value(found, field, table=None):
    rows = [r for (t, f), r in found.items() if f == field and table in (None, t)]
    return rows[0]["standard_value"]


@case([["项目", "本期发生额", "上期发生额"], ["营业总收入", "123456789", "100"], ["利润总额", "2000000", "100"]], "合并利润表 单位：元")
def units_and_backfill(f):
    assert {k[1] for k in f} == {"total_operating_revenue", "total_profit"}
    r = f[(catalog.INCOME, "total_operating_revenue")]
    assert r["standard_value"] == Decimal("12345.6789") and r["period_scope"] == "full_year" and r["source_period_label"] == "本期发生额" and r["confidence"] == Decimal("0.9")
    assert f[(catalog.CORE, "total_operating_revenue")]["is_derived"] and value(f, "total_profit") == 200


@case([["项目", "附注十七", "2022年度", "2021年度"], ["一、营业收入", "4", "551,521,552.72", "441,414,818.52"]], "利润表", 2022, code="603127")
def note_column_is_skipped(f):
    r = f[(catalog.INCOME, "total_operating_revenue")]
    assert r["standard_value"] == Decimal("55152.155272") and r["source_period_label"] == "2022年度"


@case([["项目", "期末余额"], ["流动资产合计", "100"], ["资产总计", "300"], ["流动负债合计", "40"], ["负债合计", "120"]], "合并资产负债表")
def totals_not_subtotals(f):
    assert {f[k]["source_label"] for k in f if not f[k]["is_derived"]} == {"资产总计", "负债合计"}
    assert value(f, "asset_liability_ratio") == 40


@case([["项目", "中国区实验室服务", "美国区实验室服务"], ["营业利润", "100", "200"]])
def columns_without_periods_give_nothing(f):
    assert f == {}


@case([["项目", "本期"], ["营业利润", "100"]], markdown="合营企业 持股比例 账面价值")
def detail_tables_give_nothing(f):
    assert f == {}


@case([["项目", "本期发生额"], ["营业总收入", "1"]], "合并利润表", code="000000")
def unknown_company(f):
    assert f == {}


rows_mixed_statement = [["项目", "本期发生额"], ["营业总收入", "300000000"], ["净利润", "120000000"], ["经营活动产生的现金流量净额", "80000000"], ["现金及现金等价物净增加额", "50000000"]]


@case(rows_mixed_statement, "合并利润表 合并现金流量表")
def mixed_statement(f):
    assert [value(f, k, t) for t, k in ((catalog.INCOME, "total_operating_revenue"), (catalog.INCOME, "net_profit"), (catalog.CASH, "operating_cf_net_amount"), (catalog.CASH, "net_cash_flow"))] == [30000, 12000, 8000, 5000]
    assert value(f, "operating_cf_ratio_of_net_cf") == 160


rows_default_unit_and_offset_columns = [["", "项目", "", "", "2024年12月31日", ""], ["", "货币资金", "", "5,289,594,427.89", "", ""], ["", "资产总计", "", "12,610,011,324.42", "", ""]]


@case(rows_default_unit_and_offset_columns, "合并资产负债表")
def default_unit_and_offset_columns(f):
    assert value(f, "asset_cash_and_cash_equivalents") == Decimal("528959.442789") and value(f, "asset_total_assets") == Decimal("1261001.132442")


rows_labels_split_over_rows = [
    ["主要会计数据", "", "2024年", "", "本年比上年增减"],
    ["营业收入（元）", "", "10,255,325,392.82", "", "121.08%"],
    ["归属于上市公司股东", "", "3,301,635,019.64", "", "208.77%"],
    ["的净利润（元）", "", "", "", ""],
    ["经营活动产生的现金", "", "3,286,910,705.82", "", "10%"],
    ["流量净额（元）", "", "", "", ""],
]


@case(rows_labels_split_over_rows, "主要会计数据")
def labels_split_over_rows(f):
    assert value(f, "total_operating_revenue", catalog.CORE) == Decimal("1025532.539282") and value(f, "operating_revenue_yoy_growth", catalog.CORE) == Decimal("121.08")
    assert value(f, "net_profit_10k_yuan") == Decimal("330163.501964") and value(f, "net_profit_yoy_growth", catalog.CORE) == Decimal("208.77")
    assert value(f, "operating_cf_net_amount") == Decimal("328691.070582")


core_equal_fields_are_aligned = [["主要会计数据", "2024年", "同比增减"], ["归属于上市公司股东的净利润", "40718459.76", "61.16%"]]
income_equal_fields_are_aligned = [["项目", "本期发生额"], ["净利润", "-3103474.35"]]


@case([("主要会计数据 单位：元", core_equal_fields_are_aligned), ("合并利润表 单位：元", income_equal_fields_are_aligned)])
def equal_fields_are_aligned(f):
    r = f[(catalog.INCOME, "net_profit")]
    assert r["standard_value"] == Decimal("4071.845976") and r["is_derived"] and value(f, "net_profit_yoy_growth", catalog.INCOME) == Decimal("61.16")


balance_derivations = [["项目", "期末余额"], ["资产总计", "3000000000"], ["负债合计", "1200000000"], ["归属于母公司所有者权益合计", "1500000000"], ["股本", "500000000"]]
income_derivations = [["项目", "本期发生额"], ["营业总收入", "200000000"], ["营业成本", "120000000"], ["销售费用", "10000000"], ["管理费用", "8000000"], ["财务费用", "2000000"], ["研发费用", "30000000"], ["税金及附加", "1000000"]]
cash_derivations = [["项目", "本期发生额"], ["经营活动产生的现金流量净额", "100000000"], ["投资活动产生的现金流量净额", "-40000000"], ["筹资活动产生的现金流量净额", "20000000"], ["现金及现金等价物净增加额", "80000000"]]


@case([("合并资产负债表 单位：元", balance_derivations), ("合并利润表 单位：元", income_derivations), ("合并现金流量表 单位：元", cash_derivations)])
def derivations(f):
    want = {"gross_profit_margin": 40, "asset_liability_ratio": 40, "net_asset_per_share": 3, "total_operating_expenses": 17100, "operating_cf_ratio_of_net_cf": 125}
    assert {k: value(f, k) for k in want} == want


rows_first_of_equals_and_parent_statement = [("合并利润表", [["项目", "本期"], ["净利润", "1"], ["净利润", "2"]]), ("母公司利润表", [["项目", "本期"], ["净利润", "9"]]), ("利润表", [["项目", "本期"], ["净利润", "3"]])]


@case(rows_first_of_equals_and_parent_statement, page_text="x")
def first_of_equals_and_parent_statement(f):
    assert value(f, "net_profit") == Decimal("0.0001")


@pytest.fixture(scope="module")
def found(spark):
    data = [(d, code, year, period, i + 1, 1, t, markdown, page, r) for d, (_, tables, year, period, code, markdown, page, _) in enumerate(CASES) for i, (t, r) in enumerate(tables)]
    known = spark.createDataFrame([("600332", "白云山"), ("603127", "昭衍新药")], "stock_code string, stock_abbr string")
    out = [{} for _ in CASES]
    for r in staging_facts(spark.createDataFrame(data, SCHEMA), known).collect():
        out[r["document_id"]][(r["target_table"], r["target_field"])] = r
    return out


@pytest.mark.parametrize("number", range(len(CASES)), ids=[c[0] for c in CASES])
def test_document(found, number):
    CASES[number][-1](found[number])


def facts_frame(spark, rows):
    return spark.createDataFrame([(1, c, y, p, t, f, None if v is None else Decimal(v), "万元", "full_year" if s is None else s, d, Decimal("0.9"), "2024年", 1, 1) for c, y, p, t, f, v, s, d in rows], "run_id long, stock_code string, report_year int, report_period string, target_table string, target_field string, standard_value decimal(24,6), standard_unit string, period_scope string, is_derived boolean, confidence decimal(8,6), source_period_label string, page_number int, table_index int")


def test_growth(spark):
    c, r = catalog.CORE, "total_operating_revenue"
    f = facts_frame(spark, [("a", 2023, "FY", c, r, 100, None, False), ("a", 2024, "FY", c, r, 200, None, False), ("b", 2024, "Q2", c, r, 100, "single_period", False), ("b", 2024, "Q3", c, r, 150, "single_period", False), ("d", 2023, "FY", c, r, -40, None, False), ("d", 2024, "FY", c, r, 80, None, False), ("e", 2023, "FY", c, r, 0, None, False), ("e", 2024, "FY", c, r, 9, None, False)])
    got = {(x["stock_code"], x["target_field"]): x["standard_value"] for x in facts.growth_facts(f).collect()}
    assert got == {("a", "operating_revenue_yoy_growth"): 100, ("b", "operating_revenue_qoq_growth"): 50, ("d", "operating_revenue_yoy_growth"): 300}


def test_validation_and_promotion(spark):
    f = facts_frame(spark, [("a", 2024, "FY", catalog.CORE, "total_operating_revenue", 100, None, False), ("a", 2024, "FY", catalog.CORE, "operating_revenue_yoy_growth", 1000000, None, False), ("a", 2024, "FY", catalog.CORE, "roe", None, None, True)])
    runs = spark.createDataFrame([(1, 2, 2, 1), (2, 5, 4, 0)], "run_id long, page_count int, pages int, tables int")
    issues = facts.issues_of(f, runs)
    names = {(r["run_id"], r["rule_name"]) for r in issues.collect()}
    assert {(2, "raw_page_count_match"), (2, "raw_tables_present"), (2, "staging_rows_present"), (1, "standard_value_present"), (1, "core_field_present"), (1, "standard_unit_match")} <= names
    assert {r["run_id"]: r["status"] for r in facts.run_status(runs, issues).collect()} == {1: "fail", 2: "fail"}
    clean = f.where("standard_value is not null")
    companies = spark.createDataFrame([("a", "A co")], "stock_code string, stock_abbr string")
    first = facts.promote(spark, clean, runs, companies, {})
    row = first[catalog.CORE].first()
    assert row["total_operating_revenue"] == 100 and row["operating_revenue_yoy_growth"] is None and row["stock_abbr"] == "A co" and row["serial_number"] == 1
    again = facts.promote(spark, clean, runs, companies, first)[catalog.CORE]
    assert [tuple(r) for r in again.collect()] == [tuple(row)]
    cov = {r["run_id"]: (round(r["field_ratio"], 6), round(r["required_ratio"], 6)) for r in facts.coverage(clean, runs).collect()}
    assert cov == {1: (round(2 / 60, 6), round(1 / 17, 6)), 2: (0.0, 0.0)}


def test_merge_keeps_or_takes_nulls(spark):
    old = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int")
    new = spark.createDataFrame([("a", None, 9), ("c", 5, None)], "k string, x int, y int")
    assert sorted(map(tuple, facts.merged(old, new, ["k"]).collect())) == [("a", 1, 9), ("b", 3, 4), ("c", 5, None)]
    assert sorted(map(tuple, facts.merged(old, new, ["k"], keep_nulls=True).collect())) == [("a", None, 9), ("b", 3, 4), ("c", 5, None)]
