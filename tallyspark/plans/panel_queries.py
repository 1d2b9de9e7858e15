"""Registered queries on companies and facts, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import scalars
from tallyspark.functions.calculator import compile_expression
from tallyspark.operators import evaluation, facts
from tallyspark.plans.dsl import Condition, Query, Store, compiled, joined, split
from tallyspark.plans.presentation import answer_rows, chart_series
from tallyspark.sources import panel

KEY = panel.KEY
METRICS = {"income_sheet": ["revenue", "cost", "tax"], "core_performance_indicators_sheet": ["quantity"]}


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, at the very end of a query."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


def store(spark: SparkSession, sf_dir: str) -> Store:
    wide = panel.wide_facts(spark, sf_dir).join(panel.companies(spark, sf_dir).select("stock_code", "stock_abbr"), "stock_code", "left")
    return Store({t: wide for t in METRICS}, METRICS, lambda m: "元")


POINT = Query(metrics=("revenue",), codes=("1", "7", "000009"), years=(1997,), periods=("FY",))
RANKING = Query("ranking_query", ("revenue",), years=(1997,), periods=("FY",), limit=10, order_by="revenue")
COMPILED = {
    "metric_point": POINT,
    "metric_multi_year": replace(POINT, metrics=("revenue", "cost"), years=(1996, 1997, 1998), limit=50),
    "metric_all_periods": replace(POINT, years=(), periods=(), all_periods=True, limit=500),
    "metric_filter_gt": replace(POINT, codes=(), conditions=(Condition("revenue", ">", 4_200_000),), limit=500),
    "metric_filter_and": replace(POINT, codes=(), metrics=("revenue", "tax"), conditions=(Condition("revenue", ">=", 4_000_000), Condition("tax", "<", 185_000)), limit=500),
    "metric_filter_ne": replace(POINT, codes=(), conditions=(Condition("revenue", "!=", 0),), limit=500),
    "ranking_topn_desc": RANKING,
    "ranking_topn_asc": replace(RANKING, descending=False),
    "ranking_multi_year": replace(RANKING, years=(1996, 1997), limit=15),
    "ranking_global": replace(RANKING, years=(), limit=15, rank_scope="global"),
    "order_fallback_code": replace(POINT, codes=(), order_by="quantity", limit=20),
}

_COMPANY = "company AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS stock_code, s_name AS stock_abbr, r_name AS exchange, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_WIDE = """lines AS (SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS stock_code, year(l_shipdate)::INT AS report_year, 'Q' || quarter(l_shipdate) AS report_period,
  (l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(12,2)))::DECIMAL(18,4) AS net, (l_extendedprice::DECIMAL(12,2) * l_tax::DECIMAL(12,2))::DECIMAL(18,4) AS tax, l_quantity::DECIMAL(12,2) AS quantity FROM lineitem),
quarters AS (SELECT stock_code, report_year, report_period, sum(net)::DECIMAL(18,4) AS revenue, sum((net * 0.6::DECIMAL(2,1))::DECIMAL(18,4))::DECIMAL(18,4) AS cost, sum(tax)::DECIMAL(18,4) AS tax, sum(quantity)::DECIMAL(18,4) AS quantity FROM lines GROUP BY ALL),
wide AS (SELECT * FROM quarters UNION ALL SELECT stock_code, report_year, 'FY', sum(revenue)::DECIMAL(18,4), sum(cost)::DECIMAL(18,4), sum(tax)::DECIMAL(18,4), sum(quantity)::DECIMAL(18,4) FROM quarters GROUP BY stock_code, report_year)"""
_LONG = """long AS (SELECT stock_code, report_year, report_period, target_field, standard_value, md5(stock_code || '|' || report_year || '|' || report_period || '|' || target_field) AS tag FROM (UNPIVOT wide ON revenue, cost, tax, quantity INTO NAME target_field VALUE standard_value)),
facts AS (SELECT 1::BIGINT AS run_id, stock_code, report_year, report_period, target_field, standard_value, false AS is_derived, CASE WHEN tag[1] < '4' THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence, tag FROM long
  UNION ALL SELECT 2, stock_code, report_year, report_period, target_field, (standard_value + 1)::DECIMAL(18,4), true, 0.88::DOUBLE, tag FROM long WHERE tag[1] < '8')"""
WITH_WIDE = f"WITH {_COMPANY}, {_WIDE} "
WITH_FACTS = f"WITH {_COMPANY}, {_WIDE}, {_LONG} "


def sql_of(q: Query) -> str:
    """The reference SQL of a compiled panel query."""
    where = []
    if q.codes:
        where.append("w.stock_code IN (" + ", ".join(f"'{c.zfill(6)}'" for c in q.codes) + ")")
    if q.years:
        where.append(f"report_year IN ({', '.join(map(str, q.years))})")
    if q.periods:
        where.append("report_period IN (" + ", ".join(f"'{p}'" for p in q.periods) + ")")
    where += [f"{c.metric} {c.operator.replace('!=', '<>')} {c.value}" for c in q.conditions]
    order = q.order_by or q.metrics[0]
    same = order != "quantity"
    if q.intent == "ranking_query":
        where.append(f"{order} IS NOT NULL")
    by = ([] if q.rank_scope == "global" else ["report_year", "report_period"]) + ([f"{order} {'DESC' if q.descending else 'ASC'} NULLS LAST"] if same else []) + ["w.stock_code", "report_year", "report_period"]
    metrics = ", ".join(f"{m}::DOUBLE AS {m}" for m in q.metrics)
    return f"{WITH_WIDE} SELECT w.stock_code, stock_abbr, report_year, report_period, {metrics} FROM (SELECT w.*, stock_abbr FROM wide w LEFT JOIN company USING (stock_code)) w WHERE {' AND '.join(where) or 'true'} ORDER BY {', '.join(by)} LIMIT {q.limit}"


def run_compiled(query: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(compiled(query, store(spark, sf_dir)))


def cross_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(joined(Query("comparison_query", ("revenue", "quantity"), years=(1997, 1998), periods=("FY",), limit=500), store(spark, sf_dir)))


def cross_table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that a question over two tables becomes, as rows."""
    s = store(spark, sf_dir)
    parts = split(Query("comparison_query", ("revenue", "tax", "quantity", "unknown"), years=(1997,), periods=("FY",), conditions=(Condition("quantity", ">", 1),)), s)
    rows = [(i, q.intent, ",".join(q.metrics), len(q.conditions)) for i, q in enumerate(parts)]
    return spark.createDataFrame(rows, "part int, intent string, metrics string, conditions int")


def company_dim_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.companies(spark, sf_dir)


def code_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("raw"))
    return o.select("raw", scalars.stock_code(F.col("raw")).alias("code"))


def calc_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice").distinct()
    a, b = F.col("l_extendedprice"), F.col("l_quantity")
    return o.select(a, b, F.round(compile_expression("(a-b)/abs(b)*100", {"a": a, "b": b}), 6).alias("pct"))


def calc_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("xs"))
    x = {"xs": F.col("xs")}
    return o.select("o_custkey", F.round(compile_expression("median(xs)", x), 4).alias("med"), compile_expression("max(xs) - min(xs)", x).alias("spread"))


def calc_round_and_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = panel.read(spark, sf_dir, "customer")
    v = {"n": F.col("c_nationkey").cast("double"), "k": F.col("c_custkey").cast("double")}
    return c.select("c_custkey", compile_expression("round(k / 2)", v).alias("half_even"), compile_expression("(n - 12) % -5", v).alias("rest"), compile_expression("1 < n <= 10", v).alias("between_"))


def schema_tables_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.functions.catalog import fields_table

    return fields_table(spark).groupBy("table_name").agg(F.count("*").alias("fields"), F.count_if(F.col("unit") == "%").alias("rates"))


def of_facts(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: doubles(make(panel.staging_facts(spark, sf_dir)))


def derived_ratios(wide: DataFrame) -> DataFrame:
    r, c, t, q = (F.col(x).cast("double") for x in ("revenue", "cost", "tax", "quantity"))
    return wide.select(
        *KEY,
        F.round((r - c) / F.nullif(r, F.lit(0.0)) * 100, 6).alias("gross_margin"),
        F.round(t / F.nullif(r, F.lit(0.0)) * 100, 6).alias("tax_ratio"),
        F.round(r / F.nullif(q, F.lit(0.0)), 6).alias("price"),
        F.round(c + t, 4).alias("expenses"),
    )


def null_preserving_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full years merged over quarters' best: even years come with a null cost, which keeps the stored one."""
    wide = panel.wide_facts(spark, sf_dir)
    current = wide.where("report_period in ('FY', 'Q1')").select(*KEY, "revenue", "cost")
    fresh = wide.where("report_period in ('FY', 'Q2')").select(*KEY, (F.col("revenue") * 2).cast(panel.MONEY).alias("revenue"), F.when(F.col("report_year") % 2 == 1, F.col("cost")).alias("cost"))
    return doubles(facts.merged(current, fresh, KEY))


def unit_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("亿元", "万元", "千元", "元", "美元x", "%")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    raw = F.format_number(F.col("o_totalprice"), 2)
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("("), raw, F.lit(")"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("（"), raw, F.lit("）"))).when(F.col("o_orderkey") % 4 == 2, F.lit("不适用")).otherwise(raw)
    value = scalars.numeric(shown)
    return o.select("o_orderkey", shown.alias("shown"), value.cast("double").alias("value"), F.round(scalars.standard_amount(value, scalars.unit_name(unit), F.lit("万元")).cast("double"), 4).alias("standard"))


def disclosure_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = panel.read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select("day", scalars.disclosed_year(F.col("day")).alias("report_year"), scalars.disclosed_period(F.col("day")).alias("report_period"))


def json_path_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panel.read(spark, sf_dir, "events")
    return e.select("event_id", F.nullif(F.get_json_object("props", "$.k"), F.lit("")).try_cast("int").alias("k"), F.get_json_object("props", "$.none").try_cast("int").alias("none"))


def validate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each company as a run: low confidence warns, a missing required metric fails."""
    f = panel.staging_facts(spark, sf_dir).where("run_id = 1")
    runs = panel.companies(spark, sf_dir).select(F.col("stock_code").alias("run_id"))
    low = f.where("confidence < 0.7").select(F.col("stock_code").alias("run_id"), F.lit("confidence_threshold").alias("rule_name"), F.lit("warn").alias("status"))
    lacking = runs.join(f.where("report_period = 'Q1' and report_year = 1995").select(F.col("stock_code").alias("run_id")).distinct(), "run_id", "left_anti").select("run_id", F.lit("staging_rows_present").alias("rule_name"), F.lit("fail").alias("status"))
    return facts.run_status(runs, low.unionByName(lacking))


def field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the four metrics by company in the first quarter of 1995."""
    f = panel.staging_facts(spark, sf_dir).where("report_year = 1995 and report_period = 'Q1'")
    chosen = facts.report_choice(f).select("stock_code", "target_field", "standard_value")
    catalogue = panel.companies(spark, sf_dir).select("stock_code", F.explode(F.array(*map(F.lit, panel.PANEL_METRICS))).alias("target_field"))
    return evaluation.coverage_summary(evaluation.field_report(catalogue, chosen, ["stock_code", "target_field"]), "stock_code")


def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compiled(replace(POINT, years=(), periods=(), all_periods=True, limit=500), store(spark, sf_dir))
    return doubles(chart_series(rows, "revenue", "line"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_rows(compiled(RANKING, store(spark, sf_dir)), {"revenue": "元"})


FACT_COLUMNS = [*KEY, "target_field", "run_id", "standard_value", "is_derived", "confidence"]
FIELDS = ["stock_code", "report_period", "target_field"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run_compiled, q) for name, q in COMPILED.items()}
    out |= {f.__name__: f for f in (cross_table_join, cross_table_split, company_dim_scan, code_normalise, calc_growth, calc_lists, calc_round_and_mod, schema_tables_count, null_preserving_merge, unit_standardise, disclosure_periods, json_path_cast, validate_runs, field_report, chart_rows, answers)}
    yearly = lambda f: f.where("run_id = 1 and report_period = 'FY'").select(*KEY, "target_field", "standard_value")
    out |= {
        "staging_unpivot": of_facts(lambda f: f.where("run_id = 1").select(*KEY, "target_field", "standard_value")),
        "staging_candidate_argmax": of_facts(lambda f: f.groupBy(*KEY, "target_field").agg(F.max_by("standard_value", F.struct("confidence", "run_id")).alias("standard_value"))),
        "staging_last_wins": of_facts(lambda f: f.groupBy(*KEY, "target_field").agg(F.max_by("standard_value", "run_id").alias("standard_value"))),
        "staging_distinct_on": of_facts(lambda f: facts.promoted_choice(f).select(*FACT_COLUMNS)),
        "field_report_pick": of_facts(lambda f: facts.report_choice(f).select(*FACT_COLUMNS)),
        "growth_yoy": of_facts(lambda f: facts.year_over_year(yearly(f), keys=FIELDS).select(*KEY, "target_field", F.round(F.col("growth").cast("double"), 4).alias("growth"))),
        "promote_pivot": of_facts(lambda f: facts.pivoted(facts.promoted_choice(f), list(panel.PANEL_METRICS))),
        "decimal_fit": of_facts(lambda f: f.where("run_id = 1").select(*KEY, "target_field", scalars.fits(F.col("standard_value"), 9, 4).alias("fitted"))),
        "growth_qoq": lambda s, d: doubles(facts.quarter_over_quarter(panel.quarter_facts(s, d).select(*KEY, "revenue"), "revenue").select(*KEY, F.round(F.col("growth").cast("double"), 4).alias("growth"))),
        "derive_ratios": lambda s, d: derived_ratios(panel.wide_facts(s, d)),
    }
    return out


_FACT_SQL = "stock_code, report_year, report_period, target_field, run_id, standard_value::DOUBLE AS standard_value, is_derived, confidence"
_KEY_SQL = "stock_code, report_year, report_period"


def oracle_sql() -> dict[str, str]:
    out = {name: sql_of(q) for name, q in COMPILED.items()}
    sign = "CASE WHEN o_orderkey % 4 = 0 THEN '(' || raw || ')' WHEN o_orderkey % 4 = 1 THEN '（' || raw || '）' WHEN o_orderkey % 4 = 2 THEN '不适用' ELSE raw END"
    value = "CASE WHEN o_orderkey % 4 = 2 THEN NULL WHEN o_orderkey % 4 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END"
    out |= {
        "cross_table_join": f"{WITH_WIDE} SELECT {_KEY_SQL}, revenue::DOUBLE AS revenue, quantity::DOUBLE AS quantity FROM wide WHERE report_year IN (1997, 1998) AND report_period = 'FY' ORDER BY report_year, report_period, stock_code LIMIT 500",
        "cross_table_split": "SELECT 0 AS part, 'metric_query' AS intent, 'revenue,tax' AS metrics, 0 AS conditions UNION ALL SELECT 1, 'metric_query', 'quantity', 1",
        "company_dim_scan": f"WITH {_COMPANY} SELECT * FROM company",
        "code_normalise": "SELECT o_orderkey::VARCHAR AS raw, CASE WHEN length(o_orderkey::VARCHAR) < 6 THEN lpad(o_orderkey::VARCHAR, 6, '0') ELSE o_orderkey::VARCHAR END AS code FROM orders",
        "calc_growth": "SELECT DISTINCT l_extendedprice, l_quantity, round((l_extendedprice - l_quantity) / abs(l_quantity) * 100, 6) AS pct FROM lineitem",
        "calc_lists": "SELECT o_custkey, round(median(o_totalprice), 4) AS med, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_custkey",
        "calc_round_and_mod": "SELECT c_custkey, round_even(c_custkey / 2, 0) AS half_even, (c_nationkey - 12)::DOUBLE - floor((c_nationkey - 12)::DOUBLE / -5) * -5 AS rest, c_nationkey > 1 AND c_nationkey <= 10 AS between_ FROM customer",
        "schema_tables_count": "SELECT * FROM (VALUES ('core_performance_indicators_sheet', 15::BIGINT, 9::BIGINT), ('balance_sheet', 16, 3), ('income_sheet', 16, 2), ('cash_flow_sheet', 13, 4)) t(table_name, fields, rates)",
        "staging_unpivot": f"{WITH_FACTS} SELECT {_KEY_SQL}, target_field, standard_value::DOUBLE AS standard_value FROM facts WHERE run_id = 1",
        "staging_candidate_argmax": f"{WITH_FACTS} SELECT {_KEY_SQL}, target_field, standard_value::DOUBLE AS standard_value FROM facts QUALIFY row_number() OVER (PARTITION BY {_KEY_SQL}, target_field ORDER BY confidence DESC, run_id DESC) = 1",
        "staging_last_wins": f"{WITH_FACTS} SELECT {_KEY_SQL}, target_field, arg_max(standard_value, run_id)::DOUBLE AS standard_value FROM facts GROUP BY ALL",
        "staging_distinct_on": f"{WITH_FACTS} SELECT DISTINCT ON ({_KEY_SQL}, target_field) {_FACT_SQL} FROM facts ORDER BY {_KEY_SQL}, target_field, is_derived, confidence DESC NULLS LAST, run_id DESC",
        "field_report_pick": f"{WITH_FACTS} SELECT DISTINCT ON ({_KEY_SQL}, target_field) {_FACT_SQL} FROM facts ORDER BY {_KEY_SQL}, target_field, is_derived DESC, confidence DESC NULLS LAST, run_id DESC",
        "growth_yoy": f"{WITH_FACTS} SELECT a.stock_code, a.report_year, a.report_period, a.target_field, round((a.standard_value - b.standard_value)::DOUBLE * 100 / nullif(abs(b.standard_value)::DOUBLE, 0), 4) AS growth FROM long a LEFT JOIN long b ON a.stock_code = b.stock_code AND a.report_period = b.report_period AND a.target_field = b.target_field AND a.report_year = b.report_year + 1 WHERE a.report_period = 'FY'",
        "growth_qoq": f"{WITH_WIDE}, n AS (SELECT *, report_year * 4 + report_period[2]::INT AS q FROM quarters) SELECT a.stock_code, a.report_year, a.report_period, round((a.revenue - b.revenue)::DOUBLE * 100 / nullif(abs(b.revenue)::DOUBLE, 0), 4) AS growth FROM n a LEFT JOIN n b ON a.stock_code = b.stock_code AND a.q = b.q + 1",
        "derive_ratios": f"{WITH_WIDE} SELECT {_KEY_SQL}, round((revenue::DOUBLE - cost::DOUBLE) / nullif(revenue::DOUBLE, 0) * 100, 6) AS gross_margin, round(tax::DOUBLE / nullif(revenue::DOUBLE, 0) * 100, 6) AS tax_ratio, round(revenue::DOUBLE / nullif(quantity::DOUBLE, 0), 6) AS price, round(cost::DOUBLE + tax::DOUBLE, 4) AS expenses FROM wide",
        "promote_pivot": f"{WITH_FACTS}, best AS (SELECT DISTINCT ON ({_KEY_SQL}, target_field) * FROM facts ORDER BY {_KEY_SQL}, target_field, is_derived, confidence DESC NULLS LAST, run_id DESC) SELECT {_KEY_SQL}, " + ", ".join(f"(max(standard_value) FILTER (target_field = '{m}'))::DOUBLE AS {m}" for m in panel.PANEL_METRICS) + f" FROM best GROUP BY {_KEY_SQL}",
        "decimal_fit": f"{WITH_FACTS} SELECT {_KEY_SQL}, target_field, CASE WHEN abs(standard_value) < 100000 THEN standard_value::DOUBLE END AS fitted FROM long",
        "null_preserving_merge": f"""{WITH_WIDE}, a AS (SELECT * FROM wide WHERE report_period IN ('FY', 'Q1')),
b AS (SELECT stock_code, report_year, report_period, (revenue * 2)::DECIMAL(18,4) AS revenue, CASE WHEN report_year % 2 = 1 THEN cost END AS cost FROM wide WHERE report_period IN ('FY', 'Q2'))
SELECT {_KEY_SQL}, coalesce(b.revenue, a.revenue)::DOUBLE AS revenue, coalesce(b.cost, a.cost)::DOUBLE AS cost FROM a FULL JOIN b USING ({_KEY_SQL})""",
        "unit_standardise": f"""WITH o AS (SELECT *, format('{{:,.2f}}', o_totalprice) AS raw FROM orders)
SELECT o_orderkey, {sign} AS shown, {value} AS value, round(({value})::DECIMAL(24,6) * CASE o_orderkey % 6 WHEN 0 THEN 10000 WHEN 2 THEN 0.1 WHEN 3 THEN 0.0001 WHEN 4 THEN 0.0001 ELSE 1 END, 4)::DOUBLE AS standard FROM o""",
        "disclosure_periods": "SELECT DISTINCT o_orderdate::DATE AS day, (year(o_orderdate) - (month(o_orderdate) <= 4)::INT)::INT AS report_year, CASE WHEN month(o_orderdate) <= 4 THEN 'FY' WHEN month(o_orderdate) <= 8 THEN 'HY' WHEN month(o_orderdate) <= 10 THEN 'Q3' ELSE 'FY' END AS report_period FROM orders",
        "json_path_cast": "SELECT event_id, try_cast(nullif(json_extract_string(props, '$.k'), '') AS INT) AS k, try_cast(json_extract_string(props, '$.none') AS INT) AS none FROM events",
        "validate_runs": f"""{WITH_FACTS}, warned AS (SELECT stock_code, count(*) AS n FROM facts WHERE run_id = 1 AND confidence < 0.7 GROUP BY 1), held AS (SELECT DISTINCT stock_code FROM facts WHERE run_id = 1 AND report_year = 1995 AND report_period = 'Q1')
SELECT stock_code AS run_id, CASE WHEN held.stock_code IS NULL THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END AS status, (held.stock_code IS NULL)::BIGINT AS fails, coalesce(n, 0)::BIGINT AS warns FROM company LEFT JOIN warned USING (stock_code) LEFT JOIN held USING (stock_code)""",
        "field_report": f"""{WITH_FACTS}, f AS (SELECT DISTINCT stock_code, target_field FROM facts WHERE report_year = 1995 AND report_period = 'Q1')
SELECT stock_code, count(target_field) AS covered, 4::BIGINT AS total, round(count(target_field) * 100.0 / 4, 6)::DOUBLE AS percent FROM company LEFT JOIN f USING (stock_code) GROUP BY stock_code""",
        "chart_rows": f"""WITH r AS ({sql_of(replace(POINT, years=(), periods=(), all_periods=True, limit=18))})
SELECT row_number() OVER (ORDER BY report_year, CASE report_period WHEN 'Q1' THEN 1 WHEN 'HY' THEN 2 WHEN 'Q3' THEN 3 WHEN 'FY' THEN 4 ELSE 9 END, stock_code, report_period)::INT AS place, stock_code, report_year, report_period, revenue AS y FROM r""",
        "answers": f"WITH r AS ({sql_of(RANKING)}) SELECT row_number() OVER (ORDER BY report_year, report_period, revenue DESC, stock_code)::INT AS place, stock_abbr || ' ' || report_year || '年报：revenue ' || rtrim(rtrim(format('{{:,.6f}}', revenue), '0'), '.') || '元' AS line FROM r ORDER BY 1 LIMIT 8",
    }
    return out
