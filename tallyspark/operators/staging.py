"""Raw statement tables to typed facts, all tables of all documents at once.

Input rows are raw tables: ``document_id, stock_code, report_year, report_period, page_number,
table_index, section_title, markdown, page_text, rows`` (rows an array of arrays of cells).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.functions.scalars import clean_label, first_parenthesis, normalised_text, numeric, period_scope, standard_amount, text, trimmed, unit_name
from tallyspark.operators.lineage import materialised

DOCUMENT = ["document_id", "stock_code", "report_year", "report_period"]
TABLE = ["document_id", "page_number", "table_index"]

# Words that decide how a table is read.
HEADER_LABELS = ("项目", "指标", "科目", "主要会计数据", "主要财务指标")
CURRENT = ("本期", "本年", "本报告期", "期末")
PRIOR = ("上期", "上年", "期初")
PERIOD_CELL = "20[0-9]{2}年|" + "|".join((*CURRENT, *PRIOR))
DETAIL_WORDS = "合营企业|联营企业|持股比例|账面价值|纳入评价范围|内部控制|缺陷认定|关键审计事项"
STATEMENT_WORDS = "合并资产负债表|合并利润表|合并现金流量表|主要会计数据|主要财务指标"
INCOME_LABELS = ("营业总收入", "营业总成本", "营业利润", "利润总额", "净利润")
BALANCE_LABELS = ("流动资产", "非流动资产", "资产总计", "负债合计", "所有者权益合计")
SHARE_LABELS = ("实收资本", "股本")
UNITS = ("亿元", "万元", "千元", "元", "%")


def is_period(cell: Column) -> Column:
    return normalised_text(text(cell)).rlike(PERIOD_CELL)


def table_unit() -> Column:
    """Unit named after 单位, else the first kind of amount in title, table or page, else the commonest one in cell parentheses."""
    words = F.concat_ws("\n", "section_title", "markdown", "page_text")
    named = F.transform(F.regexp_extract_all(words, F.lit(r"单位\s*[:：]\s*([^\s，,；;。)）]+)"), F.lit(1)), unit_name)
    spoken = F.coalesce(*[F.when(words.contains(u), F.lit(u)) for u in ("亿元", "万元", "千元", "元")])
    inside = F.flatten(F.transform(F.flatten("rows"), lambda c: F.regexp_extract_all(text(c), F.lit(r"[（(]([^）)]+)[）)]"), F.lit(1))))
    amounts = F.filter(F.transform(F.filter(inside, lambda u: ~u.rlike("股|/")), unit_name), lambda u: u.isin("亿元", "万元", "千元", "元"))
    # as many occurrences as possible, then the first seen
    ranked = F.transform(F.array_distinct(amounts), lambda u: F.struct(F.size(F.filter(amounts, lambda x: x == u)).alias("n"), (-F.array_position(amounts, u)).alias("p"), u.alias("u")))
    return F.coalesce(F.get(F.filter(named, lambda u: u.isin(*UNITS)), 0), spoken, F.array_max(ranked)["u"])


def table_rows(tables: DataFrame) -> DataFrame:
    """Rows padded to equal width without blank ones, with the place of their label and continued labels joined."""
    width = F.array_max(F.transform("rows", F.size))
    padded = F.transform(
        F.filter("rows", lambda r: F.exists(r, lambda c: trimmed(text(c)) != "")),
        lambda r: F.concat(F.transform(r, text), F.array_repeat(F.lit(""), width - F.size(r))),
    )
    wide = tables.withColumn("raw_unit", table_unit()).withColumn("rows", padded).select(*DOCUMENT, "page_number", "table_index", "section_title", "markdown", "raw_unit", F.posexplode("rows").alias("row_pos", "row"))
    is_label = F.transform("row", lambda c: (trimmed(c) != "") & numeric(c).isNull() & (clean_label(c) != "") & ~is_period(c))
    placed = wide.withColumn("label_pos", F.array_position(is_label, True).cast("int"))
    beyond = F.slice("row", F.col("label_pos") + 1, F.size("row"))
    placed = placed.withColumn("has_value", (F.col("label_pos") > 0) & F.exists(beyond, lambda c: numeric(c).isNotNull()))
    cell = F.when(F.col("label_pos") > 0, F.get("row", F.col("label_pos") - 1)).otherwise(F.get("row", F.lit(0)))
    placed = placed.withColumn("label_cell", cell)
    cleaned = clean_label(F.col("label_cell"))
    continues = (F.col("label_pos") > 0) & ~F.col("has_value") & ~cleaned.isin(*HEADER_LABELS) & cleaned.rlike("^[的及和或]|^(流量净额|净利润|填列|列)$|(流量净额|净利润)$")
    along = Window.partitionBy(*TABLE).orderBy("row_pos")
    placed = placed.withColumn("continues", continues).withColumn("island", F.sum((~F.col("continues")).cast("int")).over(along))
    island = Window.partitionBy(*TABLE, "island")
    headed = placed.withColumn("head_has_value", F.max(F.when(~F.col("continues"), F.col("has_value"))).over(island))
    tail = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("continues"), F.struct("row_pos", trimmed(F.col("label_cell")).alias("t")))).over(island)), lambda x: x["t"]), "")
    joined = headed.withColumn("label_cell", F.when(F.col("head_has_value") & ~F.col("continues"), F.concat("label_cell", tail)).otherwise(F.col("label_cell")))
    return joined.where(~(F.col("continues") & F.coalesce("head_has_value", F.lit(False)))).withColumn("label", clean_label(F.col("label_cell"))).drop("island", "head_has_value", "continues", "has_value")


def typed_rows(rows: DataFrame) -> DataFrame:
    """Adds the table's kind and, to each row, the header that holds for it; drops other tables and header rows."""
    whole = Window.partitionBy(*TABLE)
    along = whole.orderBy("row_pos")
    numbered = rows.withColumn("n", F.row_number().over(along)).withColumn("n_rows", F.count("*").over(whole))
    rest = F.slice("row", 2, F.size("row"))
    period_row = F.exists(rest, is_period)
    first_header = (F.col("n") <= 4) & (normalised_text(F.get("row", F.lit(0))).isin(*HEADER_LABELS) | period_row)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    everywhere = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = (
        numbered.withColumn("opening", F.coalesce(F.first(F.when(first_header, F.col("row")), ignorenulls=True).over(everywhere), F.first("row").over(everywhere)))
        .withColumn("switches", (F.col("n") > 1) & (F.col("label") == "") & period_row)
        .withColumn("header", F.coalesce(F.last(F.when(F.col("switches"), F.col("row")), ignorenulls=True).over(so_far), F.col("opening")))
        .withColumn("labels", F.collect_set("label").over(whole))
        .withColumn("head_text", F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.when(F.col("n") <= 10, F.struct("n", F.concat_ws(" ", F.slice("row", 1, 3)).alias("t")))).over(whole)), lambda x: x.isNotNull()), lambda x: x["t"]), "\n"))
    )
    words = normalised_text(F.concat_ws("\n", text(F.col("section_title")), F.substring(text(F.col("markdown")), 1, 800), F.col("head_text")))
    income = F.arrays_overlap("labels", F.array(*map(F.lit, INCOME_LABELS)))
    balance = F.arrays_overlap("labels", F.array(*map(F.lit, BALANCE_LABELS)))
    cash = F.exists("labels", lambda x: x.rlike("现金流量|现金及现金等价物"))
    core = words.rlike("主要会计数据|主要财务指标") | F.arrays_overlap("labels", F.array(F.lit("基本每股收益"), F.lit("加权平均净资产收益率")))
    kind = (
        F.when(income.cast("int") + balance.cast("int") + cash.cast("int") > 1, "mixed_statement")
        .when(core, "core")
        .when(words.contains("资产负债表") | balance, "balance")
        .when(words.contains("利润表") | income, "income")
        .when(words.contains("现金流量表") | cash, "cash_flow")
    )
    around = normalised_text(F.concat_ws("\n", "section_title", F.substring(text(F.col("markdown")), 1, 1200)))
    detail = around.rlike(DETAIL_WORDS) & ~around.rlike(STATEMENT_WORDS)
    typed = numbered.withColumn("table_type", kind).where(F.col("table_type").isNotNull() & ~detail & (F.col("n_rows") >= 2))
    return typed.where((F.col("n") > 1) & ~F.col("switches") & (F.col("label") != "") & ~F.col("label").isin(*HEADER_LABELS)).drop("opening", "switches", "labels", "head_text", "n_rows")


def header_at(i: Column) -> Column:
    """Header cell of a column, or the nearest filled one: one and two to the right, then one and two to the left."""
    at = lambda k: F.nullif(trimmed(F.get("header", k)), F.lit(""))
    return F.coalesce(at(i), at(i + 1), at(i + 2), F.when(i >= 1, at(i - 1)), F.when(i >= 2, at(i - 2)), F.lit(""))


def column_score(head: Column, kind: Column, table: Column, strict_growth: bool) -> Column:
    """How well a column's header suits the report's year; null for a column that can't be meant."""
    year, before = F.col("report_year").cast("string"), (F.col("report_year") - 1).cast("string")
    balance = table == "balance_sheet"
    up = head.rlike("增减|增长|同比|%").cast("int") * 100 - head.contains(year).cast("int") * 10
    dated = head.rlike(PERIOD_CELL) | (balance & head.rlike("期末|期初|年末|年初"))
    score = (
        head.contains(year).cast("int") * 100
        + head.rlike("|".join(CURRENT)).cast("int") * 80
        - head.contains(before).cast("int") * 80
        - head.rlike("|".join(PRIOR)).cast("int") * 100
        + (balance & head.rlike("12月31日|期末|年末")).cast("int") * 20
        + (head == "").cast("int")
    )
    value = F.when(head.rlike("增减|增长|同比") | ((head != "") & ~dated), F.lit(None)).when(score > -50, score)
    return F.when(kind == "growth", F.when(up >= (90 if strict_growth else -49), up)).otherwise(value)


def chosen_cell(kind: Column, table: Column, strict_growth: bool) -> Column:
    """Best-scored numeric cell after the first column, the leftmost of equals: ``score, place, raw``."""
    cells = F.transform("row", lambda c, i: F.struct(column_score(normalised_text(header_at(i)), kind, table, strict_growth).alias("score"), (-i).alias("place"), trimmed(c).alias("raw")))
    fit = F.filter(cells, lambda s: (s["place"] < 0) & s["score"].isNotNull() & numeric(s["raw"]).isNotNull() & ~normalised_text(header_at(-s["place"])).contains("注"))
    return F.array_max(fit)


def facts_of(rows: DataFrame, strict_growth: bool = True) -> DataFrame:
    """Facts of the labelled rows by the label rules, the best candidate of each field of a document.

    Candidates compete by priority; the first by page, table, row and rule wins ties.
    ``strict_growth`` takes a growth only from a column that says so.
    """
    rules = F.broadcast(catalog.rules_table(rows.sparkSession))
    mixed = (F.col("table_type") == "mixed_statement") & F.arrays_overlap("table_types", F.array(F.lit("balance"), F.lit("income"), F.lit("cash_flow")))
    met = rows.join(rules, (F.col("label") == F.col("alias")) & (F.array_contains("table_types", F.col("table_type")) | mixed))
    picked = met.withColumn("cell", chosen_cell(F.col("value_kind"), F.col("target_table"), strict_growth)).where("cell is not null")
    value = numeric(F.col("cell.raw"))
    statement = F.col("target_table").isin(catalog.BALANCE, catalog.INCOME, catalog.CASH)
    unit = F.coalesce("raw_unit", unit_name(first_parenthesis(F.col("label_cell"))), F.when(statement, "元"))
    title = normalised_text(text(F.col("section_title")))
    priority = F.col("rule_priority") + F.col("table_type").isin("balance", "income", "cash_flow").cast("int") * 10 + title.contains("合并").cast("int") * 5 - title.contains("母公司").cast("int") * 20
    head = header_at(-F.col("cell.place"))
    shaped = picked.select(
        *DOCUMENT,
        "target_table",
        "target_field",
        F.col("label").alias("source_label"),
        F.col("cell.raw").alias("raw_value"),
        unit.alias("raw_unit"),
        standard_amount(value, unit, F.col("target_unit")).alias("standard_value"),
        F.when((F.col("target_unit") == "万元") & unit.isNull(), F.lit(None)).otherwise(F.col("target_unit")).alias("standard_unit"),
        period_scope(F.col("target_table"), F.col("report_period")).alias("period_scope"),
        F.when(numeric(head).isNull() & (head != ""), head).alias("source_period_label"),
        F.lit(False).alias("is_derived"),
        F.lit(None).cast("string").alias("derivation_formula"),
        "page_number",
        "table_index",
        F.when(unit.isNotNull(), 0.90).otherwise(0.76).cast("decimal(8,6)").alias("confidence"),
        F.struct(priority.alias("p"), (-F.col("page_number")).alias("a"), (-F.col("table_index")).alias("b"), (-F.col("row_pos")).alias("c"), (-F.col("rule_pos")).alias("d")).alias("standing"),
    )
    keys = [*DOCUMENT, "target_table", "target_field", "period_scope"]
    payload = [c for c in shaped.columns if c not in (*keys, "standing")]
    best = shaped.groupBy(*keys).agg(F.max_by(F.struct(*payload), "standing").alias("best"))
    return best.select(*keys, "best.*").select(*FACT_COLUMNS)


FACT_COLUMNS = [*DOCUMENT, "target_table", "target_field", "source_label", "raw_value", "raw_unit", "standard_value", "standard_unit", "period_scope", "source_period_label", "is_derived", "derivation_formula", "page_number", "table_index", "confidence"]


def share_counts(rows: DataFrame) -> DataFrame:
    """Total shares of a document, in 10 000 if the table is in 元; the last row that names them counts."""
    cell = chosen_cell(F.lit("value"), F.lit("balance_sheet"), True)
    named = rows.where(F.col("label").isin(*SHARE_LABELS)).withColumn("cell", cell).where("cell is not null")
    value = numeric(F.col("cell.raw"))
    value = F.when(F.col("raw_unit") == "元", value / 10000).otherwise(value).cast("decimal(24,6)")
    return named.groupBy(*DOCUMENT).agg(F.max_by(value, F.struct("page_number", "table_index", "row_pos")).alias("total_shares"))


def reconciled(facts: DataFrame) -> DataFrame:
    """Facts with equal fields of two tables aligned: the core table's value holds, statements only fill its gaps.

    The rule list is joined to the facts, and its targets back to them; both are keyed by document.
    """
    spark = facts.sparkSession
    pairs = [(st, sf, tt, tf, catalog.unit_of(tf), o) for rules, o in ((catalog.EQUIVALENT, True), (catalog.FILL_ONLY, False)) for (st, sf), (tt, tf) in rules]
    rules = F.broadcast(spark.createDataFrame(pairs, "target_table string, target_field string, to_table string, to_field string, to_unit string, overrides boolean"))
    there = facts.select(*DOCUMENT, F.col("target_table").alias("to_table"), F.col("target_field").alias("to_field"), F.col("standard_value").alias("there"), F.lit(True).alias("exists"))
    met = facts.where("standard_value is not null").join(rules, ["target_table", "target_field"]).join(there, [*DOCUMENT, "to_table", "to_field"], "left")
    due = met.where(F.col("exists").isNull() | (F.col("overrides") & ~F.col("there").eqNullSafe(F.col("standard_value"))))
    source = F.concat_ws(".", "target_table", "target_field")
    fresh = due.select(
        *DOCUMENT,
        F.col("to_table").alias("target_table"),
        F.col("to_field").alias("target_field"),
        F.concat(F.lit("equivalent:"), source).alias("source_label"),
        F.col("standard_value").cast("string").alias("raw_value"),
        F.col("standard_unit").alias("raw_unit"),
        "standard_value",
        F.col("to_unit").alias("standard_unit"),
        period_scope(F.col("to_table"), F.col("report_period")).alias("period_scope"),
        "source_period_label",
        F.lit(True).alias("is_derived"),
        F.concat(F.col("to_table"), F.lit("."), F.col("to_field"), F.lit(" = "), source).alias("derivation_formula"),
        "page_number",
        "table_index",
        F.lit(0.89).cast("decimal(8,6)").alias("confidence"),
    )
    keys = [*DOCUMENT, "target_table", "target_field"]
    return facts.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def derived(facts: DataFrame, shares: DataFrame) -> DataFrame:
    """Ratios that the facts of a document imply and that it doesn't state."""
    CORE, INCOME, BALANCE, CASH = catalog.CORE, catalog.INCOME, catalog.BALANCE, catalog.CASH
    expenses = [f for f in catalog.METRICS[INCOME] if f.startswith("operating_expense_")]
    flows = ("operating", "investing", "financing")
    needed = [(CORE, "total_operating_revenue"), (INCOME, "total_operating_revenue"), (CORE, "net_profit_10k_yuan"), (BALANCE, "asset_total_assets"), (BALANCE, "liability_total_liabilities"), (BALANCE, "equity_total_equity"), (CASH, "net_cash_flow")]
    needed += [(INCOME, f) for f in expenses] + [(CASH, f"{k}_cf_net_amount") for k in flows]
    name = lambda t, f: f"{t[:4]}_{f}"
    found = [F.max(F.when((F.col("target_table") == t) & (F.col("target_field") == f), F.struct("standard_value", "page_number", "table_index", "standard_unit"))).alias(name(t, f)) for t, f in needed]
    one = facts.groupBy(*DOCUMENT).agg(*found).join(shares, DOCUMENT, "left")
    v = lambda t, f: F.col(name(t, f))["standard_value"].cast("double")
    one = one.withColumns(
        {
            "revenue": F.coalesce(F.nullif(v(CORE, "total_operating_revenue"), F.lit(0.0)), v(INCOME, "total_operating_revenue")),
            "flow": F.abs(F.when(F.col(name(CASH, "net_cash_flow"))["standard_unit"] == "元", v(CASH, "net_cash_flow") / 10000).otherwise(v(CASH, "net_cash_flow"))),
            "shares": F.col("total_shares").cast("double"),
        }
    )
    over = lambda a, b, by=100: F.try_divide(a * by, F.nullif(b, F.lit(0.0)))
    total = sum((F.coalesce(v(INCOME, f), F.lit(0.0)) for f in expenses), F.lit(0.0))
    cost = v(INCOME, "operating_expense_cost_of_sales")
    made = [
        (CORE, "gross_profit_margin", over(F.col("revenue") - cost, F.col("revenue")), [(CORE, "total_operating_revenue"), (INCOME, "operating_expense_cost_of_sales")], "(revenue - cost) / revenue * 100"),
        (CORE, "net_profit_margin", over(v(CORE, "net_profit_10k_yuan"), F.col("revenue")), [(CORE, "net_profit_10k_yuan")], "net profit / revenue * 100"),
        (INCOME, "total_operating_expenses", F.when(F.coalesce(*[v(INCOME, f) for f in expenses]).isNotNull(), total), [(INCOME, f) for f in expenses], "sum of the expenses present"),
        (BALANCE, "asset_liability_ratio", over(v(BALANCE, "liability_total_liabilities"), v(BALANCE, "asset_total_assets")), [(BALANCE, "liability_total_liabilities")], "liabilities / assets * 100"),
        (CORE, "net_asset_per_share", over(v(BALANCE, "equity_total_equity"), F.col("shares"), 1), [(BALANCE, "equity_total_equity")], "equity / shares"),
        (CORE, "operating_cf_per_share", over(v(CASH, "operating_cf_net_amount"), F.col("shares"), 1), [(CASH, "operating_cf_net_amount")], "operating cash flow / shares"),
        *[(CASH, f"{k}_cf_ratio_of_net_cf", over(v(CASH, f"{k}_cf_net_amount"), F.col("flow")), [(CASH, f"{k}_cf_net_amount")], f"{k} cash flow / |net cash flow| * 100") for k in flows],
    ]
    items = [F.struct(F.lit(t).alias("t"), F.lit(f).alias("f"), value.cast("decimal(24,6)").alias("value"), F.coalesce(*[F.col(name(*n)) for n in needs]).alias("near"), F.lit(formula).alias("formula"), F.lit(catalog.unit_of(f)).alias("unit")) for t, f, value, needs, formula in made]
    rows = one.select(*DOCUMENT, F.inline(F.array(*items))).where("value is not null")
    fresh = rows.select(
        *DOCUMENT,
        F.col("t").alias("target_table"),
        F.col("f").alias("target_field"),
        F.concat(F.lit("derived:"), F.col("f")).alias("source_label"),
        F.col("value").cast("string").alias("raw_value"),
        F.col("unit").alias("raw_unit"),
        F.col("value").alias("standard_value"),
        F.col("unit").alias("standard_unit"),
        period_scope(F.col("t"), F.col("report_period")).alias("period_scope"),
        F.lit("derived").alias("source_period_label"),
        F.lit(True).alias("is_derived"),
        F.col("formula").alias("derivation_formula"),
        F.col("near.page_number").alias("page_number"),
        F.col("near.table_index").alias("table_index"),
        F.lit(0.88).cast("decimal(8,6)").alias("confidence"),
    )
    keys = [*DOCUMENT, "target_table", "target_field"]
    return fresh.join(facts.select(*keys), keys, "left_anti")


def staging_facts(tables: DataFrame, companies: DataFrame, strict_growth: bool = True) -> DataFrame:
    """All facts of raw tables whose company is known and whose year and period are given.

    Rows and candidates are written once: the later steps read them several times.
    """
    admitted = tables.where("stock_code is not null and report_year is not null and report_period is not null").join(companies.select("stock_code").distinct(), "stock_code", "left_semi")
    rows = materialised(typed_rows(table_rows(admitted)))
    facts = reconciled(materialised(facts_of(rows, strict_growth)))
    return facts.unionByName(derived(facts, share_counts(rows)))
