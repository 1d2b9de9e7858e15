"""Facts after extraction: growth against earlier periods, validation, and promotion into wide tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.functions.scalars import checked_unit, fits, growth

KEY = ["stock_code", "report_year", "report_period"]
#: Words one of which a plausible period label holds.
PERIOD_WORDS = "年|本期|本报告期|期末|期初|金额|余额"


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; name a unique last column to make it certain."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def promoted_choice(facts: DataFrame, field: str = "target_field", tie: str = "run_id") -> DataFrame:
    """One fact per key and field for the wide tables: extracted before derived, then by confidence, then the latest."""
    usable = facts.where(F.col("standard_value").isNotNull())
    if "validation_status" in facts.columns:
        usable = usable.where(F.coalesce(F.col("validation_status") != "rejected", F.lit(True)))
    return latest(usable, [*KEY, field], F.col("is_derived").asc(), F.col("confidence").desc_nulls_last(), F.col(tie).desc())


def report_choice(facts: DataFrame, field: str = "target_field", tie: str = "run_id") -> DataFrame:
    """One fact per key and field for the field report: derived first."""
    return latest(facts, [*KEY, field], F.col("is_derived").desc(), F.col("confidence").desc_nulls_last(), F.col(tie).desc())


def shifted(facts: DataFrame, years: int, value: str = "standard_value", keys: list[str] | None = None) -> DataFrame:
    """Facts under the year in which they are the prior ones."""
    keys = keys or ["stock_code", "report_period"]
    return facts.select(*keys, (F.col("report_year") + years).cast("int").alias("report_year"), F.col(value).alias("prior_value"))


def year_over_year(facts: DataFrame, value: str = "standard_value", keys: list[str] | None = None) -> DataFrame:
    """Joins the same period one year before: ``prior_value`` and ``growth`` in percent; gaps give nulls."""
    keys = keys or ["stock_code", "report_period"]
    prior = shifted(facts, 1, value, keys)
    return facts.join(prior, [*keys, "report_year"], "left").withColumn("growth", growth(F.col(value), F.col("prior_value")))


def quarter_over_quarter(facts: DataFrame, value: str = "standard_value", keys: list[str] | None = None) -> DataFrame:
    """Joins the quarter before; only quarters Q1 to Q4 take part, Q1 looks at Q4 of the year before."""
    keys = keys or ["stock_code"]
    quarters = facts.where(F.col("report_period").isin("Q1", "Q2", "Q3", "Q4"))
    number = F.substring("report_period", 2, 1).cast("int")
    prior = quarters.select(
        *keys,
        F.when(number == 4, F.col("report_year") + 1).otherwise(F.col("report_year")).cast("int").alias("report_year"),
        F.concat(F.lit("Q"), (number % 4 + 1).cast("string")).alias("report_period"),
        F.col(value).alias("prior_value"),
    )
    return quarters.join(prior, [*keys, "report_year", "report_period"], "left").withColumn("growth", growth(F.col(value), F.col("prior_value")))


def growth_facts(facts: DataFrame) -> DataFrame:
    """Growth facts that the documents don't state, against the best fact of the prior period of any run.

    The rule list is broadcast; priors are picked once per key before they are joined.
    """
    spark = facts.sparkSession
    rules = [(t, f, s, "yoy") for t, f, s in catalog.YEAR_GROWTH] + [(t, f, s, "qoq") for t, f, s in catalog.QUARTER_GROWTH]
    table = F.broadcast(spark.createDataFrame(rules, "target_table string, growth_field string, target_field string, kind string"))
    keys = [*KEY, "target_table", "target_field", "period_scope"]
    best = latest(facts.where("standard_value is not null"), keys, F.col("is_derived").asc(), F.col("confidence").desc_nulls_last(), F.col("run_id").desc())
    current = best.join(table, ["target_table", "target_field"]).where("kind = 'yoy' or period_scope = 'single_period'")
    number = F.substring("report_period", 2, 1).try_cast("int")
    year = F.when(F.col("kind") == "yoy", F.col("report_year") - 1).when(number == 1, F.col("report_year") - 1).otherwise(F.col("report_year"))
    period = F.when(F.col("kind") == "yoy", F.col("report_period")).when(number == 1, "Q4").otherwise(F.concat(F.lit("Q"), (number - 1).cast("string")))
    current = current.withColumn("prior_year", year.cast("int")).withColumn("prior_period", period)
    prior = best.select("stock_code", "target_table", "target_field", "period_scope", F.col("report_year").alias("prior_year"), F.col("report_period").alias("prior_period"), F.col("standard_value").alias("prior_value"))
    met = current.join(prior, ["stock_code", "target_table", "target_field", "period_scope", "prior_year", "prior_period"])
    grown = met.select(
        "run_id", *KEY, "target_table", F.col("growth_field").alias("target_field"), growth(F.col("standard_value").cast("double"), F.col("prior_value").cast("double")).cast("decimal(24,6)").alias("standard_value"),
        F.lit("%").alias("standard_unit"), "period_scope", F.lit(True).alias("is_derived"), F.lit(0.86).cast("decimal(8,6)").alias("confidence"),
        F.concat_ws("/", "report_year", "report_period").alias("source_period_label"),
    ).where("standard_value is not null")
    return grown.join(facts.select(*KEY, "target_table", "target_field").distinct(), [*KEY, "target_table", "target_field"], "left_anti")


def issues_of(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings of the validation rules: ``run_id, rule_name, status, target_table, target_field``.

    ``runs``: ``run_id, page_count, pages, tables`` (declared and stored pages, stored tables).
    """
    spark = facts.sparkSession
    required = F.array(*[F.struct(F.lit(t).alias("target_table"), F.lit(f).alias("target_field")) for t, fs in catalog.REQUIRED.items() for f in fs])
    units = F.broadcast(catalog.fields_table(spark).select(F.col("table_name").alias("target_table"), F.col("field_name").alias("target_field"), F.col("unit").alias("expected_unit")))
    none = [F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("string").alias("target_field")]
    finding = lambda df, rule, status, fields: df.select("run_id", F.lit(rule).alias("rule_name"), F.lit(status).alias("status"), *fields)
    of_fact = ["target_table", "target_field"]
    counted = runs.join(facts.groupBy("run_id").agg(F.count("*").alias("n_facts")), "run_id", "left")
    present = facts.where("standard_value is not null").select("run_id", *of_fact).distinct()
    checked = facts.join(units, of_fact, "left")
    parts = [
        finding(runs.where("page_count is not null and page_count <> pages"), "raw_page_count_match", "fail", none),
        finding(runs.where("tables = 0"), "raw_tables_present", "fail", none),
        finding(counted.where("coalesce(n_facts, 0) = 0"), "staging_rows_present", "fail", none),
        finding(runs.select("run_id", F.inline(required)).join(present, ["run_id", *of_fact], "left_anti"), "core_field_present", "warn", of_fact),
        finding(facts.where("standard_value is null"), "standard_value_present", "fail", of_fact),
        finding(facts.where("page_number is null or table_index is null"), "source_trace_present", "fail", of_fact),
        finding(facts.where("confidence < 0.70"), "confidence_threshold", "warn", of_fact),
        finding(checked.where(~checked_unit(F.col("standard_unit")).eqNullSafe(checked_unit(F.col("expected_unit")))), "standard_unit_match", "warn", of_fact),
        finding(facts.where(F.col("source_period_label").isNotNull() & ~F.col("source_period_label").rlike(PERIOD_WORDS)), "source_period_label_plausible", "warn", of_fact),
    ]
    return reduce(DataFrame.unionByName, parts)


def run_status(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """``run_id, status, fails, warns``: fail before warn before pass."""
    worst = issues.groupBy("run_id").agg(F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "warn").alias("warns"))
    out = runs.select("run_id").join(worst, "run_id", "left").fillna(0, ["fails", "warns"])
    return out.select("run_id", F.when(F.col("fails") > 0, "fail").when(F.col("warns") > 0, "warn").otherwise("pass").alias("status"), "fails", "warns")


def coverage(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct fields of a run over all fields and over the required ones: ``field_ratio, required_ratio``."""
    spark = facts.sparkSession
    fields = sum(map(len, catalog.METRICS.values()))
    needed = [(t, f) for t, fs in catalog.REQUIRED.items() for f in fs]
    required = F.broadcast(spark.createDataFrame(needed, "target_table string, target_field string").withColumn("required", F.lit(True)))
    found = facts.where("standard_value is not null").select("run_id", "target_table", "target_field").distinct().join(required, ["target_table", "target_field"], "left")
    counts = found.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("required")).alias("r"))
    return runs.select("run_id").join(counts, "run_id", "left").select("run_id", (F.coalesce("n", F.lit(0)) / fields).alias("field_ratio"), (F.coalesce("r", F.lit(0)) / len(needed)).alias("required_ratio"))


def pivoted(facts: DataFrame, fields: list[str], field: str = "target_field", value: str = "standard_value") -> DataFrame:
    """Long facts to one row per key; the field list is given, so no pass is spent on finding it."""
    return facts.groupBy(*KEY).pivot(field, fields).agg(F.first(value))


def wide_rows(facts: DataFrame, table: str, companies: DataFrame) -> DataFrame:
    """Rows of a wide table: chosen facts pivoted, values that don't fit their column null, the name from the company."""
    metrics = catalog.METRICS[table]
    wide = pivoted(promoted_choice(facts.where(F.col("target_table") == table)), metrics)
    names = companies.select("stock_code", "stock_abbr")
    return wide.join(names, "stock_code", "left").select(
        F.lit(1).alias("serial_number"), "stock_code", "stock_abbr", "report_year", "report_period", *[fits(F.col(m), *catalog.decimal_of(m)).alias(m) for m in metrics]
    )


def merged(current: DataFrame, fresh: DataFrame, keys: list[str], keep_nulls: bool = False) -> DataFrame:
    """``current`` with ``fresh`` written over it by key: a null of ``fresh`` keeps the current value, unless ``keep_nulls``.

    A column that only one side has is null on the other.
    """
    current = current.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fresh.schema if f.name not in current.columns])
    missing = [f for f in current.schema if f.name not in fresh.columns]
    fresh = fresh.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    others = [c for c in current.columns if c not in keys]
    a, b = current.alias("a"), fresh.alias("b")
    here = F.lit(True)
    tagged = b.select(*[F.col(f"b.{c}") for c in (*keys, *others)], here.alias("_fresh")).alias("b")
    on = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = a.join(tagged, on, "full_outer")
    pick = (lambda c: F.when(F.col("b._fresh"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))) if keep_nulls else (lambda c: F.coalesce(f"b.{c}", f"a.{c}"))
    return both.select(*[(F.coalesce(f"a.{c}", f"b.{c}") if c in keys else pick(c)).alias(c) for c in current.columns])


def gate(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Runs that may be promoted: those without a failure; coverage only informs."""
    return run_status(runs, issues).where("status <> 'fail'").select("run_id")


def promote(spark: SparkSession, facts: DataFrame, runs: DataFrame, companies: DataFrame, current: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All wide tables after promoting the facts of runs without failures; promoting twice changes nothing more."""
    admitted = facts.join(gate(runs, issues_of(facts, runs)), "run_id", "left_semi")
    out = {}
    for table in catalog.TABLES:
        fresh = wide_rows(admitted, table, companies)
        now = current.get(table)
        out[table] = fresh if now is None else merged(now, fresh, KEY)
    return out
