"""The driver's tables in the shape of the engine's data model: companies, wide facts, long facts, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,4)"
KEY = ["stock_code", "report_year", "report_period"]
#: Metrics of the wide panel and the table that each belongs to.
PANEL_METRICS = {"revenue": "income_sheet", "cost": "income_sheet", "tax": "income_sheet", "quantity": "core_performance_indicators_sheet"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return c.cast(MONEY)


def code_of(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 6, "0")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company dimension from suppliers: code, short name, exchange (region) and industry (nation)."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(code_of("s_suppkey").alias("stock_code"), F.col("s_name").alias("stock_abbr"), F.col("r_name").alias("exchange"), F.col("n_name").alias("industry"))
    )


def quarter_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company, year and quarter (Q1 to Q4) with exact decimal sums."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    price, discount, tax = (F.col(c).cast("decimal(12,2)") for c in ("l_extendedprice", "l_discount", "l_tax"))
    net = money(price * (F.lit(1).cast("decimal(12,2)") - discount))
    return (
        li.select(
            code_of("l_suppkey").alias("stock_code"),
            F.year("l_shipdate").alias("report_year"),
            F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string")).alias("report_period"),
            net.alias("revenue"),
            money(net * F.lit("0.6").cast("decimal(2,1)")).alias("cost"),
            money(price * tax).alias("tax"),
            F.col("l_quantity").cast("decimal(12,2)").alias("quantity"),
        )
        .groupBy(*KEY)
        .agg(*[money(F.sum(m)).alias(m) for m in PANEL_METRICS])
    )


def wide_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters and full years (FY) of every company."""
    quarters = quarter_facts(spark, sf_dir)
    years = quarters.groupBy("stock_code", "report_year").agg(*[money(F.sum(m)).alias(m) for m in PANEL_METRICS])
    return quarters.unionByName(years.withColumn("report_period", F.lit("FY")).select(*KEY, *PANEL_METRICS))


def staging_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts: the panel unpivoted, run 1 as extracted and run 2 derived, with a confidence from the key's MD5.

    Run 2 repeats the facts whose hash begins with 0 to 7 and differs by 1 in value.
    """
    long = wide_facts(spark, sf_dir).unpivot(KEY, list(PANEL_METRICS), "target_field", "standard_value")
    tag = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in KEY], F.col("target_field")).cast("binary"))
    first = long.select(
        F.lit(1).cast("long").alias("run_id"),
        *KEY,
        "target_field",
        "standard_value",
        F.lit(False).alias("is_derived"),
        F.when(F.substring(tag, 1, 1) < "4", 0.6).otherwise(0.9).alias("confidence"),
        tag.alias("tag"),
    )
    second = first.where(F.substring("tag", 1, 1) < "8").select(
        F.lit(2).cast("long").alias("run_id"), *KEY, "target_field", money(F.col("standard_value") + 1).alias("standard_value"), F.lit(True).alias("is_derived"), F.lit(0.88).alias("confidence"), "tag"
    )
    return first.unionByName(second)


#: One raw table of a statement, as a document yields it.
TABLE_TYPE = T.StructType(
    [
        T.StructField("page_number", T.IntegerType()),
        T.StructField("table_index", T.IntegerType()),
        T.StructField("section_title", T.StringType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("page_text", T.StringType()),
        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
