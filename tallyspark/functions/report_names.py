"""What a report is about, read from its file name and its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.scalars import disclosed_period, disclosed_year, stock_code, text

#: Characters of a text in which its title is looked for.
HEAD = 20_000
# Title words and the period that they mean, in the order in which they are tried; file name and code forms.
TITLES = (("年年度报告", "FY"), ("年第一季度报告", "Q1"), ("年半年度报告", "HY"), ("年第三季度报告", "Q3"))
FILE_NAME = r"([0-9]{3,6})_([0-9]{8})"
WRITTEN_CODE = r"证券代码[:：]?([0-9]{6})"


def head_of(c: Column) -> Column:
    """The beginning of a text without white space."""
    return F.regexp_replace(F.substring(text(c), 1, HEAD), r"(?U)\s+", "")


def titled_period(c: Column) -> Column:
    """``report_year, report_period`` of the first kind of title that occurs, null without one."""
    head = head_of(c)
    tried = []
    for words, period in TITLES:
        year = F.nullif(F.regexp_extract(head, rf"(20[0-9]{{2}}){words}", 1), F.lit("")).try_cast("int")
        tried.append(F.when(year.isNotNull(), F.struct(year.alias("report_year"), F.lit(period).alias("report_period"))))
    return F.coalesce(*tried)


def file_report(name: Column) -> Column:
    """``stock_code, report_year, report_period, file_date`` of a name like 600000_20240430; a title in the name otherwise."""
    code = F.nullif(F.regexp_extract(name, FILE_NAME, 1), F.lit(""))
    day = F.try_to_timestamp(F.nullif(F.regexp_extract(name, FILE_NAME, 2), F.lit("")), F.lit("yyyyMMdd")).cast("date")
    titled = titled_period(name)
    return F.struct(
        stock_code(code).alias("stock_code"),
        F.when(code.isNotNull(), disclosed_year(day)).otherwise(titled["report_year"]).alias("report_year"),
        F.when(code.isNull(), titled["report_period"]).when(day.isNotNull(), disclosed_period(day)).alias("report_period"),
        day.alias("file_date"),
    )


def refined(of_file: Column, c: Column) -> Column:
    """File data with what the text says: its title replaces year and period, its code fills a missing one."""
    titled = titled_period(c)
    written = F.nullif(F.regexp_extract(head_of(c), WRITTEN_CODE, 1), F.lit(""))
    return F.struct(
        F.coalesce(of_file["stock_code"], written).alias("stock_code"),
        F.coalesce(titled["report_year"], of_file["report_year"]).alias("report_year"),
        F.coalesce(titled["report_period"], of_file["report_period"]).alias("report_period"),
        of_file["file_date"].alias("file_date"),
    )


def report_kind(code: Column, company: Column, industry: Column, stem: Column) -> Column:
    """``stock`` or ``industry``: by the metadata, else by words of the file's name."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(filled(code) | filled(company), "stock").when(filled(industry) | stem.rlike("行业|白皮书|研究报告"), "industry").otherwise("stock")
