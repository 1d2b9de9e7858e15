"""Scalar functions of the reporting domain, each a Column of built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value", units and their factor to 10 000 yuan, period names.
NULL_TOKENS = ("", "-", "--", "—", "不适用", "无", "nan", "n/a")
UNIT_FACTORS = {"亿元": "10000", "万元": "1", "千元": "0.1", "元": "0.0001"}
PERIOD_LABELS = {"FY": "年报", "Q1": "第一季度", "HY": "半年度", "Q3": "第三季度"}
CHRONOLOGICAL = {"Q1": 1, "HY": 2, "Q3": 3, "FY": 4}

VALUE = "decimal(38,6)"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space at both ends, full-width spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalised_text(c: Column) -> Column:
    """All white space removed, lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def stock_code(c: Column) -> Column:
    """Digits are filled to six; longer codes and other texts stay."""
    t = trimmed(c)
    return F.when(t.rlike(r"^[0-9]{1,5}$"), F.lpad(t, 6, "0")).otherwise(t)


def first_parenthesis(c: Column) -> Column:
    """What the first parenthesis of either width holds, null without one."""
    return F.nullif(F.regexp_extract(c, r"[（(]([^）)]+)[）)]", 1), F.lit(""))


def numeric(c: Column) -> Column:
    """A table cell as a number, null if it isn't one.

    ASCII parentheses around a value negate it; full-width ones are only dropped. Thousands commas,
    percent signs and spaces go, full-width and mathematical minus signs count as minus.
    """
    t = trimmed(c)
    negative = t.startswith("(") & t.endswith(")")
    bare = F.regexp_replace(F.translate(t, "−－()（）,%", "--"), " ", "")
    number = F.when(bare.rlike(r"^-?\d+(\.\d+)?$"), bare.try_cast(VALUE))
    signed = F.when(negative & (number > 0), -number).otherwise(number)
    return F.when(F.lower(t).isin(*NULL_TOKENS), F.lit(None)).otherwise(signed).cast(VALUE)


def unit_name(c: Column) -> Column:
    """Unit of a label for staging: percent, then the largest named amount, else the text itself."""
    return (
        F.when(c.contains("%") | c.contains("％"), "%")
        .when(c.contains("亿元"), "亿元")
        .when(c.contains("万元"), "万元")
        .when(c.contains("千元"), "千元")
        .when(c.contains("元"), "元")
        .otherwise(trimmed(c))
    )


def checked_unit(c: Column) -> Column:
    """Unit as the validation compares it: 万元 apart, every other amount is 元."""
    return F.when(c.contains("万元"), "万元").when(c.contains("元"), "元").when(c.contains("%"), "%").otherwise(trimmed(c))


def standard_amount(value: Column, unit: Column, target: Column) -> Column:
    """Value in the target unit; only amounts bound for 万元 are converted, an unknown unit leaves the value."""
    factor = F.lit(None).cast("decimal(10,4)")
    for name, by in UNIT_FACTORS.items():
        factor = F.when(unit == name, F.lit(by).cast("decimal(10,4)")).otherwise(factor)
    return F.when(target == "万元", (value * F.coalesce(factor, F.lit(1).cast("decimal(10,4)"))).cast(VALUE)).otherwise(value).cast("decimal(24,6)")


def period_scope(table: Column, period: Column) -> Column:
    return (
        F.when(table == "balance_sheet", "point_in_time")
        .when(period == "FY", "full_year")
        .when(period.isin("HY", "Q3"), "year_to_date")
        .when(period == "Q1", "single_period")
        .otherwise("unknown")
    )


def clean_label(c: Column) -> Column:
    """A row label without white space, ordinals, 其中/加/减 and parentheses, closed or not."""
    t = F.regexp_replace(text(c), r"(?U)\s+", "")
    t = F.regexp_replace(t, r"^[（(]?[一二三四五六七八九十0-9]+[）)]?[、.．]", "")
    t = F.regexp_replace(t, r"^[（(][一二三四五六七八九十0-9]+[）)]", "")
    t = F.regexp_replace(t, r"^(其中|加|减)[:：]", "")
    return F.regexp_replace(F.regexp_replace(t, r"[（(][^）)]*[）)]", ""), r"[（(].*$", "")


def growth(current: Column, prior: Column) -> Column:
    """Percent change on the size of the prior value, null where that is 0."""
    return F.try_divide((current - prior) * 100, F.abs(prior))


def disclosed_year(day: Column) -> Column:
    """Year that a report disclosed on this day is about: until the end of April the one before."""
    return F.when(F.month(day) <= 4, F.year(day) - 1).otherwise(F.year(day))


def disclosed_period(day: Column) -> Column:
    """Period of a report disclosed on this day; the first quarter never results."""
    month = F.month(day)
    return F.when(month <= 4, "FY").when(month <= 8, "HY").when(month <= 10, "Q3").otherwise("FY")


def period_label(c: Column) -> Column:
    out = c
    for name, label in PERIOD_LABELS.items():
        out = F.when(c == name, label).otherwise(out)
    return out


def period_rank(c: Column) -> Column:
    """Order of periods within a year; others last."""
    out = F.lit(9)
    for name, rank in CHRONOLOGICAL.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def fits(value: Column, precision: int, scale: int) -> Column:
    """The value as a decimal of this size, null where it doesn't fit."""
    return F.when(F.abs(value) < F.lit(10 ** (precision - scale)), value.try_cast(f"decimal({precision},{scale})"))


def snippet(c: Column, size: int = 260) -> Column:
    """White space collapsed, cut to ``size`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))
    return F.when(F.char_length(t) > size, F.concat(F.rtrim(F.substring(t, 1, size - 1)), F.lit("…"))).otherwise(t)


def stable_id(path: Column, title: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.md5(F.concat_ws("|", path, title).cast("binary")), 1, 16))


def plain_number(c: Column) -> Column:
    """A decimal as text without trailing zeros."""
    t = c.cast("string")
    return F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)


def shown_value(c: Column, unit: Column) -> Column:
    """A number for an answer: thousands separators, up to six decimals, its unit."""
    number = F.regexp_replace(F.regexp_replace(F.format_number(c.cast("double"), 6), r"0+$", ""), r"\.$", "")
    return F.when(c.isNull(), "暂无数据").otherwise(F.concat(number, text(unit)))


def chart_number(c: Column) -> Column:
    """A number for an axis: whole from 1000 on, else up to two decimals."""
    small = F.regexp_replace(F.regexp_replace(F.format_number(F.bround(c, 2), 2), r"0+$", ""), r"\.$", "")
    return F.when(F.abs(c) >= 1000, F.format_number(F.bround(c, 0), 0)).otherwise(small)


def fenced_json(c: Column) -> Column:
    """The JSON object of a reply, with or without a code fence; null for anything else."""
    t = F.trim(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", ""))
    return F.when(t.startswith("{"), F.to_json(F.try_parse_json(t)))


def years_in(question: Column) -> Column:
    """Years of 20dd in a question, ranges filled, sorted; digits around a year make it no year."""
    span = r"(?<![0-9])(20\d{2})年?[-—~至到](20\d{2})(?![0-9])"
    low = F.regexp_extract_all(question, F.lit(span), F.lit(1))
    high = F.regexp_extract_all(question, F.lit(span), F.lit(2))
    runs = F.zip_with(low, high, lambda a, b: F.sequence(F.least(a, b).cast("int"), F.greatest(a, b).cast("int")))
    single = F.transform(F.regexp_extract_all(question, F.lit(r"(?<![0-9])(20\d{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.concat(F.flatten(runs), single)))


def asked_years(question: Column, year: int) -> Column:
    """Years of a question; relative words, counted from the reference year, replace written ones."""
    return (
        F.when(question.contains("近三年"), F.array(*[F.lit(year - k) for k in (3, 2, 1)]))
        .when(question.contains("近两年"), F.array(*[F.lit(year - k) for k in (2, 1)]))
        .when(question.contains("去年"), F.array(F.lit(year - 1)))
        .when(question.contains("前年"), F.array(F.lit(year - 2)))
        .otherwise(years_in(question))
    )


def asked_periods(question: Column, strict: bool = True) -> Column:
    """Periods of a question in the order FY, Q1, HY, Q3; ``strict`` keeps half-year words from also meaning the year."""
    rest = F.regexp_replace(question, "半年度|半年报", "中期报") if strict else question
    half = question.contains("半年") | question.contains("中报")
    named = F.array(
        F.when(rest.contains("年报") | rest.contains("年度") | rest.contains("全年"), "FY"),
        F.when(question.rlike("一季|第一季度|Q1"), "Q1"),
        F.when(half, "HY"),
        F.when(question.rlike("三季|第三季度|Q3"), "Q3"),
    )
    return F.filter(named, lambda p: p.isNotNull())


def asked_limit(question: Column, ranking: Column) -> Column:
    """Number of rows asked for; without one 10 for a ranking, else 100."""
    n = F.regexp_extract(question, r"(?i)(?:前|top\s*|最高的|最低的)(\d{1,6})", 1)
    return F.greatest(F.lit(1), F.least(F.lit(500), F.coalesce(F.nullif(n, F.lit("")).try_cast("int"), F.when(ranking, 10).otherwise(100))))
