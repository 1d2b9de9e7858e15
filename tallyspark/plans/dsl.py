"""Queries as closed slots, compiled to DataFrame plans; no SQL text is ever built from what a user wrote."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import catalog

PERIODS = ("FY", "Q1", "HY", "Q2", "Q3", "Q4")
LIMITS = (1, 500)
OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "=": operator.eq,
    "!=": operator.ne,
}
KEYS = ["stock_code", "stock_abbr", "report_year", "report_period"]


class QueryError(ValueError):
    """The query lacks a slot or names something outside the catalogue."""


@dataclass(frozen=True)
class Condition:
    metric: str
    operator: str
    value: float


@dataclass(frozen=True)
class Query:
    """What to select. ``rank_scope``: ``first`` ranks within year and period before the limit, ``global`` over all rows."""

    intent: str = "metric_query"
    metrics: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    periods: tuple[str, ...] = ()
    limit: int = 100
    order_by: str | None = None
    descending: bool = True
    conditions: tuple[Condition, ...] = ()
    all_periods: bool = False
    rank_scope: str = "first"


def normal_code(code: str) -> str:
    code = code.strip()
    return code.zfill(6) if code.isascii() and code.isdigit() else code


@dataclass(frozen=True)
class Store:
    """Wide tables by name, the metrics of each and their units."""

    tables: dict[str, DataFrame]
    metrics: dict[str, list[str]] = field(default_factory=lambda: dict(catalog.METRICS))
    unit: Callable[[str], str] = catalog.unit_of

    def locate(self, metric: str) -> tuple[str, str]:
        """Table and column of a metric name, alias or ``table.metric``."""
        table, _, name = metric.partition(".")
        if name in self.metrics.get(table, ()):
            return table, name
        for t, names in self.metrics.items():
            if metric in names:
                return t, metric
        found = catalog.resolve(metric)
        if found and found.name in self.metrics.get(found.table, ()):
            return found.table, found.name
        raise QueryError(f"unknown metric: {metric}")


def checked(query: Query) -> Query:
    if not query.metrics:
        raise QueryError("a metric is needed")
    if not query.periods and not query.all_periods:
        raise QueryError("a period is needed")
    for c in query.conditions:
        if c.operator not in OPERATORS:
            raise QueryError(f"unknown operator: {c.operator}")
    return query


def selected(query: Query, store: Store) -> tuple[DataFrame, list[str]]:
    """All rows of one wide table that a query asks for, neither sorted nor cut, and the columns of its metrics.

    Equality filters come first and reach the scan.
    """
    query = checked(query)
    located = [store.locate(m) for m in query.metrics]
    if len({t for t, _ in located}) > 1:
        raise QueryError("metrics of several tables; split the query")
    table = located[0][0]
    columns = list(dict.fromkeys(c for _, c in located))
    df = store.tables[table]
    if query.codes:
        df = df.where(F.col("stock_code").isin(*sorted({normal_code(c) for c in query.codes})))
    if query.years:
        df = df.where(F.col("report_year").isin(*sorted(set(query.years))))
    if query.periods:
        df = df.where(F.col("report_period").isin(*sorted({p.upper() for p in query.periods})))
    for c in query.conditions:
        t, column = store.locate(c.metric)
        if t != table:
            raise QueryError(f"{c.metric} is not in {table}")
        df = df.where(OPERATORS[c.operator](F.col(column), F.lit(c.value)))
    order = store.locate(query.order_by or query.metrics[0])
    if query.intent == "ranking_query" and order[0] == table:
        df = df.where(F.col(order[1]).isNotNull())
    return df, columns


def cut(df: DataFrame, query: Query) -> DataFrame:
    return df.limit(max(LIMITS[0], min(LIMITS[1], query.limit)))


def compiled(query: Query, store: Store) -> DataFrame:
    """Rows of one wide table, sorted and cut.

    The sort and limit become one top-n. Rows equal in all sort columns follow their company code.
    """
    df, columns = selected(query, store)
    order = store.locate(query.order_by or query.metrics[0])
    time = [] if query.rank_scope == "global" else [F.col("report_year").asc(), F.col("report_period").asc()]
    if order[0] == store.locate(query.metrics[0])[0]:
        by = F.col(order[1])
        time.append(by.desc_nulls_last() if query.descending else by.asc_nulls_last())
    rest = [F.col(c).asc() for c in ("stock_code", "report_year", "report_period")]
    return cut(df.select(*KEYS, *columns).orderBy(*time, *rest), query)


def split(query: Query, store: Store) -> list[Query]:
    """A query for each table that its metrics belong to; conditions stay with their table, unknown metrics go."""
    parts: dict[str, list[str]] = {}
    for m in query.metrics:
        try:
            parts.setdefault(store.locate(m)[0], []).append(m)
        except QueryError:
            continue
    if not parts:
        raise QueryError("no known metric")

    def within(metric: str | None, table: str) -> bool:
        try:
            return metric is not None and store.locate(metric)[0] == table
        except QueryError:
            return False

    out = []
    for table, metrics in parts.items():
        intent = "metric_query" if query.intent == "comparison_query" else query.intent
        order = query.order_by if within(query.order_by, table) else metrics[0]
        out.append(replace(query, intent=intent, metrics=tuple(metrics), order_by=order, conditions=tuple(c for c in query.conditions if within(c.metric, table))))
    return out


def joined(query: Query, store: Store) -> DataFrame:
    """Metrics of several tables in one row per company, year and period.

    Parts meet whole, only their join is sorted and cut; null keys meet each other and come last.
    """
    keys = [k for k in KEYS if k != "stock_abbr"]
    parts = [df.select(*keys, *columns) for df, columns in (selected(q, store) for q in split(query, store))]
    out = parts[0]
    for p in parts[1:]:
        other = p.withColumnsRenamed({k: f"_{k}" for k in keys})
        met = out.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full_outer")
        metrics = [c for c in (*out.columns, *p.columns) if c not in keys]
        out = met.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], *metrics)
    return cut(out.orderBy(*[F.col(k).asc_nulls_last() for k in ("report_year", "report_period", "stock_code")]), query)


def units_of(query: Query, store: Store) -> dict[str, str]:
    return {c: store.unit(c) for _, c in map(store.locate, query.metrics)}


def json_rows(df: DataFrame) -> list[dict]:
    """Collected rows with whole decimals as int and others as float."""

    def plain(v):
        if isinstance(v, Decimal):
            return int(v) if v == v.to_integral_value() else float(v)
        return v

    return [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]


def safe_select(spark, sql: str, allowed: set[str]) -> DataFrame:
    """Runs a SQL text only if it is one query over allowed tables, judged by Spark's own parse of it."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kinds: set[str] = set()
    tables: set[str] = set()

    def walk(node) -> None:
        kinds.add(node.nodeName())
        if node.nodeName() == "UnresolvedRelation":
            tables.add(node.tableName().lower())
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next())
        inner = node.innerChildren().iterator()
        while inner.hasNext():
            child = inner.next()
            if hasattr(child, "nodeName"):
                walk(child)

    walk(plan)
    queries = {"Project", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Aggregate", "UnresolvedRelation", "SubqueryAlias", "Join", "Distinct", "UnresolvedHaving", "Union", "OneRowRelation"}
    if not kinds <= queries:
        raise QueryError(f"not allowed: {', '.join(sorted(kinds - queries))}")
    if re.search(r"\(\s*select\b", sql, re.IGNORECASE):
        raise QueryError("not allowed: subquery")
    if unknown := tables - {a.lower() for a in allowed}:
        raise QueryError(f"unknown tables: {', '.join(sorted(unknown))}")
    return spark.sql(sql)
