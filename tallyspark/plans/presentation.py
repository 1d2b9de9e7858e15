"""Answers and charts from result rows."""

from __future__ import annotations

import base64
import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import period_label, period_rank, shown_value, text

#: Rows of a chart by its kind, cut before they are put in time's order; rows and metrics of an answer.
CHART_ROWS = {"line": 18, "bar": 14}
ANSWER_ROWS, ANSWER_METRICS = 8, 3
KEYS = ("stock_code", "stock_abbr", "report_year", "report_period")


def chart_series(rows: DataFrame, metric: str, kind: str) -> DataFrame:
    """``place, stock_code, report_year, report_period, y``: the result's first rows in the order of time."""
    first = rows.limit(CHART_ROWS[kind]).where(F.col(metric).isNotNull())
    order = Window.orderBy("report_year", period_rank(F.col("report_period")), "stock_code", "report_period")
    return first.select(F.row_number().over(order).alias("place"), "stock_code", "report_year", "report_period", F.col(metric).alias("y"))


def answer_rows(rows: DataFrame, units: dict[str, str]) -> DataFrame:
    """``place, line``: a line for each of the first rows with its first metrics and their units."""
    metrics = [c for c in rows.columns if c not in KEYS][:ANSWER_METRICS]
    order = [F.col("report_year"), F.col("report_period"), *[F.col(m).desc_nulls_last() for m in metrics[:1]], F.col("stock_code")]
    first = rows.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= ANSWER_ROWS)
    values = [F.concat(F.lit(f"{m} "), shown_value(F.col(m), F.lit(units.get(m, "")))) for m in metrics]
    head = F.concat(F.coalesce("stock_abbr", "stock_code"), F.lit(" "), F.col("report_year").cast("string"), period_label(text(F.col("report_period"))), F.lit("："))
    return first.select("place", F.concat(head, F.concat_ws("，", *values)).alias("line"))


def answer(rows: DataFrame, units: dict[str, str]) -> str:
    lines = [r["line"] for r in answer_rows(rows, units).orderBy("place").collect()]
    if not lines:
        return "符合条件的数量为 0。"
    return "\n".join(lines)


def bounds(values: list[float], kind: str) -> tuple[float, float]:
    """Range of the value axis: a bar's holds 0, a flat line gets room on both sides."""
    low, high = min(values), max(values)
    if kind == "bar":
        low, high = min(0.0, low), max(0.0, high)
    if low == high:
        room = max(abs(low) * 0.05, 1.0)
        low, high = low - room, high + room
    return low, high


def svg(points: list[tuple[str, float]], kind: str, title: str, width: int = 720, height: int = 320) -> str:
    """A small line or bar chart with five ticks."""
    if not points:
        return ""
    low, high = bounds([y for _, y in points], kind)
    left, top, inner_w, inner_h = 80, 30, width - 100, height - 80
    at_x = lambda i: left + inner_w * (i + 0.5) / len(points)
    at_y = lambda v: top + inner_h * (high - v) / (high - low)
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="{left}" y="18">{html.escape(title)}</text>']
    for k in range(5):
        v = low + (high - low) * k / 4
        parts.append(f'<line x1="{left}" x2="{left + inner_w}" y1="{at_y(v):.1f}" y2="{at_y(v):.1f}" stroke="#ddd"/><text x="4" y="{at_y(v):.1f}">{axis_number(v)}</text>')
    if kind == "line":
        parts.append('<polyline fill="none" stroke="#36c" points="' + " ".join(f"{at_x(i):.1f},{at_y(y):.1f}" for i, (_, y) in enumerate(points)) + '"/>')
    else:
        w = inner_w / len(points) * 0.6
        for i, (_, y) in enumerate(points):
            a, b = sorted((at_y(y), at_y(0.0)))
            parts.append(f'<rect x="{at_x(i) - w / 2:.1f}" y="{a:.1f}" width="{w:.1f}" height="{b - a:.1f}" fill="#36c"/>')
    for i, (label, _) in enumerate(points):
        parts.append(f'<text x="{at_x(i):.1f}" y="{height - 20}" text-anchor="middle">{html.escape(short(label, 14))}</text>')
    return "".join(parts) + "</svg>"


def axis_number(v: float) -> str:
    return f"{v:,.0f}" if abs(v) >= 1000 else f"{v:.2f}".rstrip("0").rstrip(".")


def short(label: str, most: int) -> str:
    return label if len(label) <= most else label[: most - 1] + "…"


def data_url(image: str) -> str:
    return "data:image/svg+xml;base64," + base64.b64encode(image.encode()).decode()


def chart(rows: DataFrame, metric: str, kind: str, title: str = "") -> str:
    """SVG of a result; labels name the company only if there are several."""
    found = chart_series(rows, metric, kind).orderBy("place").collect()
    several = len({r["stock_code"] for r in found}) > 1
    points = [(f"{r['report_year']}{r['report_period']}" + (f" {r['stock_code']}" if several else ""), float(r["y"])) for r in found]
    return svg(points, kind, title or metric)
