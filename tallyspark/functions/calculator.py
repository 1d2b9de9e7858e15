"""A calculator: arithmetic text, checked against a white list, becomes a Column and never SQL text."""

from __future__ import annotations

import ast
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class CalculationError(ValueError):
    """The expression holds something outside the white list."""


def _modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; a zero divisor is an error, as for division."""
    return a - F.floor(a / b) * b


_BINARY: dict[type, Callable[[Any, Any], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a / b,
    ast.Pow: lambda a, b: F.pow(a, b),
    ast.Mod: _modulo,
}
_COMPARE: dict[type, Callable[[Any, Any], Column]] = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


_LISTS: dict[str, Callable[[Column], Column]] = {
    "sum": array_sum,
    "min": F.array_min,
    "max": F.array_max,
    "mean": lambda a: array_sum(a) / F.size(a),
    "median": array_median,
}


def compile_expression(text: str, variables: dict[str, Column]) -> Column:
    """``text`` over numeric or array ``variables``; numbers are doubles, ``round`` rounds half to even."""
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise CalculationError(f"not an expression: {e}") from e

    def number(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in variables:
            return variables[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return -number(node.operand) if isinstance(node.op, ast.USub) else number(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](number(node.left), number(node.right))
        if isinstance(node, (ast.List, ast.Tuple)):
            return F.array(*map(number, node.elts))
        if isinstance(node, ast.Compare) and all(type(op) in _COMPARE for op in node.ops):
            sides = [number(x) for x in (node.left, *node.comparators)]
            out = F.lit(True)
            for op, a, b in zip(node.ops, sides, sides[1:], strict=False):
                out = out & _COMPARE[type(op)](a, b)
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            return call(node.func.id, node.args)
        raise CalculationError(f"not allowed: {type(node).__name__}")

    def call(name: str, given: list[ast.expr]) -> Column:
        args = [number(x) for x in given]
        if name == "abs" and len(args) == 1:
            return F.abs(args[0])
        if name == "round" and len(args) in (1, 2):
            places = given[1].value if len(given) == 2 and isinstance(given[1], ast.Constant) else 0
            if not isinstance(places, int):
                raise CalculationError("round takes a whole number of places")
            return F.bround(args[0], places)
        if name in ("min", "max") and len(args) > 1:
            return (F.least if name == "min" else F.greatest)(*args)
        if name in _LISTS and len(args) == 1:
            return _LISTS[name](args[0])
        raise CalculationError(f"not allowed: {name}")

    return number(tree.body)
