"""Numeric functions as Columns."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 where a side has no length or norm."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((n > 0) & (norm > 0), dot(x, y) / norm).otherwise(0.0)


_STEPS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: F.try_mod}


def _column_of(node: ast.expr) -> Column:
    if isinstance(node, ast.BinOp) and type(node.op) in _STEPS:
        return _STEPS[type(node.op)](_column_of(node.left), _column_of(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        return -_column_of(node.operand) if isinstance(node.op, ast.USub) else _column_of(node.operand)
    if isinstance(node, (ast.Constant, ast.Name, ast.Attribute)):
        return F.expr(ast.unparse(node))
    raise ValueError(f"{ast.unparse(node)!r} is no arithmetic")


def calculated(expression: str) -> Column:
    """+ - * / % and parentheses over numbers and columns, rounded down; null in rows where a
    column that divides is 0."""
    if not re.fullmatch(r"[\w\s.+\-*/%()]+", expression) or "--" in expression:
        raise ValueError(f"{expression!r} is no arithmetic")
    if re.search(r"/\s*0+(\.0*)?(?![\d.])", expression):
        raise ValueError("division by zero")
    try:
        return F.floor(_column_of(ast.parse(expression.strip(), mode="eval").body))
    except SyntaxError as e:
        raise ValueError(f"{expression!r} is no arithmetic") from e


def largest(*values: Column) -> Column:
    return F.greatest(*[F.nanvl(v.cast("double"), F.lit(None).cast("double")) for v in values])


def smallest(*values: Column) -> Column:
    return F.least(*[F.nanvl(v.cast("double"), F.lit(None).cast("double")) for v in values])


def random_int(low: int, high: int, seed: int) -> Column:
    low, high = sorted((low, high))
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    number = value.cast("string").try_cast("double")
    return F.when(number.isNull() | F.isnan(number), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), number)))


def with_row_ids(old: DataFrame, new: DataFrame, order: list[str], row_id: str = "row_id") -> DataFrame:
    """new with ids after the greatest of old, in the given order.

    Ids are dense: a sort by ranges, sizes of the ranges (a row each), then an offset."""
    placed = new.drop(row_id).orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    placed = written(placed, "row-ids")  # read twice below
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    top = old.agg(F.coalesce(F.max(F.col(row_id).cast("string").try_cast("long")), F.lit(0)).alias("_top"))
    return placed.join(F.broadcast(starts), "_part").crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_before") + F.col("_nth") + 1).alias(row_id), *[c for c in new.columns if c != row_id])
