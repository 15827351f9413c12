"""Markdown tables as rows, and rows as Markdown, lists and keyword entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_cell


def lines(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """order, line: a Markdown line for each row; null cells are empty."""
    cells = [markdown_cell(F.col(c).cast("string")) for c in columns]
    return df.select(order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def header(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}"


def write(df: DataFrame, order: str, columns: list[str], folder: str) -> None:
    """Text files whose lines, file after file, are the table in order."""
    lines(df, order, columns).orderBy(order).select("line").write.text(folder)


def parse(text: Column, n_columns: int) -> Column:
    """Cells of every body row of the Markdown tables in a text, padded or cut to n_columns."""
    found = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$"))
    body = F.filter(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda x: ~x.rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"))
    cells = F.transform(body, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda c: F.trim(c)))
    return F.transform(cells, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), n_columns)), 1, n_columns))


def records(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """order, text: `- column: value` lines of the filled cells; rows without any go."""
    filled = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))) for c in columns]
    return df.select(order, F.concat_ws("\n", *filled).alias("text")).filter("text <> ''")


def entries(df: DataFrame, row_id: str, keys: str, content: Column) -> DataFrame:
    """row_id, keywords, content: keywords split at commas, with the name before a bracket."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(keys), F.lit("")), "[,，]"), lambda k: F.trim(k)), lambda k: k != "")
    bare = F.transform(parts, lambda k: F.trim(F.regexp_replace(k, r"[(（].*$", "")))
    return df.select(row_id, F.array_distinct(F.filter(F.concat(parts, bare), lambda k: k != "")).alias("keywords"), content.alias("content"))
