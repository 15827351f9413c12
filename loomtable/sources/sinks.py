"""Sinks for readers: split views, index lines, prompt views, order slots, vector packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import last_rows
from ..operators.writes import placed
from .markdown import lines


def filled(columns: list[str]) -> Column:
    """Does any of the columns hold more than blanks?"""
    return F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), lambda x: F.trim(x) != "")


def index_split(df: DataFrame, key: str, index_only: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table without the columns that only its index shows, and the index: key and those
    columns, without rows that are blank in all of them."""
    return df.drop(*index_only), df.select(key, *index_only).filter(filled(index_only))


def index_lines(df: DataFrame, order: str, summary: str, code: str) -> DataFrame:
    """order, line of a table of two columns; rows without a code go."""
    return lines(df.filter(filled([code])), order, [summary, code])


def prompt_view(df: DataFrame, ddl: str, order: str, columns: list[str], last: int) -> DataFrame:
    """place, line: the table's declaration, then its last rows as `-- | a | b |` comments."""
    body = lines(last_rows(df, last, [order]), order, columns)
    nth = F.row_number().over(Window.orderBy(order))  # of `last` rows
    head = df.sparkSession.createDataFrame([(0, ddl)], "place int, line string")
    return head.unionByName(body.select(nth.alias("place"), F.concat(F.lit("-- "), "line").alias("line")))


def free_slot(used: DataFrame, order: str, size: int = 1, preferred: int = 1, low: int = 1, high: int = 99_999) -> DataFrame:
    """slot: the first of `size` free numbers in a row, from the preferred one on, else from the
    lowest; null if there is none. At most high - low + 1 numbers are put in order."""
    spark = used.sparkSession
    bounds = spark.createDataFrame([(low - 1,), (high + 1,)], f"{order} long")
    known = used.select(F.col(order).cast("long").alias(order)).filter(F.col(order).between(low, high)).union(bounds).distinct()
    gaps = known.select((F.col(order) + 1).alias("lo"), (F.lead(order).over(Window.orderBy(order)) - size).alias("hi")).filter("lo <= hi")
    first = F.greatest(F.col("lo"), F.lit(min(max(preferred, low), high - size + 1)))
    return gaps.agg(F.coalesce(F.min(F.when(first <= F.col("hi"), first)), F.min("lo")).alias("slot"))


def packs(df: DataFrame, order: str, content: Column, shard: int = 128, pack: int = 64) -> DataFrame:
    """shard, pack, first, last, n, path: rows in order, `shard` to a shard and `pack` to a pack;
    a pack's path is the digest of its rows' digests, so equal packs are one file."""
    rows = placed(df.select(order, F.sha2(content.cast("binary"), 256).alias("_digest")), [order])
    rows = rows.withColumns({"shard": F.floor(F.col("place") / shard), "pack": F.floor(F.col("place") % shard / pack)})
    made = rows.groupBy("shard", "pack").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("place", "_digest"))).alias("_rows"))  # `pack` rows
    return made.select("shard", "pack", "first", "last", "n", F.sha2(F.array_join(F.transform("_rows", lambda r: r["_digest"]), ""), 256).alias("path"))


def write_packs(df: DataFrame, order: str, content: Column, folder: str, shard: int = 128, pack: int = 64) -> DataFrame:
    """Rows as files of a shard each below folder, and the manifest beside them, written last."""
    numbered = placed(df, [order]).withColumn("shard", F.floor(F.col("place") / shard))
    numbered.write.partitionBy("shard").parquet(f"{folder}/rows")
    manifest = packs(df, order, content, shard, pack)
    manifest.write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.parquet(f"{folder}/manifest")


def result_lines(df: DataFrame, order: str) -> DataFrame:
    """order, line: a result as text, the bare value of one column, else `name: value, ...`."""
    shown = [c for c in df.columns if c != order]
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = value(shown[0]) if len(shown) == 1 else F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), value(c)) for c in shown])
    return df.select(order, line.alias("line"))
