"""Stored states of a keyed table with a hash tree, so that two states are compared where they
differ and equal parts are not read.

Rows go to 16 ** LEVELS leaves by a hash of their key; a leaf's mark is the sums of two 64-bit
hashes of its rows (so 128 bits), a node's mark the sums of its leaves. Sums don't depend on the
order of rows, tell a row from the same row twice, and combine before the shuffle, so neither a
hot key nor a full leaf is gathered. Rows are stored in a folder for each node under the root,
in the order of leaves.

A null key is a key like others; an empty state has no nodes; columns count by name, a null
cell is not an empty text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEVELS = 3
#: Children of a node, and folders of a state.
FANOUT = 16
NODES = "level int, node long, n long, mark string"
FACTS = "n long, n_unstable long"


def _cells(columns: list[str]) -> list[Column]:
    return [x for c in sorted(columns) for x in (F.lit(c), F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]


def store(df: DataFrame, key: list[str], folder: str, levels: int = LEVELS) -> None:
    """df with its tree and facts in folder; n_unstable counts rows with a blank key or one
    that an earlier row has."""
    spark, width = df.sparkSession, FANOUT**levels
    leaf = F.pmod(F.xxhash64(*[x for k in key for x in (F.col(k).isNull(), F.coalesce(F.col(k).cast("string"), F.lit("")))]), F.lit(width))
    placed = df.withColumn("_leaf", leaf).withColumn("_top", F.floor(F.col("_leaf") / (width // FANOUT)).cast("int"))
    # Rows of one leaf may be many (a repeated key), so the cut goes through them as well.
    ordered = placed.repartitionByRange(F.col("_leaf"), F.xxhash64(*_cells(df.columns))).sortWithinPartitions("_leaf")
    ordered.write.partitionBy("_top").parquet(f"{folder}/rows")
    rows = read(spark, folder, df.schema, with_leaf=True)
    cells = _cells(df.columns)
    summed = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)"))
    leaves = rows.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n"), summed(0).alias("x"), summed(1).alias("y"))
    places = F.array(*[F.struct(F.lit(level).alias("level"), F.floor(F.col("_leaf") / FANOUT ** (levels - level)).alias("node")) for level in range(levels + 1)])
    nodes = leaves.select(F.inline(places), "n", "x", "y").groupBy("level", "node").agg(F.sum("n").alias("n"), F.concat_ws(":", F.sum("x").cast("string"), F.sum("y").cast("string")).alias("mark"))
    nodes.write.partitionBy("level").parquet(f"{folder}/tree")
    blank = reduce(lambda x, y: x | y, [F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) == "" for k in key])
    each = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select("n", F.when(blank, F.col("n")).otherwise(F.col("n") - 1).alias("_more"))
    each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_more"), F.lit(0)).alias("n_unstable")).write.parquet(f"{folder}/facts")


def read(spark: SparkSession, folder: str, schema: StructType, leaves: DataFrame | None = None, with_leaf: bool = False) -> DataFrame:
    """The stored rows, of some leaves (_leaf, _top) or all. Folders without such a leaf are
    not opened, and leaves stand in order, so row groups are skipped as well."""
    rows = spark.read.schema(StructType([*schema.fields, *spark.createDataFrame([], "_leaf long, _top int").schema.fields])).parquet(f"{folder}/rows")
    if leaves is not None:
        tops = [r["_top"] for r in leaves.select("_top").distinct().collect()]  # FANOUT at most
        near = F.broadcast(leaves.select("_leaf"))  # FANOUT ** LEVELS rows at most
        rows = rows.filter(F.col("_top").isin(tops)).join(near, "_leaf", "left_semi")
    return rows.select(*schema.names, *(["_leaf"] if with_leaf else []))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{folder}/tree")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FACTS).parquet(f"{folder}/facts")


def root(spark: SparkSession, folder: str) -> str:
    """The mark of the whole state; of an empty one the empty text."""
    found = nodes(spark, folder).filter("level = 0").first()
    return found["mark"] if found else ""


def differing(spark: SparkSession, a: str, b: str, levels: int = LEVELS) -> DataFrame:
    """_leaf, _top of the leaves that differ between the states in folders a and b, found from
    the root down: a level's nodes are compared only under a parent that differs."""
    x, y = nodes(spark, a), nodes(spark, b)
    under = None
    for level in range(levels + 1):
        of = lambda t: t.filter(F.col("level") == level).select("node", "mark")  # noqa: E731, B023
        if under is not None:
            parent = F.floor(F.col("node") / FANOUT)
            x_here, y_here = (of(t).join(under, parent == F.col("_parent"), "left_semi") for t in (x, y))
        else:
            x_here, y_here = of(x), of(y)
        both = x_here.join(y_here.withColumnRenamed("mark", "_other"), "node", "full_outer").filter(~F.col("mark").eqNullSafe(F.col("_other")))
        under = both.select(F.col("node").alias("_parent"))
    return under.select(F.col("_parent").alias("_leaf"), F.floor(F.col("_parent") / FANOUT ** (levels - 1)).cast("int").alias("_top"))
