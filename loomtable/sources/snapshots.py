"""Snapshots: tables as Parquet with a manifest, as cells, and versions behind a pointer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CELL = "table string, row long, place int, name string, value string"


def save(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as Parquet below folder; the manifest (name, n_columns, schema), which is
    written last: a snapshot without one is not there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame([(n, len(d.columns), d.schema.json()) for n, d in tables.items()], "name string, n_columns int, schema string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    return manifest


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    rows = spark.read.schema("name string, n_columns int, schema string").json(f"{folder}/_manifest").collect()  # a row a table
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{folder}/{r['name']}") for r in rows}


def to_cells(df: DataFrame, name: str, row_id: str) -> DataFrame:
    """A row for each cell, values as strings; binary ones as [BLOB]."""
    value = lambda f: F.when(F.col(f.name).isNotNull(), F.lit("[BLOB]")) if f.dataType.simpleString() == "binary" else F.col(f.name).cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("name"), value(f).alias("value")) for i, f in enumerate(df.schema)])
    return df.select(F.lit(name).alias("table"), F.col(row_id).cast("long").alias("row"), F.inline(cells))


def from_cells(cells: DataFrame, schema: StructType) -> DataFrame:
    """Rows of a declared schema; a cell that its type can't hold is null."""
    of_row = cells.groupBy("table", "row").agg(*[F.max(F.when(F.col("name") == f.name, F.col("value"))).try_cast(f.dataType).alias(f.name) for f in schema])
    return of_row.select(*schema.names)


def unmapped(cells: DataFrame, schema: StructType) -> DataFrame:
    """name, n: filled cells under names the schema lacks; a load that would drop any fails."""
    return cells.filter(~F.col("name").isin(schema.names) & (F.trim(F.coalesce("value", F.lit(""))) != "")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def publish(df: DataFrame, folder: str, version: int) -> None:
    """A new version of a table; the pointer to it is written once it is whole."""
    df.write.parquet(f"{folder}/version={version}")
    df.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{folder}/_finished")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest finished version."""
    last = spark.read.schema("version long").json(f"{folder}/_finished").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder}/version={last}")


def load_sheet(cells: DataFrame, schema: StructType) -> DataFrame:
    """A sheet's cells in a declared schema; where a filled cell doesn't fit its type, in one
    of strings."""
    typed = from_cells(cells, schema)
    plain = StructType([StructField(f.name, StringType(), True, f.metadata) for f in schema])
    asked = from_cells(cells, plain)
    checks = [F.count_if((F.trim(F.col(f.name)) != "") & F.col(f.name).try_cast(f.dataType).isNull()) for f in schema]
    lost = asked.agg(sum(checks[1:], checks[0]).alias("n")).first()["n"]
    return asked if lost else typed


SHEET = "struct<name: string, orderNo: double, content: array<array<string>>>"


def sheets_of(texts: DataFrame, column: str) -> DataFrame:
    """sheet, name, order_no, content of every `sheet_` entry in JSON texts; other entries go.
    Texts that are no JSON have none."""
    entries = texts.select(F.explode(F.from_json(column, "map<string, string>")).alias("sheet", "_t")).filter(F.col("sheet").startswith("sheet_"))
    return entries.withColumn("_v", F.from_json("_t", SHEET)).select("sheet", "_v.name", F.col("_v.orderNo").alias("order_no"), "_v.content")


def cells_of(sheets: DataFrame) -> DataFrame:
    """The sheets' cells (table, row, place, name, value) by their header rows."""
    header = F.get("content", F.lit(0))
    rows = sheets.select(F.col("sheet").alias("table"), header.alias("_h"), F.posexplode("content").alias("row", "_r")).filter("row > 0")
    pairs = F.filter(F.transform(F.arrays_zip(F.col("_h").alias("name"), F.col("_r").alias("value")), lambda c, i: F.struct(i.alias("place"), c["name"].alias("name"), c["value"].alias("value"))), lambda c: c["name"].isNotNull())
    return rows.select("table", F.col("row").cast("long").alias("row"), F.inline(pairs))


def write_checkpoint(tables: dict[str, tuple[DataFrame, str]], folder: str) -> None:
    """Tables (with their row ids) as cells in JSON lines, and a manifest that is written last."""
    spark = next(iter(tables.values()))[0].sparkSession
    for name, (df, row_id) in tables.items():
        to_cells(df, name, row_id).write.mode("overwrite").json(f"{folder}/{name}")
    manifest = [(n, df.schema.json()) for n, (df, _) in tables.items()]
    spark.createDataFrame(manifest, "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")


def restore_checkpoint(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    rows = spark.read.schema("name string, schema string").json(f"{folder}/_manifest").collect()  # a row a table
    return {r["name"]: from_cells(spark.read.schema(CELL).json(f"{folder}/{r['name']}"), StructType.fromJson(json.loads(r["schema"]))) for r in rows}
