"""What the operators of this folder share: tables, staged results, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session that names none (a test) gets a temporary folder; elsewhere executors
    could not read it, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(spark, "_own_shared_dir", None):
        spark._own_shared_dir = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return spark._own_shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, kind: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and
    a lost executor costs a read of that table, not the work that made it."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none of a null or blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


_KEPT: dict = {}


def kept_in_worker(key, make):
    """What make() gave the first time this Python worker was asked for key."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]
