"""A log in parts with a snapshot below them: compaction writes the state at a boundary, and a
new manifest leaves out the parts that it stands for.

A revision is a manifest (kind 'snapshot' or 'part', first and last layer, path), written and
then marked as finished; a reader takes the last finished one, so it sees the log before a
compaction or after it, never between. Files that the last manifests do not name are removed
later (changes.unreached), so a reader that has begun can end. Replay is by last writers: no
key's history is gathered. An empty log gives the empty state; a null key is a key like others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import changes

MANIFEST = "kind string, first long, last long, path string"
#: Layers kept beside the asked ones before the next compaction.
BUFFER = 20


def _publish(spark: SparkSession, folder: str, revision: int, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/revision={revision}")
    spark.createDataFrame([(revision,)], "revision long").coalesce(1).write.mode("append").json(f"{folder}/_finished")


def current(spark: SparkSession, folder: str) -> tuple[int, list[tuple]]:
    """The last finished revision and its manifest: a row for every part since the snapshot."""
    last = spark.read.schema("revision long").json(f"{folder}/_finished").agg(F.max("revision")).first()[0]
    return last, [tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{folder}/revision={last}").collect()]


def create(spark: SparkSession, folder: str) -> None:
    _publish(spark, folder, 0, [])


def append(log: DataFrame, folder: str, layer: str) -> None:
    """One more part; its layers may not lie below the snapshot (an error)."""
    spark = log.sparkSession
    revision, rows = current(spark, folder)
    path = f"{folder}/parts/{uuid.uuid4().hex}"
    log.write.parquet(path)
    span = spark.read.schema(log.schema).parquet(path).agg(F.min(layer), F.max(layer)).first()
    if span[0] is None:
        return
    if any(kind == "snapshot" and span[0] <= last for kind, _, last, _ in rows):
        raise ValueError(f"layer {span[0]} is below the snapshot")
    _publish(spark, folder, revision + 1, [*rows, ("part", int(span[0]), int(span[1]), path)])


def state(spark: SparkSession, folder: str, schema: StructType, key: str, layer: str, order: list[str], deleted: str, until: int | None = None) -> DataFrame:
    """The table after the log (schema: that of its rows), or as of a layer; an error below
    the snapshot, as the log there is gone."""
    _, rows = current(spark, folder)
    cells = [c for c in schema.names if c not in (key, layer, *order)]
    base = [(last, path) for kind, _, last, path in rows if kind == "snapshot"]
    floor = base[0][0] if base else None
    if until is not None and floor is not None and until < floor:
        raise ValueError(f"the log begins after layer {floor}")
    parts = [path for kind, first, _, path in rows if kind == "part" and (until is None or first <= until)]
    log = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    # A part may reach over the boundary: what the snapshot holds of it is not replayed again.
    log = log.filter(F.lit(True) if floor is None else F.col(layer) > floor).filter(F.lit(True) if until is None else F.col(layer) <= until)
    kept = StructType([schema[key], *[schema[c] for c in cells]])
    begin = spark.read.schema(kept).parquet(base[0][1]) if base else spark.createDataFrame([], kept)
    return changes.replay(begin, log, key, [layer, *[c for c in order if c != layer]], F.coalesce(F.expr(deleted), F.lit(False))).select(key, *cells)


def compact(spark: SparkSession, folder: str, schema: StructType, key: str, layer: str, order: list[str], deleted: str, keep: int, buffer: int = BUFFER) -> bool:
    """Whether layers before the last `keep` became a snapshot: once keep + buffer layers lie
    over the last one."""
    revision, rows = current(spark, folder)
    parts = [r for r in rows if r[0] == "part"]
    floor = max((r[2] for r in rows if r[0] == "snapshot"), default=None)
    if not parts or keep <= 0:
        return False
    begin = min(r[1] for r in parts) if floor is None else floor + 1
    top = max(r[2] for r in parts)
    if top - begin + 1 < keep + buffer:
        return False
    boundary = top - keep
    path = f"{folder}/snapshots/{uuid.uuid4().hex}"
    state(spark, folder, schema, key, layer, order, deleted, boundary).write.parquet(path)
    _publish(spark, folder, revision + 1, [("snapshot", begin, boundary, path), *[r for r in parts if r[2] > boundary]])
    return True
