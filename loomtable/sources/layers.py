"""A keyed table as a base and deltas of content-addressed packs, merged when read.

Rows in key order are cut into packs of at most `pack_rows`; a pack ends behind a key whose crc32
says so, so a change moves no pack but its own and equal stretches of two versions are one file.
A pack's file is named by the sha256 of its bytes: writing it again changes nothing, so a task
that runs twice leaves no trace. A revision is a manifest (layer, n, first, last, digest,
n_bytes, path of every pack), written and then marked as finished; readers take the last
finished one and check every pack's digest. A delta holds changed rows and tombstones; of a key
the last layer wins. With `fold_at` changed rows or more in the deltas the merged table becomes a
new base. Packs that no revision names any more can be removed (changes.unreached).

A null key is a key like others; keys repeat neither in a base nor in a delta (an error when
written); an empty table has no packs."""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..session import written

PACK_ROWS, FOLD_AT = 8192, 15
PACK = "layer int, n long, first string, last string, digest string, n_bytes long, path string"
GONE = "_gone"


def _packed(rows: DataFrame, key: str, folder: str, layer: int, pack_rows: int) -> DataFrame:
    """The manifest rows of one layer, once its packs are written."""
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"a {key} repeats")
    at = rows.columns.index(key)
    names = [x.split()[0] for x in PACK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)

        def closed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table, raw = pa.Table.from_batches(parts).combine_chunks(), io.BytesIO()
            pq.write_table(table, raw, compression="zstd")
            data = raw.getvalue()
            digest = hashlib.sha256(data).hexdigest()
            path = f"{base}/packs/{digest[:2]}/{digest}.parquet"
            if store.get_file_info(path).type == fs.FileType.NotFound:
                store.create_dir(path.rpartition("/")[0], recursive=True)
                temporary = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary, compression=None) as out:
                    out.write(data)
                store.move(temporary, path)
            return pa.RecordBatch.from_pylist([dict(zip(names, (layer, table.num_rows, str(table.column(at)[0].as_py()), str(table.column(at)[-1].as_py()), digest, len(data), path), strict=True))], pa.schema([("layer", pa.int32()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("path", pa.string())]))

        parts, n = [], 0
        for batch in batches:
            begin = 0
            for i, value in enumerate(batch.column(at).to_pylist()):
                n += 1
                if n == pack_rows or zlib.crc32(str(value).encode()) % max(1, pack_rows // 2) == 0:
                    yield closed([*parts, batch.slice(begin, i + 1 - begin)])
                    parts, n, begin = [], 0, i + 1
            if begin < batch.num_rows:
                parts.append(batch.slice(begin))
        if parts:
            yield closed(parts)

    placed = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    return written(placed.mapInArrow(run, PACK), "packs")


def _publish(manifest: DataFrame, folder: str, revision: int) -> None:
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/revision={revision}")
    manifest.sparkSession.createDataFrame([(revision,)], "revision long").coalesce(1).write.mode("append").json(f"{folder}/_finished")


def current(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The last finished revision and its manifest."""
    last = spark.read.schema("revision long").json(f"{folder}/_finished").agg(F.max("revision")).first()[0]
    return last, spark.read.schema(PACK).parquet(f"{folder}/revision={last}")


def _rows(manifest: DataFrame, schema: StructType, folder: str) -> DataFrame:
    """The rows of the manifest's packs with their layer, every pack checked."""
    whole = StructType([StructField("_layer", manifest.schema["layer"].dataType), *schema.fields, StructField(GONE, BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for layer, digest, path in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{path} is not what the manifest says")
                for part in pq.read_table(io.BytesIO(data)).to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([layer] * part.num_rows, pa.int32()), *part.columns], names=["_layer", *part.schema.names])

    spread = manifest.select("layer", "digest", "path").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(run, whole)


def read(spark: SparkSession, folder: str, schema: StructType, key: str) -> DataFrame:
    """The table as of the last finished revision."""
    cells = [c for c in schema.names if c != key]
    rows = _rows(current(spark, folder)[1], schema, folder)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*cells, GONE), "_layer").alias("_last"))
    return last.filter(f"NOT _last.{GONE}").select(*[F.col(key) if c == key else F.col(f"_last.{c}").alias(c) for c in schema.names])


def write_base(df: DataFrame, key: str, folder: str, revision: int = 0, pack_rows: int = PACK_ROWS) -> None:
    _publish(_packed(df.withColumn(GONE, F.lit(False)), key, folder, 0, pack_rows), folder, revision)


def write_delta(changes: DataFrame, key: str, folder: str, schema: StructType, fold_at: int = FOLD_AT, pack_rows: int = PACK_ROWS) -> bool:
    """One more revision with changes (key, op 'upsert' or 'delete', cells) as a layer, or, with
    fold_at changed rows or more by now, with a new base; whether it folded."""
    spark = changes.sparkSession
    revision, manifest = current(spark, folder)
    known = manifest.agg(F.max("layer").alias("top"), F.sum(F.when(F.col("layer") > 0, F.col("n"))).alias("n")).first()
    rows = changes.select(*schema.names, (F.col("op") == "delete").alias(GONE))
    added = _packed(rows, key, folder, (known["top"] or 0) + 1, pack_rows)
    every = manifest.unionByName(added)
    changed = (known["n"] or 0) + (added.agg(F.sum("n")).first()[0] or 0)
    _publish(every, folder, revision + 1)
    if changed < fold_at:
        return False
    write_base(written(read(spark, folder, schema, key), "folded"), key, folder, revision + 2, pack_rows)
    return True
