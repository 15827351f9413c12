"""Streams: count-based triggers, suppressed repeats, windows, sessions, joins of streams, and
tables kept from logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import last_writes
from ..session import new_folder


def counted(stream: DataFrame, key: str, frequency: int) -> DataFrame:
    """key, batch, n: a row whenever a key has gathered `frequency` more rows. The state is a
    count a key; rows are counted by batch first, as numbers, not gathered."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, left = state.get if state.exists else (0, 0)
        left += sum(len(p) for p in parts)
        full, left = divmod(left, frequency)
        state.update((done + full, left))
        yield pd.DataFrame({key: [k[0]] * full, "batch": range(done, done + full), "n": [frequency] * full})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, batch long, n long", "done long, left long", "append", GroupStateTimeout.NoTimeout)


def without_repeats(stream: DataFrame, time: str, keys: list[str], seconds: int = 8) -> DataFrame:
    """The first row of equal keys within some seconds."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def closed(stream: DataFrame, time: str, end: str = "9999-01-01", **others) -> DataFrame:
    """stream with one row at the end of time behind all others, so that the watermark passes
    every window and session. Its other columns are null but for `others`: a join needs a key
    there that is not null and no row's, as rows with a null key never reach its watermark."""
    spark = stream.sparkSession
    folder = new_folder(spark, "end-marker")
    values = others | {time: end}
    spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema]).write.parquet(folder)
    return stream.union(spark.readStream.schema(stream.schema).parquet(folder))


def windowed(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by tumbling window; rows later than `late` are dropped by the watermark."""
    w = F.window(time, width)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """start, last, keys, n: rows of equal keys less than `gap` apart are one session."""
    w = F.session_window(time, gap)
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(w.alias("w"), *keys).agg(F.max(time).alias("last"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "last", *keys, "n")


def interval_joined(left: DataFrame, right: DataFrame, keys: list[str], time: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """Rows of left with the rows of right of equal keys that come at the same time or up to
    `within` later. Both are streams with columns keys and time, the other columns' names
    differ; right's time is called `<time>_right`. State is kept for `within` and `late` only.
    With how='leftOuter' a row without a partner comes out (nulls) once the watermark has passed
    its interval."""
    a = left.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).alias("a")
    b = right.withColumns({time: F.col(time).cast("timestamp")}).withColumnsRenamed({time: f"{time}_right", **{k: f"_{k}" for k in keys}}).withWatermark(f"{time}_right", late).alias("b")
    near = (F.col(f"{time}_right") >= F.col(time)) & (F.col(f"{time}_right") <= F.col(time) + F.expr(f"interval {within}"))
    on = near
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])


class _DueFloors(StatefulProcessor):
    """The floors of one key: a clock, how many are recorded, and a list of those that wait."""

    def __init__(self, key: str, frequency: int, skip: int, window: int, time: str | None, idle_ms: int):
        self.key, self.frequency, self.skip, self.window, self.time, self.idle_ms = key, frequency, skip, window, time, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "floors long, recorded long")
        self.waiting = handle.getListState("waiting", "floor long")

    def _rows(self, key, floors: list[int]) -> pd.DataFrame:
        found = [(key, len(floors), floors[0], floors[-1])] if floors else []
        return pd.DataFrame(found, columns=[self.key, "n_due", "first", "last"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        floors, recorded = self.clock.get() if self.clock.exists() else (0, 0)
        waiting = [x[0] for x in self.waiting.get()]
        fresh, last = 0, None
        for part in rows:
            fresh += len(part)
            if self.time:
                last = max(x for x in (last, part[self.time].max()) if x is not None)
        waiting += range(floors + 1, floors + fresh + 1)
        floors += fresh
        done = floors - self.skip
        out: list[int] = []
        if done - recorded >= self.frequency:
            out = [x for x in waiting if done - self.window < x <= done]
            recorded = done
        waiting = [x for x in waiting if x > max(recorded, done - self.window)]  # what is older can't be due any more
        self._keep(floors, recorded, waiting)
        if last is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.idle_ms)
        yield self._rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        floors, recorded = self.clock.get()
        out = [x[0] for x in self.waiting.get() if x[0] > recorded][-self.window :]
        self._keep(floors, floors, [])
        yield self._rows(key[0], out)

    def _keep(self, floors: int, recorded: int, waiting: list[int]) -> None:
        self.clock.update((floors, recorded))
        if waiting:
            self.waiting.put([(x,) for x in waiting])
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def due_floors(stream: DataFrame, key: str, frequency: int, skip: int, window: int, time: str | None = None, idle_seconds: int = 0, late: str = "0 seconds") -> DataFrame:
    """key, n_due, first, last: as ordered.due, micro-batch by micro-batch. A key's rows are its
    floors, numbered as they come. With `frequency` unrecorded floors, less the newest `skip`
    which wait, those of the last `window` are due, and all up to them are recorded; the state
    holds `window + skip` floors at most. With a time, a timer makes what is left of a key due, the
    newest included, once the watermark is idle_seconds behind the key's last row."""
    kind = stream.schema[key].dataType.simpleString()
    processor = _DueFloors(key, frequency, skip, window, time, idle_seconds * 1000)
    mode = "none" if time is None else "eventTime"
    if time:
        stream = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stream.select(key, *([time] if time else [])).groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, n_due long, first long, last long", "append", mode)


def keep_table(stream: DataFrame, key: str, order: list[str], cells: list[str], deleted: str, folder: str, checkpoint: str):
    """Maintains the last writes of a log as versions below folder, one a batch: each is the
    version before with the batch's log rows on it. A batch run twice writes the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, *order, *cells, F.expr(deleted).alias("_gone"))
        if number:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{folder}/version={number - 1}"))
        last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_l"))
        last.select(key, "_l.*").select(*rows.columns).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_of(spark, schema, folder: str, key: str, order: list[str], cells: list[str], last: int) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{folder}/version={last}")
    return last_writes(rows, key, order, cells, F.col("_gone"))


#: Lists and timers of a key need this store.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", rocks: bool = False) -> DataFrame:
    """Runs a stream over what there is by now, from where the checkpoint ends; all rows so far."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    try:
        if rocks:
            spark.conf.set(STORE, ROCKS)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def collected(stream: DataFrame, kind: str, mode: str = "append", rocks: bool = False) -> DataFrame:
    """Runs a stream to the end of what there is; its rows as a table."""
    spark = stream.sparkSession
    return run_to_end(stream, new_folder(spark, kind), new_folder(spark, f"{kind}-state"), mode, rocks)
