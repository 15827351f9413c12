"""Replay of a log that mixes rows, cells, replacements and changes of columns.

A log row has the place (message, seq, op, part), a kind, sheet, row_id, cells (column to value),
and for a column name and to:

- row_upsert: the row is as its cells say, whatever it was; row_delete: it is gone
- cell_edit: some cells of a row, which says nothing if the row is not there
- sheet_replace, data_replace: nothing before holds for the sheet, or for any; the new rows
  follow as row_upserts at the same place with later parts, so a large one is many log rows
- column_rename (name to to), column_add (name, with to in the rows that are there), column_drop

Nothing is folded row after row. A sheet's last replacement is a maximum and begins its segment;
a row's last upsert or delete is a maximum in it; of a cell the last writer behind that wins.
Each cell's column is carried to its last name through the sheet's later column changes, which
are one array a sheet (they are few; it is the one thing gathered). Equal rows under one place
are one; a null row_id is a row's like others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

PLACE = ["message", "seq", "op", "part"]
KINDS = ("row_upsert", "row_delete", "cell_edit", "sheet_replace", "data_replace", "column_rename", "column_add", "column_drop")


def _carried(name: Column, changes: Column, at: Column) -> Column:
    """The last name of a column written as `name` at a place; null if it was dropped."""

    def step(now: Column, change: Column) -> Column:
        mine = now == change["name"]
        return F.when(mine & (change["kind"] == "column_rename"), change["to"]).when(mine & (change["kind"] == "column_drop"), F.lit(None).cast("string")).otherwise(now)

    return F.aggregate(F.filter(changes, lambda c: c["at"] > at), name.cast("string"), step)


def live(log: DataFrame) -> DataFrame:
    """The log behind each sheet's last replacement, with `at` for its place."""
    log = log.withColumn("at", F.struct(*PLACE))
    sheets = log.filter("kind = 'sheet_replace'").groupBy("sheet").agg(F.max("at").alias("_own"))
    everything = log.filter("kind = 'data_replace'").agg(F.max("at").alias("_all"))  # one row
    known = log.filter("kind NOT IN ('sheet_replace', 'data_replace')").join(sheets.withColumnRenamed("sheet", "_sheet"), F.col("sheet").eqNullSafe(F.col("_sheet")), "left").crossJoin(F.broadcast(everything))
    begin = F.greatest("_own", "_all")
    return known.filter(begin.isNull() | (F.col("at") > begin)).drop("_sheet", "_own", "_all")


def replayed(log: DataFrame, until: Column | None = None) -> DataFrame:
    """sheet, row_id, column, value: the cells after the log, or after its rows where `until`
    holds (as of a message)."""
    unknown = log.filter(~F.col("kind").isin(*KINDS) | F.col("kind").isNull()).select("kind").limit(1).collect()
    if unknown:
        raise ValueError(f"{unknown[0].kind!r} is no kind of log row")
    now = written(live(log.filter(until) if until is not None else log), "log-live")
    changes = now.filter(F.col("kind").startswith("column_")).groupBy(F.coalesce("sheet", F.lit("\0")).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("at", "kind", "name", "to"))).alias("_changes"))
    row = ["_s", "_r"]
    rows = now.filter("kind IN ('row_upsert', 'row_delete', 'cell_edit')").withColumns({"_s": F.coalesce("sheet", F.lit("\0")), "_r": F.coalesce("row_id", F.lit("\0"))})
    whole = F.when(F.col("kind") != "cell_edit", F.struct("at", "kind"))
    last = rows.groupBy(*row).agg(F.max(whole).alias("_last"), F.first("sheet").alias("sheet"), F.first("row_id").alias("row_id")).filter("_last.kind = 'row_upsert'")
    last = last.join(changes, "_s", "left").withColumn("_changes", F.coalesce("_changes", F.array().cast(changes.schema["_changes"].dataType)))
    last = written(last.select(*row, "sheet", "row_id", F.col("_last.at").alias("_at"), "_changes"), "log-rows")
    cells = rows.select(*row, "at", F.explode("cells").alias("column", "value")).join(last, row).filter("at >= _at")
    cells = cells.select(*row, "sheet", "row_id", "at", _carried(F.col("column"), F.col("_changes"), F.col("at")).alias("column"), "value")
    added = F.filter("_changes", lambda c: (c["kind"] == "column_add") & (c["at"] > F.col("_at")))
    given = last.select(*row, "sheet", "row_id", "_changes", F.explode(added).alias("_c"))
    given = given.select(*row, "sheet", "row_id", F.col("_c.at").alias("at"), _carried(F.col("_c.name"), F.col("_changes"), F.col("_c.at")).alias("column"), F.col("_c.to").alias("value"))
    every = cells.unionByName(given).filter("column IS NOT NULL")
    return every.groupBy(*row, "column").agg(F.first("sheet").alias("sheet"), F.first("row_id").alias("row_id"), F.max_by("value", "at").alias("value")).select("sheet", "row_id", "column", "value")
