"""Writes as new DataFrames: statements with their row counts, rows by place, strict edits.

Nothing is changed in place: a write gives the table after it and a one-row frame that counts
the rows it touched. A condition that is null touches no row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import with_row_ids
from ..session import written

KINDS = ("insert", "replace", "update", "delete")


def mutated(df: DataFrame, kind: str, where: Column | None = None, changes: dict[str, Column] | None = None, rows: DataFrame | None = None, key: str | None = None, hidden: tuple[str, ...] = (), order: list[str] | None = None, defaults: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after an insert or replace of rows (by key), or an update or delete of the rows
    where a condition holds; and (affected). Hidden columns can't be written. Columns that rows
    don't have take their default, else null. An insert of a key that is there, or twice among
    rows, is an error and changes nothing; so is a replace by rows with a repeated key, unless
    `order` (columns of rows alone) says which is the last, which wins."""
    if kind not in KINDS:
        raise ValueError(f"{kind!r} is no write of rows")
    written = set(changes or {}) | (set(rows.columns) if rows is not None else set())
    if refused := sorted(written & set(hidden)):
        raise ValueError(f"hidden columns can't be written: {', '.join(refused)}")
    if unknown := sorted(written - set(df.columns) - set(order or ())):
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    if kind in ("insert", "replace"):
        if key is not None:
            if kind == "replace" and order:
                cells = [c for c in rows.columns if c != key]
                rows = rows.groupBy(key).agg(F.max_by(F.struct(*cells), F.struct(*order)).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in cells])
            elif not rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
                raise ValueError(f"rows repeat a {key}")
            if kind == "insert" and not df.select(key).join(rows.select(key), key, "left_semi").isEmpty():
                raise ValueError(f"a {key} is there already")
        old = df.join(rows.select(key), key, "left_anti").select(*df.columns) if kind == "replace" else df
        new = rows.drop(*(order or ())).withColumns({c: d.cast(df.schema[c].dataType) for c, d in (defaults or {}).items() if c not in rows.columns})
        return old.unionByName(new, allowMissingColumns=True).select(*df.columns), new.agg(F.count(F.lit(1)).alias("affected"))
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    affected = df.agg(F.count_if(hit).alias("affected"))
    if kind == "delete":
        return df.filter(~hit), affected
    new = [F.when(hit, changes[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns]
    return df.select(*new), affected


def seeded(df: DataFrame, seed: DataFrame) -> DataFrame:
    """df, or the seed rows if it has none."""
    filled = df.limit(1).agg(F.count(F.lit(1)).alias("_filled"))  # one row
    return df.unionByName(seed.crossJoin(F.broadcast(filled)).filter("_filled = 0").drop("_filled"))


def placed(df: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """df with each row's place from 0, numbered by ranges."""
    numbered = with_row_ids(df.select(F.lit(0).cast("long").alias(place)).limit(0), df, order, place)
    return numbered.withColumn(place, F.col(place) - 1)


def at_places(df: DataFrame, order: list[str], key: str, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits by 0-based place: (place, column, value, seq) sets a cell, a null column deletes the
    row. Of several edits of a cell the last by seq wins (without a
    seq: the greatest value). The table after them, and the edits
    (place, column, value) that meet no row or no column, or would change the key."""
    of = placed(df.select(key, *[c for c in order if c != key]), order).select("place", key)
    known = edits.join(of, "place", "left")
    cells_of = [c for c in df.columns if c != key]
    refused = known.filter(F.col(key).isNull() | ~(F.col("column").isNull() | F.col("column").isin(cells_of))).select("place", "column", "value")
    good = known.filter(F.col(key).isNotNull())
    kept = df.join(good.filter("column IS NULL").select(key).distinct(), key, "left_anti").select(*df.columns)
    cells = good.filter(F.col("column").isin(cells_of)).groupBy(key, "column").agg((F.max_by("value", "seq") if "seq" in edits.columns else F.max("value")).alias("value"))
    of_row = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_cells"))  # a row's columns at most
    joined = kept.join(of_row, key, "left")
    new = lambda c: F.when(F.coalesce(F.map_contains_key("_cells", F.lit(c)), F.lit(False)), F.col("_cells")[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return joined.select(*[F.col(c) if c == key else new(c) for c in df.columns]), refused


def strict_matches(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """op, n_rows, key: which row each edit means. wanted: (op, where), a map of column to value;
    an edit is good if all its values meet in exactly one row (key is null otherwise)."""
    conditions = wanted.select("op", "where", F.explode("where").alias("column", "value"))
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])
    cells = df.select(F.col(key).alias("_key"), values.alias("_row")).select("_key", "_row", F.inline("_row"))
    # Each edit asks for the condition that the fewest rows meet; the rest is looked up in the row.
    often = cells.join(conditions.select("column", "value").distinct(), ["column", "value"], "left_semi").groupBy("column", "value").agg(F.count(F.lit(1)).alias("_often"))
    rarest = written(conditions.join(often, ["column", "value"], "left").groupBy("op").agg(F.min_by(F.struct("column", "value", "where"), F.struct(F.coalesce("_often", F.lit(0)), "column")).alias("_c")).select("op", "_c.*"), "rarest-conditions")  # its size is known: the rows are not sent around
    met = cells.join(rarest, ["column", "value"]).filter(F.forall(F.map_entries("where"), lambda e: F.array_contains(F.col("_row"), F.struct(e["key"].alias("column"), e["value"].alias("value")))))
    found = met.groupBy("op").agg(F.count(F.lit(1)).alias("n_rows"), F.min("_key").alias("_key"))
    return wanted.select("op").join(found, "op", "left").select("op", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("n_rows") == 1, F.col("_key")).alias(key))


def pending(base: DataFrame, key: str, deletes: DataFrame, updates: DataFrame, inserts: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Waiting row edits on a base: deletes, then updates (null cells keep the old ones), then
    inserts, which get ids after the greatest. The table and its log rows (op, row)."""
    cells = [c for c in base.columns if c != key]
    left = base.join(deletes.select(key).distinct(), key, "left_anti")
    fresh = updates.select(key, F.struct(*cells).alias("_new"))
    both = left.join(fresh, key, "left")
    table = both.select(key, *[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) for c in cells], F.col("_new").isNotNull().alias("_changed"))
    added = with_row_ids(base, inserts, order, key).select(*base.columns).withColumn("_changed", F.lit(True))
    table = table.unionByName(added)
    gone = base.join(deletes.select(key).distinct(), key, "left_semi").select(F.lit("row_delete").alias("op"), key, *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in cells])
    log = gone.unionByName(table.filter("_changed").select(F.lit("row_upsert").alias("op"), key, *cells))
    return table.drop("_changed"), log


def change_counts(edits: DataFrame, table: str, key: str) -> DataFrame:
    """n_changes and n_keys of each table's applied edits."""
    return edits.groupBy(table).agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct(key).alias("n_keys"))


def content_patch(df: DataFrame, order: list[str], updates: list[tuple[int, str, object]], deletes: list[int], adds: list[dict[str, object]]) -> DataFrame:
    """A patch by row numbers from 1: cells, then deleted rows, then added rows (place null).
    Numbers are those before the patch. Unknown columns raise; place tells the order."""
    names = {c for _, c, _ in updates} | {c for a in adds for c in a}
    if unknown := sorted(names - set(df.columns)):
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    if bad := [n for n in [*(n for n, _, _ in updates), *deletes] if n < 1]:
        raise ValueError(f"no such rows: {bad}")
    rows = placed(df, order)

    def cell(c: str) -> Column:
        mine = [(n, v) for n, name, v in updates if name == c]
        return reduce(lambda old, e: F.when(F.col("place") == e[0] - 1, F.lit(e[1]).cast(df.schema[c].dataType)).otherwise(old), mine, F.col(c)).alias(c)

    kept = rows.select("place", *[cell(c) for c in df.columns]).filter(~F.col("place").isin([n - 1 for n in deletes]))
    if not adds:
        return kept
    made = df.sparkSession.createDataFrame([tuple(a.get(c) for c in df.columns) for a in adds], df.schema)
    return kept.unionByName(made, allowMissingColumns=True)


def schema_patch(df: DataFrame, renames: dict[str, str], drops: list[str], adds: dict[str, str], comments: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed, dropped and added (name: type, empty), with comments as metadata. Names
    that are not there, or there already, raise."""
    if unknown := sorted((set(renames) | set(drops)) - set(df.columns)):
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    out = df.withColumnsRenamed(renames).drop(*[renames.get(c, c) for c in drops])
    if twice := sorted(set(adds) & set(out.columns)):
        raise ValueError(f"columns exist: {', '.join(twice)}")
    out = out.withColumns({c: F.lit(None).cast(kind) for c, kind in adds.items()}) if adds else out
    return reduce(lambda d, c: d.withMetadata(c[0], {"comment": c[1]}), (comments or {}).items(), out)
