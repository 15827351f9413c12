"""Change capture over keyed tables: deltas, replay, time travel, audits, compaction.

A delta row has the key, op ('upsert' or 'delete') and the cells. A log row also has the
place of its message and its number in it. Replaying a log of keyed rows is "the last writer
of each key wins", a partial aggregate before the shuffle, so no key's history is gathered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What makes `after` of `before` (same columns): upserts with their cells, deletes. A null
    key is a key like others; where keys repeat, delta_fault says so and a snapshot is needed."""
    cells = [c for c in after.columns if c != key]
    a = after.select(F.col(key).alias("_k"), F.struct(*cells).alias("_new"), F.lit(True).alias("_is_new"))
    b = before.select(F.col(key).alias("_o"), F.struct(*cells).alias("_old"), F.lit(True).alias("_was"))
    both = a.join(b, F.col("_k").eqNullSafe(F.col("_o")), "full_outer").filter(F.col("_is_new").isNull() | F.col("_was").isNull() | ~F.col("_new").eqNullSafe(F.col("_old")))
    op = F.when(F.col("_is_new").isNull(), "delete").otherwise("upsert")
    return both.select(F.coalesce("_k", "_o").alias(key), op.alias("op"), *[F.col(f"_new.{c}").alias(c) for c in cells])


def delta_fault(before: DataFrame | None, after: DataFrame, key: str) -> str | None:
    """Why a change can't be told row by row and a whole snapshot must be kept: no_base,
    columns_changed, or unstable_ids (blank or repeated on either side); None if it can."""
    if before is None:
        return "no_base"
    if [(f.name, f.dataType) for f in before.schema] != [(f.name, f.dataType) for f in after.schema]:
        return "columns_changed"
    stable = stable_ids(before, key).union(stable_ids(after, key)).agg(F.min("stable")).first()[0]
    return None if stable else "unstable_ids"


def apply_delta(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base less the changed keys, with the upserts. A delete of an unknown key says nothing."""
    upserts = changes.filter("op = 'upsert'").select(*base.columns)
    gone = changes.select(F.col(key).alias("_gone"))
    return base.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti").select(*base.columns).unionByName(upserts)


def stable_ids(df: DataFrame, key: str) -> DataFrame:
    """One row: stable is whether ids are neither blank nor repeated."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    each = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(blank).alias("blank"))
    return each.agg(F.coalesce(~F.max((F.col("n") > 1) | F.col("blank")), F.lit(True)).alias("stable"))


def last_writes(log: DataFrame, key: str, order: list[str], cells: list[str], deleted: Column, until: Column | None = None) -> DataFrame:
    """The state after the log, or as of `until`: the last row of each key, deletes gone."""
    log = log.filter(until) if until is not None else log
    last = log.groupBy(key).agg(F.max_by(F.struct(*cells, deleted.alias("_deleted")), F.struct(*order)).alias("_last"))
    return last.filter("NOT _last._deleted").select(key, *[F.col(f"_last.{c}").alias(c) for c in cells])


def replay(checkpoint: DataFrame, log: DataFrame, key: str, order: list[str], deleted: Column) -> DataFrame:
    """A checkpoint (full state) with a later log on it."""
    cells = [c for c in checkpoint.columns if c != key]
    first = checkpoint.select(key, *cells, F.lit(0).alias("_late"), F.lit(False).alias("_gone"), *[F.lit(None).cast(log.schema[o].dataType).alias(f"_o_{o}") for o in order])
    later = log.select(key, *cells, F.lit(1).alias("_late"), deleted.alias("_gone"), *[F.col(o).alias(f"_o_{o}") for o in order])
    return last_writes(first.unionByName(later), key, ["_late", *[f"_o_{o}" for o in order]], cells, F.col("_gone"))


def after_reset(log: DataFrame, table_key: str, order: str, reset: Column) -> DataFrame:
    """Log rows from each table's last whole-table replacement on."""
    cut = log.filter(reset).groupBy(table_key).agg(F.max(order).alias("_cut"))
    return log.join(cut, table_key, "left").filter(F.col("_cut").isNull() | (F.col(order) >= F.col("_cut"))).drop("_cut")


def sequence_faults(log: DataFrame, scope: str, order: str, seq: str) -> DataFrame:
    """Rows whose number is not larger than that of the row before it."""
    before = F.lag(seq).over(Window.partitionBy(scope).orderBy(order))
    return log.withColumn("_before", before).filter(F.col(seq).isNull() | (F.col(seq) <= F.col("_before"))).drop("_before")


def audit(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """issue, n: blank and repeated keys, blank required cells. One pass and one by key."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    facts = df.agg(F.count_if(blank(key)).alias(f"blank {key}"), *[F.count_if(blank(c)).alias(f"blank {c}") for c in required if c != key])
    kinds = F.array(*[F.struct(F.lit(c).alias("issue"), F.col(c).alias("n")) for c in facts.columns])
    again = df.groupBy(key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"repeated {key}").alias("issue"), "n")
    return facts.select(F.inline(kinds)).unionAll(again)


def runs(log: DataFrame, scope: str, order: str, kind: str) -> DataFrame:
    """Neighbours of one kind as one batch: scope, batch, kind, first, last, n_ops."""
    w = Window.partitionBy(scope).orderBy(order)
    begins = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))
    numbered = log.withColumn("batch", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(scope, "batch", kind).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_ops"))


def kept_layers(log: DataFrame, layer: str, keep: int, buffer: int = 20) -> DataFrame:
    """Log rows of the last keep + buffer layers; a snapshot stands for the older ones."""
    last = log.agg(F.max(layer).alias("_last"))
    return log.crossJoin(F.broadcast(last)).filter(F.col(layer) > F.col("_last") - (keep + buffer)).drop("_last")  # one row


def merged_layers(layers: DataFrame, key: str, order: str, removed: Column) -> DataFrame:
    """Base and deltas of an index: each key's last row, removed keys gone."""
    cells = [c for c in layers.columns if c not in (key, order)]
    last = layers.groupBy(key).agg(F.max_by(F.struct(*cells, removed.alias("_removed")), order).alias("_last"))
    return last.filter("NOT _last._removed").select(key, *[F.col(f"_last.{c}").alias(c) for c in cells])


def to_recompute(now: DataFrame, known: DataFrame, key: str, mark: str) -> DataFrame:
    """key, status: 'reuse' (same fingerprint), 'embed' (new or other), 'drop' (gone)."""
    a, b = now.select(F.col(key).alias("_a"), F.col(mark).alias("_ma")), known.select(F.col(key).alias("_b"), F.col(mark).alias("_mb"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    status = F.when(F.col("_a").isNull(), "drop").when(F.col("_ma").eqNullSafe(F.col("_mb")), "reuse").otherwise("embed")
    return both.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def unreached(files: DataFrame, references: DataFrame, path: str, age_minutes: Column, grace: int = 10) -> DataFrame:
    """Files that no manifest names, older than the grace period."""
    return files.filter(age_minutes > grace).join(references.select(path).distinct(), path, "left_anti")


def remapped_ids(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rows kept, repeats of an id (after the first) get new ids after the greatest."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = df.withColumn("_nth", nth)
    again = ranked.filter("_nth > 1").drop("_nth")
    from ..functions.numbers import with_row_ids

    return ranked.filter("_nth = 1").drop("_nth").unionByName(with_row_ids(df, again, [key, *order], key))


def conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: the ids of units of two write sets that touch each other. A unit is (id, kind, sheet,
    row, column): kind all touches everything, sheet and schema all of their sheet, row the row
    and its cells, cell the same cell and its row. Each unit stands at its own place (all, or a
    sheet, row or cell of it) and looks at that place and those above it; two units touch where
    one stands at a place that the other looks at, so equal joins find every pair, and pairs are
    listed once. A unit of another kind touches its sheet, one without a sheet only `all`."""
    level = F.when(F.col("kind") == "all", 0).when(F.col("kind") == "row", 2).when(F.col("kind") == "cell", 3).otherwise(1)
    places = F.array(F.array(F.lit("all")), F.array(F.lit("sheet"), F.col("sheet")), F.array(F.lit("row"), F.col("sheet"), F.col("row")), F.array(F.lit("cell"), F.col("sheet"), F.col("row"), F.col("column")))

    def units(df: DataFrame, name: str) -> DataFrame:
        known = df.withColumns({"_level": level, "_places": F.transform(places, lambda p: F.to_json(F.transform(p, lambda x: F.coalesce(x, F.lit("\0")))))})
        homeless = F.col("sheet").isNull() & (F.col("_level") > 0)
        own = F.when(~homeless, F.col("_places")[F.col("_level")])
        return known.select(F.col("id").alias(name), "_level", own.alias("_own"), F.slice("_places", F.lit(1), F.when(homeless, 1).otherwise(F.col("_level") + 1)).alias("_above"))

    x, y = units(a, "a"), units(b, "b")
    up = lambda df, name: df.select(name, "_level", F.explode("_above").alias("_own"))
    below = up(x, "a").withColumnRenamed("_level", "_from").join(y, "_own").select("a", "b")
    above = up(y, "b").withColumnRenamed("_level", "_from").join(x, "_own").filter("_from > _level").select("a", "b")
    return below.unionAll(above)


def locked(edits: DataFrame, locks: DataFrame, key: str) -> DataFrame:
    """Edits (key, column, value) less those on a locked cell, row (null column) or column
    (null key)."""
    cells = locks.filter(F.col(key).isNotNull() & F.col("column").isNotNull()).select(key, "column")
    rows = locks.filter(F.col("column").isNull()).select(key)
    columns = locks.filter(F.col(key).isNull()).select("column")
    steps = [(cells, [key, "column"]), (rows, [key]), (columns, ["column"])]
    return reduce(lambda df, s: df.join(s[0], s[1], "left_anti"), steps, edits)


def edited(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """base with edits (key, column, value, seq): the last edit of a cell wins."""
    last = edits.groupBy(key, "column").agg(F.max_by("value", "seq").alias("value"))
    of_row = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_edits"))  # a row's columns at most
    joined = base.join(of_row, key, "left")
    new = lambda c: F.when(F.coalesce(F.map_contains_key("_edits", F.lit(c)), F.lit(False)), F.col("_edits")[c].cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return joined.select(*[F.col(c) if c == key else new(c) for c in base.columns])
