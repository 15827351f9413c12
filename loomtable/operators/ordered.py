"""Operators that follow an order: last rows, splices, batches, budgets, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def last_rows(df: DataFrame, n: int, order: list[str], scope: str | None = None) -> DataFrame:
    """The last n rows (of each scope)."""
    if scope is None:
        return df.orderBy(*[F.desc(c) for c in order]).limit(n)
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def logical_clock(messages: DataFrame, scope: str, order: str, counts: Column, alias: str = "floor") -> DataFrame:
    """The running number of rows that count."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn(alias, F.sum(F.when(counts, 1).otherwise(0)).over(w))


def codes(df: DataFrame, scope: str, order: str, prefix: str = "AM") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(scope).orderBy(order))
    plain = nth.cast("string")
    return df.withColumn("code", F.concat(F.lit(prefix), F.when(F.length(plain) < 4, F.lpad(plain, 4, "0")).otherwise(plain)))


def batches(df: DataFrame, n: int, order: str, scope: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(scope).orderBy(order))
    return df.withColumn("batch", F.floor((nth - 1) / n))


def spliced(df: DataFrame, place: str, start: int, end: int, merged: DataFrame) -> DataFrame:
    """df less the rows at start..end-1, with merged at start; place is made anew by the
    caller's order (segment, place)."""
    before = df.filter(F.col(place) < start).withColumn("segment", F.lit(0))
    after = df.filter(F.col(place) >= end).withColumn("segment", F.lit(2))
    return before.unionByName(merged.withColumn("segment", F.lit(1))).unionByName(after)


def within_budget(df: DataFrame, scope: str, order: list[str], cost: str, budget: int, most: int) -> DataFrame:
    """Greedy choice in order: a row that overflows what is left is passed over, the choice
    ends at `most` rows.

    Of rows of one cost, those chosen are the first ones: what did not fit once never fits
    later. So of each scope and cost only the first budget / cost rows (`most` at most) can be
    chosen; the rest goes before the shuffle, and a scope's task holds no more than its costs
    allow, however many rows the scope has."""
    fields = df.schema
    keep = df.filter(F.col(cost) <= budget)  # no other can ever fit
    nth = F.row_number().over(Window.partitionBy(scope, cost).orderBy(*order))
    keep = keep.withColumn("_nth", nth).filter((F.col("_nth") <= most) & (F.col("_nth") * F.col(cost) <= budget)).drop("_nth")
    placed = keep.repartition(scope).sortWithinPartitions(scope, *order)
    at_scope, at_cost = df.columns.index(scope), df.columns.index(cost)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, taken = object(), 0, 0
        for part in parts:
            chosen = []
            for key, c in zip(part.iloc[:, at_scope], part.iloc[:, at_cost], strict=True):
                if key != now:
                    now, used, taken = key, 0, 0
                fits = taken < most and used + c <= budget
                used, taken = used + c * fits, taken + fits
                chosen.append(fits)
            yield part[pd.Series(chosen, index=part.index, dtype=bool)]

    return placed.mapInPandas(run, T.StructType(fields.fields))


def elementary(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """lo, hi, n: the pieces between neighbouring bounds of all ranges (half open), with the
    number of ranges over each. Bounds are summed by value first, then dealt out in order: a
    part's own sums start at the total of the parts before it, and its last bound ends at the
    first one of the next."""
    bounds = ranges.select(F.col(start).alias("at"), F.lit(1).alias("d")).unionAll(ranges.select(F.col(end).alias("at"), F.lit(-1).alias("d"))).groupBy("at").agg(F.sum("d").alias("d"))
    placed = written(bounds.orderBy("at").withColumn("_part", F.spark_partition_id()), "bounds")  # read twice below
    by_part = Window.orderBy("_part")  # a row for each part
    parts = placed.groupBy("_part").agg(F.sum("d").alias("_d"), F.min("at").alias("_first"))
    parts = parts.select("_part", F.coalesce(F.sum("_d").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(by_part).alias("_next"))
    w = Window.partitionBy("_part").orderBy("at")
    pieces = placed.join(F.broadcast(parts), "_part").select(F.col("at").alias("lo"), F.coalesce(F.lead("at").over(w), "_next").alias("hi"), (F.col("_before") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("n"))
    return pieces.filter("hi IS NOT NULL AND n > 0")


def rows_before(df: DataFrame, place: str, at: int, n: int) -> DataFrame:
    """The n rows before place `at`."""
    return df.filter((F.col(place) >= max(0, at - n)) & (F.col(place) < at))


#: The parts of a prompt that entries go to, in order; all other positions come last.
SEGMENTS = ("before_character_definition", "after_character_definition")


def entry_order(position: Column, depth: Column, order: Column, place: Column, book: Column, uid: Column) -> list[Column]:
    """Sort keys of entries: segment, deepest first in the last one, order, place, book, uid;
    those without a number come after those with one."""
    segment = F.coalesce(F.array_position(F.array(*map(F.lit, SEGMENTS)), position), F.lit(0))
    last = segment == 0
    number = lambda c: c.cast("string").try_cast("double")
    return [F.when(last, 3).otherwise(segment), F.when(last, -F.coalesce(number(depth), F.lit(0.0))).otherwise(0), number(order).asc_nulls_last(), number(place).asc_nulls_last(), F.coalesce(book, F.lit("")), F.coalesce(uid.cast("string"), F.lit(""))]


def table_order(tables: DataFrame, number: str, name: str) -> DataFrame:
    """Tables by their number, those without one last, then by name."""
    return tables.orderBy(F.col(number).cast("string").try_cast("double").asc_nulls_last(), name)


def after_merge(df: DataFrame, order: list[str], merged: Column, made: DataFrame, n: int) -> DataFrame:
    """df once its first n unmerged rows have become the rows `made`: earlier merged rows
    (segment 0), made (1), the other unmerged rows (2). All unmerged rows stay if there are
    fewer than n."""
    from .writes import placed

    fresh = placed(df.filter(~merged), order, "_place")
    total = fresh.agg(F.count(F.lit(1)).alias("_total"))  # one row
    rest = fresh.crossJoin(F.broadcast(total)).filter((F.col("_place") >= n) | (F.col("_total") < n)).drop("_place", "_total")
    return df.filter(merged).withColumn("segment", F.lit(0)).unionByName(made.withColumn("segment", F.lit(1))).unionByName(rest.withColumn("segment", F.lit(2)))


def overlapping(a: DataFrame, b: DataFrame, a_lo: str, a_hi: str, b_lo: str, b_hi: str, width: int) -> DataFrame:
    """Pairs of overlapping half-open ranges by bins of `width`: an equi-join on the bin, each
    pair in the first bin both have."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    x, y = a.withColumn("_bin", bins(a_lo, a_hi)), b.withColumn("_bin", bins(b_lo, b_hi))
    first = F.floor(F.greatest(F.col(a_lo), F.col(b_lo)) / width)
    return x.join(y, "_bin").filter((F.col(a_lo) < F.col(b_hi)) & (F.col(b_lo) < F.col(a_hi)) & (F.col("_bin") == first)).drop("_bin")


def due(messages: DataFrame, scope: str, floor: str, recorded: Column, frequency: int, skip: int, window: int) -> DataFrame:
    """scope, n_due, first, last: of scopes with at least `frequency` unrecorded floors, less the
    newest `skip`, those of the last `window`; older ones are dropped."""
    top = messages.groupBy(scope).agg(F.max(floor).alias("_top"))
    fresh = messages.join(top, scope).filter((F.col(floor) <= F.col("_top") - skip) & ~recorded)
    at = F.when(F.col(floor) > F.col("_top") - skip - window, F.col(floor))
    found = fresh.groupBy(scope).agg(F.count(F.lit(1)).alias("_fresh"), F.count(at).alias("n_due"), F.min(at).alias("first"), F.max(at).alias("last"))
    return found.filter((F.col("_fresh") >= frequency) & (F.col("n_due") > 0)).drop("_fresh")


def to_merge(rows: DataFrame, scope: str, order: str, threshold: int, reserve: int) -> DataFrame:
    """The oldest rows of scopes with threshold + reserve rows or more, less the reserve."""
    counted = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= threshold + reserve)
    nth = F.row_number().over(Window.partitionBy(scope).orderBy(order))
    return rows.join(counted, scope).withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_n") - reserve).drop("_n", "_nth")
