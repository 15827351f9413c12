"""Window frames that Spark's SQL lacks: GROUPS, and EXCLUDE of the row, its peers or its ties."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXCLUDES = ("no others", "current row", "group", "ties")


def groups_frames(df: DataFrame, partition: list[str], order: list[str], value: str, framed: dict[str, tuple[int | None, int | None, str]]) -> DataFrame:
    """df with sum, count and avg (under each prefix of framed) of value over the peer groups from
    `before` groups ahead of the row's to `after` behind it (None: all of them), less what is
    excluded: the row, its peers, or its peers but not itself. Peers, rows that order alike
    (`order` names columns, ascending, with a - before descending), are added up first; the frames are ROWS over the groups,
    all by one sort, and the rows meet their group again in a join. What is excluded is taken away
    from the sums. Values are added as decimals or whole numbers where they are such, so
    taking away is exact; an empty frame has a null sum and avg and the count 0."""
    if bad := [e for *_, e in framed.values() if e not in EXCLUDES]:
        raise ValueError(f"{bad[0]!r} is not one of {', '.join(EXCLUDES)}")
    sorts = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    keys = list(dict.fromkeys([*partition, *(c.removeprefix("-") for c in order)]))
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = df.groupBy(*keys).agg(zero(F.sum(value)).alias("_own"), F.count(value).alias("_mine"))
    sums = {}
    for prefix, (before, after, _) in framed.items():
        low, high = Window.unboundedPreceding if before is None else -before, Window.unboundedFollowing if after is None else after
        frame = Window.partitionBy(*partition).orderBy(*sorts).rowsBetween(low, high)
        sums |= {f"_{prefix}t": zero(F.sum("_own").over(frame)), f"_{prefix}n": zero(F.sum("_mine").over(frame))}
    groups = groups.withColumns(sums).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    met = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = df.join(groups, reduce(and_, met)) if keys else df.crossJoin(groups)
    own, mine = zero(F.col(value)), F.when(F.col(value).isNotNull(), 1).otherwise(0)
    new = {}
    for prefix, (before, after, exclude) in framed.items():
        total, n = F.col(f"_{prefix}t"), F.col(f"_{prefix}n")
        held = (before is None or before >= 0) and (after is None or after >= 0)  # is the row's group in the frame?
        if held and exclude == "current row":
            total, n = total - own, n - mine
        elif held and exclude != "no others":
            total, n = total - F.col("_own"), n - F.col("_mine")
            if exclude == "ties":
                total, n = total + own, n + mine
        new |= {f"{prefix}count": n, f"{prefix}sum": F.when(n > 0, total), f"{prefix}avg": F.when(n > 0, total / n)}
    return rows.select(*df.columns, *[c.alias(name) for name, c in new.items()])


def groups_frame(df: DataFrame, partition: list[str], order: list[str], value: str, before: int | None, after: int | None, exclude: str = "no others", prefix: str = "") -> DataFrame:
    """One frame of `groups_frames`."""
    return groups_frames(df, partition, order, value, {prefix: (before, after, exclude)})
