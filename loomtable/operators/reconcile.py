"""Two stored states of the same tables (sources.trees): how they differ, what may be merged,
and what to do, decided from the states, their logs and the note that one was made of the other.

The older state is `a`; `b` comes from a checkpoint and a log. Keys are lists of columns, of
which the first may name the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written
from ..sources import trees
from . import logs


def row_kinds(spark: SparkSession, a: str, b: str, schema: StructType, key: list[str], leaves: DataFrame | None = None) -> DataFrame:
    """key, kind of every key whose rows differ: only_a, only_b, or other (other cells, or more
    rows of the key on one side). Rows of equal leaves are not read."""
    leaves = leaves if leaves is not None else written(trees.differing(spark, a, b), "leaves")
    cells = F.xxhash64(*trees._cells(schema.names))
    of = lambda folder, name: trees.read(spark, folder, schema, leaves).select(*key, cells.alias("_h"), F.lit(name).alias("_in"))
    side = lambda name: F.count_if(F.col("_in") == name)
    total = lambda name: F.sum(F.when(F.col("_in") == name, F.col("_h").cast("decimal(38,0)")))
    every = of(a, "a").unionAll(of(b, "b")).groupBy(*key).agg(side("a").alias("_a"), side("b").alias("_b"), total("a").eqNullSafe(total("b")).alias("_same"))
    kind = F.when(F.col("_b") == 0, "only_a").when(F.col("_a") == 0, "only_b").when(~F.col("_same") | (F.col("_a") != F.col("_b")), "other")
    return every.select(*key, kind.alias("kind")).filter("kind IS NOT NULL")


def merged(spark: SparkSession, a: str, b: str, schema: StructType, key: list[str]) -> DataFrame:
    """b with the rows that only a has. A key with other cells on the two sides, or an id that
    is blank or repeated, is an error: nothing is guessed."""
    leaves = written(trees.differing(spark, a, b), "leaves")
    kinds = written(row_kinds(spark, a, b, schema, key, leaves), "kinds")
    unstable = sum(trees.facts(spark, f).first()["n_unstable"] for f in (a, b))
    others = kinds.filter("kind = 'other'").count()
    if unstable or others:
        raise ValueError(f"{others} keys with other cells, {unstable} rows without an id of their own")
    missing = kinds.filter("kind = 'only_a'").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return trees.read(spark, b, schema).unionByName(trees.read(spark, a, schema, leaves).join(missing, on, "left_semi"))


def decided(spark: SparkSession, a: str, b: str, schema: StructType, key: list[str], log: DataFrame, changed: DataFrame, noted: str | None, anchor: int) -> DataFrame:
    """One row: kind (logs.storage_decision), what it rests on, and counts.

    log: (sheet, seq, revision, parent, floor) of b, its chain unbroken or b can't be replayed;
    changed: (sheet, floor), the last change of each sheet in a, which b's log must reach;
    noted: the mark of a that b's checkpoint claims to come from; anchor: its place in the log.
    Rows of b without an id of their own call for a new checkpoint, those of a for a
    confirmation. Equal states are not read beyond their roots."""
    marks = trees.root(spark, a), trees.root(spark, b)
    fact = [trees.facts(spark, f).first() for f in (a, b)]
    leaves = written(trees.differing(spark, a, b), "leaves")
    counts = row_kinds(spark, a, b, schema, key, leaves).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("only_a", "only_b", "other")])
    reached = log.groupBy("sheet").agg(F.max("floor").alias("_reached"))
    behind = changed.join(reached, "sheet", "left").filter(F.col("_reached").isNull() | (F.col("_reached") < F.col("floor")))
    lit = F.lit
    facts = counts.withColumns({
        "n_leaves": lit(leaves.count()), "replayed": lit(logs.chain_faults(log, "sheet").isEmpty()), "covered": lit(behind.isEmpty()),
        "successor": lit(not log.filter(F.col("seq") > anchor).isEmpty()), "claimed": lit(noted == marks[0]), "equal": lit(marks[0] == marks[1]),
    })
    stable = lit(not fact[0]["n_unstable"]), lit(not fact[1]["n_unstable"])
    mergeable = (F.col("n_other") == 0) & stable[0] & stable[1]
    kind = logs.storage_decision(F.col("replayed"), ~stable[1], ~stable[0], lit(True), F.col("claimed"), F.col("covered"), F.col("equal"), F.col("successor"), mergeable)
    return facts.select(kind.alias("kind"), *facts.columns)
