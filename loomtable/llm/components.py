"""Connected components of a graph of links, in a few distributed rounds.

Each round is a large star (every node's larger neighbours are tied to its least one) and a
small star (its smaller neighbours are), as grouped minima and joins: a node with very many
links is a partial minimum before the shuffle and a join that Spark splits. Rounds repeat
until the links no longer change; each is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(links: DataFrame, kind: str) -> DataFrame:
    """links: u, v. Of both kinds the least of a node and its neighbours takes its place."""
    if kind == "large":
        near = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # each link from its larger end
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = near.join(least, "u")
    if kind == "large":
        return tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """links: a, b (long). id, component (its least id) of every id that has a link."""
    now = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "links")
    facts = None
    for _ in range(most_rounds):
        now = staged(_star(_star(now, "large"), "small"), "links")
        last, facts = facts, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if facts == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
