"""Keyword expansion: entries that fire on a text, then on what fired entries say.

Entries: entry_id, keywords (array), content, constant, passes_on, can_follow. A keyword fires
where it is contained, in lower case: phrases and parts of words do. Which contents hold which
keywords is found once, for all entries, by containment.contained; the rounds then only join ids
and keywords, each a written table, `rounds` at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .containment import contained


def expand(entries: DataFrame, scan: str, rounds: int = 10, constants_are_read: bool = False) -> DataFrame:
    """entry_id, round of every entry that fires: constants in round 0, then, round by round,
    entries with a keyword in the scanned text or in the contents (that pass on) of entries
    fired in rounds before. An entry that can't follow fires on the scanned text alone, to which
    constants_are_read adds the constants' contents."""
    spark = entries.sparkSession
    heads = written(entries.select("entry_id", "constant", "passes_on", "can_follow"), "entry-heads")
    keys = written(entries.filter("NOT constant").select("entry_id", "can_follow", F.explode(F.transform("keywords", F.lower)).alias("keyword")).filter(F.trim("keyword") != "").distinct(), "entry-keys")
    said = written(contained(entries.filter("passes_on"), "entry_id", "content", keys), "entry-says")
    heard = written(contained(spark.createDataFrame([(0, scan)], "_at int, _text string"), "_at", "_text", keys).select("keyword"), "entry-heard")
    fired = written(heads.filter("constant").select("entry_id", F.lit(0).alias("round")), "fired")
    passed = said.join(fired, "entry_id", "left_semi").select("keyword")
    base = heard.union(passed) if constants_are_read else heard
    last = fired
    for nth in range(1, rounds + 1):
        words = said.join(last, "entry_id", "left_semi").select("keyword")
        followers = keys.filter("can_follow").join((words.union(heard) if nth == 1 else words).distinct(), "keyword", "left_semi")
        if nth == 1:
            followers = followers.unionByName(keys.filter("NOT can_follow").join(base.distinct(), "keyword", "left_semi"), allowMissingColumns=True)
        new = followers.select("entry_id").distinct().join(fired, "entry_id", "left_anti")
        last = written(new.select("entry_id", F.lit(nth).alias("round")), "fired")
        if last.isEmpty():
            break
        fired = fired.unionAll(last)
    return fired
