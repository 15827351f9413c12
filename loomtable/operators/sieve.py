"""A bitmap of hashed keys that tasks ask before they hand a key on to a join.

It has a fixed size, whatever the number of keys: it keeps every key that is asked for and lets
some others through, more of them the fuller it is; the join that follows tells them apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 8 MB for every task's executor.
BITS = 1 << 26


def bitmap(keys: DataFrame, place: Column) -> np.ndarray:
    """The bitmap with a bit at each place (from 0, below BITS) as bytes, joined by Spark in words
    of 64 bits."""
    at = keys.select(place.cast("long").alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.astype("<i8").view(np.uint8)
