"""The bitmap before joins."""

import numpy as np
from pyspark.sql import functions as F

from loomtable.operators import retrieval
from loomtable.operators.containment import contained
from loomtable.operators.sieve import BITS, bitmap


def test_bitmap_keeps_every_place(spark):
    places = [0, 1, 7, 8, 63, 64, 65, 12345, BITS - 1]
    bits = bitmap(spark.createDataFrame([(x,) for x in places * 2], "x long").repartition(3), F.col("x"))
    assert [i for i in np.flatnonzero(np.unpackbits(bits, bitorder="little"))] == places


def test_many_short_keywords_scan_the_texts_once(spark):
    df = spark.createDataFrame([(1, "abcde fghij"), (2, "klm")], "id long, text string")
    keys = spark.createDataFrame([(c,) for c in ["ab", "cde", "lm", "k", "zz", "e fghij"]], "keyword string")
    made = contained(df, "id", "text", keys, signs=2)
    assert "Union" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [(1, "ab"), (1, "cde"), (1, "e fghij"), (2, "k"), (2, "lm")]


def test_fuzzy_pairs_drop_other_word_pairs_before_the_join(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "nothing of that sort is here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "two three four five")], "item_id long, text string")
    met = []
    real = retrieval.written
    retrieval.written = lambda df, kind: met.append(df) or real(df, kind)
    try:
        assert [tuple(r) for r in retrieval.fuzzy_pairs(docs, items).collect()] == [(1, 9, 1.0)]
    finally:
        retrieval.written = real
    assert "MapInArrow" in met[0]._jdf.queryExecution().executedPlan().toString()
