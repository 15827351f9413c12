"""Term counts against the token Columns and plain Python."""

from collections import Counter

from pyspark.sql import functions as F

from loomtable.functions import text as T
from loomtable.operators import retrieval

TEXTS = [(1, "The the_x 9 é the"), (2, "世界 中!a中国b 你好世"), (3, None), (4, ""), (5, "ÀB cD İx KELVINK"), (None, "a b a"), (6, "b " * 9 + "a")]


def test_words_in_tasks_are_the_tokens(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for r in df.select(F.lower(F.coalesce("text", F.lit(""))).alias("l"), T.tokens(F.col("text")).alias("t")).collect():
        assert T.words_of(r.l) == r.t


def test_terms_are_counted_within_the_row_unless_ids_repeat(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    made = retrieval.term_counts(df, "doc_id", "text")
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    terms = {r.doc_id: r.t for r in df.select("doc_id", T.tokens(F.col("text")).alias("t")).collect()}
    want = sorted(((i, len(t), w, n) for i, t in terms.items() for w, n in Counter(t).items()), key=str)
    assert sorted(map(tuple, made.collect()), key=str) == want
    again = retrieval.term_counts(df.unionByName(spark.createDataFrame([(6, "a c"), (None, "b")], df.schema)), "doc_id", "text").filter("doc_id IS NULL OR doc_id = 6")
    assert sorted(map(tuple, again.collect()), key=str) == sorted([(6, 12, "a", 2), (6, 12, "b", 9), (6, 12, "c", 1), (None, 4, "a", 2), (None, 4, "b", 2)], key=str)
