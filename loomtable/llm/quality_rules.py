r"""Quality rules: counting rules, then a hashed n-gram log-likelihood ratio.

Words are `[^\x20\x09-\x0D]+`. The counting rules reject documents of under 50 words and
those more than half of whose words stand in three-word windows found twice or more.

The verdict on the others compares two multinomials over hashed word n-grams (one and two
words): that of trusted documents and that of the raw corpus. The raw one counts every
n-gram of every document. The trusted one is fitted on documents labelled good (of repeated
labels of an id the worst counts), at most `fit` of them, by hash of doc_id. A document's
score is the mean of log p_trusted - log p_raw over its n-grams. One in `held_out` of all
labelled ids, by hash, is kept out of the fit, and all of these set the threshold: the one at
which the share of good rows kept, ten times over, less the share of bad rows kept is
largest, the middle of such a range. Every document is held against that threshold; nothing
is drawn at random, so runs agree.

Only DataFrame functions are used. What is broadcast is the ids of the fit (at most `fit`)
and the weights (`buckets` doubles), both bounded by parameters. Fitting on all good labels
would take a join of the whole texts by doc_id, 1.2 times the input in shuffles. The held-out
labels, which grow with the corpus, are joined with the scores by a sort-merge join.

Results of the odd cases: a null or empty text has no words and fails the rules; without
trusted labels all weights are 0 and every document that passes the rules is kept; without
held-out rows of both kinds the threshold is the least score of a held-out good row less
0.05, or none. Repeated rows get equal results. Columns of the input pass through, those
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

BUCKETS, FIT, HELD_OUT = 1 << 16, 20_000, 5
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\u000b\f\r"
BIN = 0.01  # of scores, for the threshold
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def split_words(text: Column) -> Column:
    """The words of a text: white space made spaces, cut at single spaces, empty parts taken
    out. (A split at one character and array_remove run as compiled code, a split by a
    pattern and a lambda don't.)"""
    spaced = F.coalesce(text, F.lit(""))
    for c in WHITE[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _w, the words, and the counts of the rules.

    Every array is a column of its own before others use it: inside a lambda it would be
    made anew for each element."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(*RESULTS).withColumn("_w", split_words(F.col(text)))
    lines = F.filter(F.split(t, "\n"), lambda line: F.length(F.trim(line, F.lit(WHITE))) > 0)
    n = F.size("_w") - 2
    three = F.arrays_zip(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), F.slice("_w", F.lit(3), n))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
        "_lines": lines,
        "_triples": F.when(F.size("_w") > 2, F.transform(three, lambda x: F.xxhash64(x))),
    })
    out = out.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_repeats": F.coalesce(F.size(F.array_distinct("_triples")) < F.size("_triples"), F.lit(False)),
    })
    # Windows with equal hashes may be equal; only then are the words themselves compared.
    window = F.zip_with(F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)), F.slice("_w", F.lit(3), n), lambda a, b: F.concat(a, F.lit(" "), b))
    placed = F.zip_with(window, F.sequence(F.lit(1), n), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    out = out.withColumn("_windows", F.when(F.col("_repeats"), F.array_sort(placed)))
    m = F.size("_windows") - 1
    both = F.zip_with(F.slice("_windows", F.lit(1), m), F.slice("_windows", F.lit(2), m), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_twice", F.when(F.col("_repeats"), F.array_distinct(F.flatten(both))))
    covered = F.array_distinct(F.flatten(F.transform("_twice", lambda i: F.array(i, i + 1, i + 2))))
    out = out.withColumn("n_repeat_words", F.when(F.col("_repeats"), F.size(covered)).otherwise(0).cast("long"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def each_gram(docs: DataFrame, kept: list[str], buckets: int) -> DataFrame:
    """kept and g, the bucket of each word and each word pair of _w; a row with null g for
    a document without words."""
    pairs = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))).alias("b"))
    rows = docs.select(*kept, F.inline_outer(pairs).alias("a", "b"))
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    one, two = F.when(F.col("a").isNotNull(), bucket("a")), F.when(F.col("b").isNotNull(), bucket("a", "b"))
    return rows.select(*kept, F.explode(F.array(one, two)).alias("g"))


def labelled(labels: DataFrame, held_out: int = HELD_OUT) -> DataFrame:
    """A row for each labelled id: _id, good, bad, held."""
    one = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"), F.min("quality").alias("quality"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(held_out)) == 0
    return one.filter("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), "good", (F.col("quality") == 0).alias("bad"), held.alias("held"))


def weights(docs: DataFrame, known: DataFrame, buckets: int = BUCKETS, fit: int = FIT) -> DataFrame:
    """One row: w, the log-likelihood ratio of every bucket, add-one smoothed."""
    trusted = known.filter("good = 1 AND NOT held").orderBy(F.xxhash64("_id"), "_id").limit(fit).select("_id", F.lit(1).alias("t"))
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left").select(F.coalesce("t", F.lit(0)).cast("long").alias("t"), split_words(F.col("text")).alias("_w"))
    counts = each_gram(flagged, ["t"], buckets).filter("g IS NOT NULL").groupBy(F.col("g").alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("trusted"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    one = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("b"), F.sum("raw").alias("n_raw"), F.sum("trusted").alias("n_trusted"))
    ratio = lambda x: F.when(F.col("n_trusted") > 0, F.log((x["trusted"] + 1) / (F.col("n_trusted") + buckets)) - F.log((x["raw"] + 1) / (F.col("n_raw") + buckets))).otherwise(0.0)
    return one.select(F.transform("b", ratio).alias("w"))


def threshold(scored: DataFrame, known: DataFrame) -> float:
    """Where held-out good and bad rows part best; -inf without good ones."""
    held = scored.filter(~F.col("base_failed")).select(F.col("doc_id"), "score").join(known.filter("held").hint("merge"), F.col("doc_id") == F.col("_id"))
    bins = held.groupBy(F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "score")) / BIN).cast("int").alias("bin")).agg(F.sum("good").alias("good"), F.sum(F.col("bad").cast("long")).alias("bad"), F.min(F.when(F.col("good") == 1, F.col("score"))).alias("least")).orderBy("bin").collect()  # at most 2,001 rows
    n_good, n_bad = sum(b["good"] for b in bins), sum(b["bad"] for b in bins)
    if not n_good:
        return float("-inf")
    if not n_bad:
        return min(b["least"] for b in bins if b["least"] is not None) - 0.05
    best: list[float] = []
    most, good, bad = -2.0, n_good, n_bad
    for at in range(bins[0]["bin"], bins[-1]["bin"] + 2):  # keep what is at or above bin `at`
        value = round(10 * good / n_good - bad / n_bad, 9)
        if value > most:
            best, most = [], value
        if value == most:
            best.append((at - 0.5) * BIN)
        here = [b for b in bins if b["bin"] == at]
        good, bad = good - sum(b["good"] for b in here), bad - sum(b["bad"] for b in here)
    return (best[0] + best[-1]) / 2


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, fit: int = FIT, held_out: int = HELD_OUT) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, _key of the text, the counts,
    base_failed, score, kept. The rows are a written table, without the texts."""
    known = staged(labelled(labels, held_out), "quality-labels")
    ratios = staged(weights(docs, known, buckets, fit), "quality-weights")
    facts = counted(docs.select("doc_id", "text")).withColumns({"_key": F.xxhash64(F.coalesce("text", F.lit(""))), "_row": F.monotonically_increasing_id()})
    of_row = [F.first(c).alias(c) for c in ("doc_id", "_key", *RESULTS)]
    sums = each_gram(facts, ["_row", "doc_id", "_key", *RESULTS], buckets).withColumn("v", F.get(ratios.scalar(), "g")).groupBy("_row").agg(*of_row, F.sum("v").alias("total"), F.count("v").alias("n"))
    scored = staged(sums.select("doc_id", "_key", *RESULTS, F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("score")), "quality-scores")
    least = threshold(scored, known)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
