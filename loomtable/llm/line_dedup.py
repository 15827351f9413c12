r"""Line dedup by content-defined chunks of lines.

A text is split at \n. Every line has a 32-bit hash (of its MD5), and a rolling hash runs
over each line and the one before it. A chunk ends after a line at which the rolling hash is
0 modulo `every`, and on both sides of a long line (`long_words` words or more), which so is
a chunk by itself. Boundaries depend on the lines next to them alone: text put in front of a
passage, or behind it, moves none of the boundaries inside.

Chunks of two lines or more, and long lines, of `min_words` words at least are compared
over the whole corpus: first by a hash over their lines', then, where the hash occurs twice, by
the bytes of the chunk, as the grouping key of an aggregate and of a join. Of equal chunks
the first one stays (least doc_id, then least text key, then place in the text), the others
lose their lines.

A passage of few lines may hold no whole chunk. So passages of `run_words` words or more are
compared as well: from each line, and up to each line, the shortest of two lines or more. Any
longer repeat is made of such passages, and nothing goes that is not in one that occurred before.
Only lines whose pairs with their neighbours occur more than once can be in a repeat; the others
are left out after a count of pairs. Pairs and passages are told by 128 bits of hash. Where a
passage overlaps its own first occurrence (a line said over and over), that one stays whole.

Work is spread by the chunks' bytes. A chunk that occurs often is reduced to its first place
before the shuffle and written as a table, so the join that marks its copies is a plain
equi-join whose large partitions Spark splits (adaptive skew join). Only texts that lose lines are changed.

Results of the odd cases: a null text stays null, an empty one empty, both with no line
removed; a text all of whose lines go becomes empty; rows with equal doc_id and text are one
document (both keep or lose the same lines), a null doc_id comes before all others. Columns
of the input pass through; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, staged, table

LONG_WORDS, MIN_WORDS, RUN_WORDS, EVERY = 50, 15, 50, 3
#: The rolling hash: (MULTIPLIER * line before + line) mod PRIME.
MULTIPLIER, PRIME = 31, 2147483647


def _n_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, SPACE), ""))


def _long(*columns: Column | int) -> Column:
    return F.xxhash64(*[F.lit(c) if isinstance(c, int) else c for c in columns])


def line_facts(docs: DataFrame) -> DataFrame:
    """doc_id, _key, _f: of every line of a text m (32 bits of its MD5, for the rolling hash), g
    and h (128 bits of hash) and w (words). Written once, for chunks and passages alike."""
    lines = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_key"), F.split("text", "\n").alias("_lines"))
    fact = lambda x: F.struct(F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long").alias("m"), _long(x).alias("g"), _long(1, x).alias("h"), _n_words(x).alias("w"))
    return staged(lines.select("doc_id", "_key", F.transform("_lines", fact).alias("_f")), "line-facts")


def chunks(facts: DataFrame, every: int = EVERY, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, _key, at (number of the first line, from 0), n_lines, u, v (128 bits of hash over
    the lines): the chunks to compare."""
    n = F.size("_f")
    # A line and its predecessor (of the first line: none): does a chunk begin at the line?
    ends = F.zip_with(F.slice("_f", F.lit(1), n - 1), F.slice("_f", F.lit(2), n - 1), lambda a, b: F.struct(a["m"].alias("a"), b["m"].alias("b"), (a["w"] >= long_words).alias("la"), (b["w"] >= long_words).alias("lb")))
    facts = facts.withColumn("_pairs", F.when(n > 1, ends).otherwise(F.expr("CAST(array() AS array<struct<a:bigint,b:bigint,la:boolean,lb:boolean>>)")))
    facts = facts.withColumn("_rolled", F.transform("_pairs", lambda p: F.pmod(F.pmod(p["a"] * MULTIPLIER, F.lit(PRIME)) + p["b"], F.lit(PRIME)) % every == 0))
    # Line i (from 1) begins a chunk if it or its predecessor is long, or the hash ended one at its predecessor.
    begins = F.concat(F.array(F.lit(True)), F.zip_with("_pairs", F.concat(F.array(F.lit(False)), "_rolled"), lambda p, r: p["la"] | p["lb"] | F.coalesce(r, F.lit(False))))
    facts = facts.withColumn("_begins", F.slice(begins, F.lit(1), n))
    starts = F.filter(F.zip_with("_begins", F.sequence(F.lit(0), n - 1), lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    facts = facts.withColumn("_starts", starts)
    spans = F.zip_with("_starts", F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(n)), lambda a, b: F.struct(a.alias("at"), (b - a).alias("n_lines")))
    facts = facts.withColumn("_spans", F.filter(F.slice(spans, F.lit(1), F.size("_starts")), lambda s: s["n_lines"].isNotNull()))
    words = lambda s: F.aggregate(F.slice("_f", s["at"] + 1, s["n_lines"]), F.lit(0), lambda acc, f: acc + f["w"])
    sized = F.transform("_spans", lambda s: F.struct(s["at"].alias("at"), s["n_lines"].alias("n_lines"), words(s).alias("w")))
    facts = facts.withColumn("_sized", F.filter(sized, lambda s: (s["w"] >= min_words) & ((s["n_lines"] > 1) | (s["w"] >= long_words))))
    facts = facts.withColumn("_h", F.transform("_f", lambda f: F.struct(f["g"], f["h"])))
    inside = lambda s: F.slice("_h", s["at"] + 1, s["n_lines"])
    told = F.transform("_sized", lambda s: F.struct(s["at"].alias("at"), s["n_lines"].alias("n_lines"), _long(inside(s)).alias("u"), _long(1, inside(s)).alias("v")))
    # The outer form, as the plain one has its input worked out once more for a filter of empty arrays.
    return facts.select("doc_id", "_key", F.inline_outer(told)).filter("at IS NOT NULL")


def _place() -> Column:
    """Of equal chunks or passages the one of the least place stays."""
    return F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "_key", "at")


def repeats(docs: DataFrame, facts: DataFrame, **how) -> DataFrame:
    """doc_id, _key, at, n_lines of every chunk that an earlier one equals by its bytes. Bytes
    are taken from the texts for chunks alone whose hash occurs twice."""
    found = staged(chunks(facts, **how), "line-chunks")
    often = found.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    spans = found.join(often, ["u", "v"], "left_semi").distinct()
    of_doc = spans.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.collect_list(F.struct("at", "n_lines", "u")).alias("_spans"))
    texts = docs.filter("text IS NOT NULL").withColumn("_key", F.xxhash64("text"))
    held = texts.join(of_doc, texts["doc_id"].eqNullSafe(of_doc["_id"]) & (texts["_key"] == of_doc["_k"])).withColumn("_lines", F.split("text", "\n"))
    joined = F.transform("_spans", lambda s: F.struct(s["at"].alias("at"), s["n_lines"].alias("n_lines"), s["u"].alias("h"), F.array_join(F.slice("_lines", s["at"] + 1, s["n_lines"]), "\n").alias("chunk")))
    again = staged(held.select("doc_id", "_key", F.inline(joined)), "lines-again")
    first = again.groupBy("h", "chunk").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = again.join(staged(first, "lines-first"), ["h", "chunk"])
    return marked.filter(~_place().eqNullSafe(F.col("first"))).select("doc_id", "_key", "at", "n_lines")


def shared_lines(facts: DataFrame) -> DataFrame:
    """doc_id, _key, run, at, words, p, q: the lines of runs in which every pair of neighbours
    occurs elsewhere too. p and q, 128 bits of hash, tell the pair that begins at a line; the
    last line of a run has none, and a row without words stands behind it."""
    n = F.size("_f") - 1
    ends = lambda a, b: (a["g"], a["h"], b["g"], b["h"])
    two = F.zip_with(F.slice("_f", F.lit(1), n), F.slice("_f", F.lit(2), n), lambda a, b: F.struct(_long(*ends(a, b)).alias("p"), _long(1, *ends(a, b)).alias("q"), a["w"].alias("w"), b["w"].alias("w_next")))
    pairs = staged(facts.filter(F.size("_f") > 1).select("doc_id", "_key", F.posexplode_outer(two).alias("at", "two")).select("doc_id", "_key", "at", "two.*"), "line-pairs")
    often = staged(pairs.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "pairs-often")
    text = ["doc_id", "_key"]
    shared = pairs.join(often, ["p", "q"], "left_semi").distinct()
    by_text = Window.partitionBy(*text).orderBy("at")
    shared = shared.withColumns({"run": F.col("at") - F.row_number().over(by_text), "_next": F.lead("at").over(by_text)})
    own = F.struct("at", F.col("w").alias("words"), "p", "q")
    none = F.lit(None).cast("long")
    more = [F.struct((F.col("at") + k).alias("at"), words.alias("words"), none.alias("p"), none.alias("q")) for k, words in ((1, F.col("w_next")), (2, F.lit(0)))]
    return shared.select(*text, "run", F.inline(F.when(F.col("_next") == F.col("at") + 1, F.array(own)).otherwise(F.array(own, *more))))


def passages(facts: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, _key, at, n_lines, u, v: from every line and up to every line the shortest passage
    of two lines or more and run_words words or more, as far as its pairs of lines occur
    elsewhere; u and v, 128 bits of hash, tell its lines."""
    run = ["doc_id", "_key", "run"]
    in_run = Window.partitionBy(*run)
    rows = shared_lines(facts).withColumn("e", F.coalesce(F.sum("words").over(in_run.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    # The first line with run_words words or more from a line up to it, and the last line before one.
    behind = F.min("at").over(in_run.orderBy(-F.col("e")).rangeBetween(Window.unboundedPreceding, -run_words))
    ahead = F.max("at").over(in_run.orderBy("e").rangeBetween(Window.unboundedPreceding, -run_words))
    rows = rows.withColumns({"behind": F.greatest(behind, F.when(behind.isNotNull(), F.col("at") + 2)), "ahead": F.least(ahead, F.when(ahead.isNotNull(), F.col("at") - 2))})
    held = rows.groupBy(*run).agg(F.sort_array(F.collect_list(F.struct("at", "p", "q", "behind", "ahead"))).alias("_l"))
    held = held.withColumns({"_lo": F.col("_l")[0]["at"], "_hi": F.element_at("_l", -1)["at"], "_h": F.transform("_l", lambda x: F.struct(x["p"], x["q"]))})
    spans = F.concat(F.transform("_l", lambda x: F.struct(x["at"].alias("lo"), x["behind"].alias("hi"))), F.transform("_l", lambda x: F.struct(x["ahead"].alias("lo"), x["at"].alias("hi"))))
    spans = F.array_distinct(F.filter(spans, lambda x: (x["lo"] >= F.col("_lo")) & (x["hi"] <= F.col("_hi"))))
    inside = lambda x: F.slice("_h", x["lo"] - F.col("_lo") + 1, x["hi"] - x["lo"] - 1)
    told = F.transform(spans, lambda x: F.struct(x["lo"].alias("at"), (x["hi"] - x["lo"]).alias("n_lines"), _long(inside(x)).alias("u"), _long(1, inside(x)).alias("v")))
    return held.select("doc_id", "_key", F.inline(told))


def runs(facts: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, _key, at, n_lines of every passage that occurred before, less the lines that it
    shares with its first occurrence in the same text."""
    found = staged(passages(facts, run_words), "passages")
    first = staged(found.groupBy("u", "v").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).filter("first <> last").drop("last"), "passages-first")
    again = found.join(first, ["u", "v"]).filter(~_place().eqNullSafe(F.col("first")))
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first._key") == F.col("_key"))
    begin = F.when(same, F.greatest(F.col("at"), F.col("first.at") + F.col("n_lines"))).otherwise(F.col("at"))
    return again.select("doc_id", "_key", begin.alias("at"), (F.col("at") + F.col("n_lines") - begin).alias("n_lines")).distinct()


def dedup(docs: DataFrame, every: int = EVERY, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with text less the lines of repeated chunks and runs, and n_lines, n_removed_lines."""
    docs = docs.drop("n_lines", "n_removed_lines")
    known = docs.select("doc_id", "text").filter("text IS NOT NULL")
    facts = line_facts(known)
    gone = repeats(known, facts, every=every, long_words=long_words, min_words=min_words).union(runs(facts, run_words))
    of_doc = gone.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n_lines") - 1)))).alias("_gone"))
    rows = docs.withColumn("_key", F.xxhash64("text"))
    rows = rows.join(of_doc, rows["doc_id"].eqNullSafe(of_doc["_id"]) & (rows["_key"] == of_doc["_k"]), "left")
    rows = rows.withColumn("_lines", F.split("text", "\n"))
    flags = F.zip_with("_lines", F.sequence(F.lit(0), F.size("_lines") - 1), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    rows = rows.withColumn("_placed", F.when(F.col("_gone").isNotNull(), flags))
    left = F.transform(F.filter("_placed", lambda p: ~F.array_contains("_gone", p["i"])), lambda p: p["line"])
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size("_lines")).cast("long")
    out = rows.withColumns({"_left": text, "n_lines": n_lines, "n_removed_lines": F.coalesce(F.size(F.array_distinct("_gone")), F.lit(0)).cast("long")})
    kept = [F.col("_left").alias("text") if c == "text" else rows[c] for c in docs.columns]
    return out.select(*kept, "n_lines", F.when(F.col("_gone").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_removed_lines")).alias("n_removed_lines"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed_lines")


#: The same over DuckDB's lists and windows.
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, text, str_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM d),
f AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM l),
b AS (SELECT *, lag(h) OVER o AS h1, lag(h, 2) OVER o AS h2, lag(w) OVER o AS w1 FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, line, i, w, sum(CASE WHEN h1 IS NULL OR w >= {LONG_WORDS} OR w1 >= {LONG_WORDS}
      OR coalesce((((h2 * {MULTIPLIER}) % {PRIME} + h1) % {PRIME}) % {EVERY} = 0, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM b),
k AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n, sum(w) AS w FROM g GROUP BY doc_id, c),
e AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, c) AS nth FROM k WHERE w >= {MIN_WORDS} AND (n > 1 OR w >= {LONG_WORDS})),
gone AS (SELECT doc_id, c, n FROM e WHERE nth > 1),
s AS (SELECT doc_id, lines, list_transform(lines, lambda x: len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS ws FROM d WHERE len(lines) > 1),
y AS (SELECT doc_id, lines, list_transform(range(0, len(ws) + 1), lambda k: coalesce(list_sum(ws[1:k]), 0)) AS e FROM s),
x AS (SELECT doc_id, lines, e, unnest(range(0, len(lines) + 1)) AS i FROM y),
q AS (SELECT doc_id, lines, i AS lo, greatest(i + 2, list_position(list_transform(e, lambda v: v >= e[i + 1] + {RUN_WORDS}), true) - 1) AS hi FROM x WHERE e[-1] >= e[i + 1] + {RUN_WORDS}
      UNION SELECT doc_id, lines, least(i - 2, len(list_filter(e, lambda v: v <= e[i + 1] - {RUN_WORDS})) - 1), i FROM x WHERE e[i + 1] >= {RUN_WORDS}),
m AS (SELECT doc_id, lo, hi, first_value(doc_id) OVER o AS doc1, first_value(lo) OVER o AS lo1, row_number() OVER o AS nth FROM q WHERE lo >= 0 AND hi <= len(lines) AND hi >= lo + 2
      WINDOW o AS (PARTITION BY array_to_string(lines[lo + 1:hi], chr(10)), hi - lo ORDER BY doc_id, lo)),
r AS (SELECT doc_id, unnest(generate_series(CASE WHEN doc1 = doc_id THEN greatest(lo, lo1 + hi - lo) ELSE lo END, hi - 1)) AS i FROM m WHERE nth > 1),
z AS (SELECT g.doc_id, g.i, g.line, gone.c IS NOT NULL OR r.i IS NOT NULL AS away
      FROM g LEFT JOIN gone ON g.doc_id = gone.doc_id AND g.c = gone.c LEFT JOIN (SELECT DISTINCT * FROM r) AS r ON g.doc_id = r.doc_id AND g.i = r.i),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT away) AS text, count(*) AS n_lines, count(*) FILTER (WHERE away) AS n_removed_lines FROM z GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
       CASE WHEN coalesce(documents.text, '') = '' THEN 0 ELSE t.n_lines END AS n_lines, coalesce(t.n_removed_lines, 0) AS n_removed_lines
FROM documents LEFT JOIN t ON documents.doc_id = t.doc_id
"""
