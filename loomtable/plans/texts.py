"""Text, number and JSON functions, retrieval and expansion over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons, numbers
from ..functions import text as T
from ..operators import retrieval
from ..operators.containment import contained
from ..operators.expansion import expand
from ..operators.ordered import within_budget
from ..sources import markdown, vectors
from .registry import query

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"


@query(f"SELECT doc_id, len({TOKENS}) AS n, len(list_distinct({TOKENS})) AS n_distinct, coalesce({TOKENS}[1], '') AS first FROM documents")
def text_tokens(t):
    rows = t.documents.select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"))


@query("SELECT n_nationkey, array_to_string(list_concat(regexp_extract_all(lower(n_name), '[a-z0-9_]+'), ['你', '好', '你好', '世', '界', '世界', '中', '_1']), '|') AS v FROM nation")
def text_cjk(t):
    text = F.concat_ws(" ", "n_name", F.lit("你好，世界 中!_1"))
    return t.nation.select("n_nationkey", F.array_join(T.tokens(text), "|").alias("v"))


@query(r"SELECT doc_id, len(s) AS n_sentences, (len(s) + 1) // 2 AS n_chunks FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^。！？!?；;\n]+[。！？!?；;]?'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)")
def text_sentences(t):
    rows = t.documents.select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.size(T.in_groups(F.col("s"), 2)).alias("n_chunks"))


@query("SELECT doc_id, i::INTEGER AS i, substr(text, (i * 1000 + 1)::INTEGER, 1000) AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents WHERE length(text) > 0)")
def text_slices(t):
    return t.documents.select("doc_id", F.posexplode(T.slices(F.col("text"), 1000)).alias("i", "piece"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1)) AS n_p, regexp_extract_all(html, '(?is)<title>(.*?)</title>', 1)[-1] AS title FROM pages")
def text_tags(t):
    return t.pages.select("page_id", F.size(T.tag_contents(F.col("html"), "p")).alias("n_p"), T.last_tag(F.col("html"), "title").alias("title"))


@query("SELECT doc_id, length(regexp_replace(text, '[^一-龥a-zA-Z0-9]', '', 'g')) AS n_alnum, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE greatest(1, ceil(length(text) / 1.6)) END::BIGINT AS est FROM documents")
def text_alnum_estimate(t):
    return t.documents.select("doc_id", F.length(T.alnum(F.col("text"))).cast("long").alias("n_alnum"), T.token_estimate(F.col("text")).alias("est"))


@query("SELECT doc_id, regexp_replace(regexp_replace('<thinking a>x</thinking>' || source, '(?is)<thinking[^>]*>.*?</thinking>', '', 'g'), '(?i)</?thinking[^>]*>', '', 'g') AS s, replace(replace(source || '|' || chr(10), '|', chr(92) || '|'), chr(10), '<br>') AS cell, contains(text, 'the') AND contains(text, 'of') AS tagged FROM documents WHERE text IS NOT NULL")
def text_strip_escape(t):
    return t.documents.filter("text IS NOT NULL").select("doc_id", T.without_thinking(F.concat(F.lit("<thinking a>x</thinking>"), "source")).alias("s"), T.markdown_cell(F.concat("source", F.lit("|\n"))).alias("cell"), T.has_all(F.col("text"), ["the", "of"]).alias("tagged"))


@query("SELECT p_partkey, list_aggregate(list_slice(list_distinct_ordered, 1, 5), 'string_agg', ',') AS k FROM (SELECT p_partkey, list_filter(g, lambda x, i: list_position(g, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, list_concat(list_transform(range(1, length(s) - 2), lambda i: substr(s, i::INTEGER, 4)), list_transform(range(1, length(s) - 1), lambda i: substr(s, i::INTEGER, 3)), list_transform(range(1, length(s)), lambda i: substr(s, i::INTEGER, 2))) AS g FROM (SELECT p_partkey, regexp_replace(p_name, '[^一-龥a-zA-Z0-9]', '', 'g') AS s FROM part)))")
def text_gram_keywords(t):
    return t.part.select("p_partkey", F.array_join(T.gram_keywords(F.col("p_name"), 5), ",").alias("k"))


@query("SELECT c_custkey, lower(trim(c_name)) AS k, lower(replace(c_name, '#', '_')) AS s FROM customer")
def text_keys(t):
    return t.customer.select("c_custkey", T.match_key("c_name").alias("k"), T.slug(F.col("c_name")).alias("s"))


@query("SELECT s_suppkey, sha256('{\"s_acctbal\":1,\"s_name\":\"' || s_name || '\"}') AS d FROM supplier")
def text_digest(t):
    return t.supplier.select("s_suppkey", "s_name", F.lit(1).alias("s_acctbal")).select("s_suppkey", T.digest(["s_name", "s_acctbal"]).alias("d"))


@query()
def fuzzy_match(t):
    """Whole benchmark items in whole documents."""
    return retrieval.fuzzy_pairs(t.documents, t.benchmark)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(t):
    return t.events.select("event_id", jsons.field(F.col("props"), "k").alias("k"))


@query("SELECT event_id, '{\"a\": [' || event_id || ', \"' || event_type || '\"], \"b\": ' || user_id || '}' AS v FROM events")
def json_repair(t):
    """Curly quotes, a bare key, a trailing comma and a line end in each event's text."""
    broken = F.concat(F.lit("{“a”: ["), "event_id", F.lit(", “"), "event_type", F.lit("”,],\n b: "), "user_id", F.lit(",}"))
    return t.events.select("event_id", jsons.repaired(broken).alias("v"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS s, o_orderdate >= TIMESTAMP '1995-01-01 00:00' AND o_orderdate <= TIMESTAMP '1996-12-31 23:59' AS inside FROM orders")
def time_ranges(t):
    s = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")
    lo, hi = [F.try_to_timestamp(F.trim(F.element_at(F.split(F.lit("1995-01-01 00:00 ~ 1996-12-31 23:59"), "~"), i)), F.lit("yyyy-MM-dd HH:mm")) for i in (1, 2)]
    return t.orders.select("o_orderkey", s.alias("s"), F.col("o_orderdate").between(lo, hi).alias("inside"))


@query("SELECT p_partkey, floor((p_size * 3 + 7) / 4)::BIGINT AS c FROM part")
def calc_floor(t):
    return t.part.select("p_partkey", numbers.calculated("(p_size * 3 + 7) / 4").alias("c"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 0.45 ELSE greatest(0, least(1, value)) END::DOUBLE AS v FROM events")
def clamp_scores(t):
    return t.events.select("event_id", numbers.clamped(F.col("value"), 0.0, 1.0, 0.45).alias("v"))


@query("SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_nationkey) AS row_id, n_name FROM nation")
def next_row_ids(t):
    old = t.supplier.select(F.col("s_suppkey").alias("row_id"))
    return numbers.with_row_ids(old, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"]).select("row_id", "n_name")


@query("SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 20")
def cosine_topk(t):
    q = t.embeddings.filter("vec_id = 7").first()["embedding"]
    return retrieval.top(retrieval.dense(t.embeddings, q), 20).withColumn("score", F.round("score", 6))


@query("""SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0)) WHERE rank <= 10 AND score >= 0.2""")
def cosine_topk_many(t):
    """Every twentieth vector as a query against all, a few kilobytes of queries at once."""
    queries = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_many(t.embeddings, queries, 10, 0.2, query_bytes=8 << 10)


QUERY = "the and thand heonha"
BM25 = f"""w AS (SELECT doc_id, {TOKENS} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM w),
f AS (SELECT doc_id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM w) WHERE term IN ('the', 'and', 'thand', 'heonha') GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM f JOIN g USING (term), s GROUP BY doc_id)"""


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 50")
def bm25_topk(t):
    return retrieval.top(retrieval.bm25(t.documents, [QUERY]), 50).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) GROUP BY ALL")
def term_frequencies(t):
    return retrieval.term_counts(t.documents, "doc_id", "text").select("doc_id", "term", "tf")


@query(f"""WITH {BM25}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY rank LIMIT 100),
v AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS score FROM embeddings),
d AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM v ORDER BY rank LIMIT 100)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM r UNION ALL SELECT * FROM d) GROUP BY doc_id""")
def rrf_fusion(t):
    q = t.embeddings.filter("vec_id = 7").first()["embedding"]
    sparse = retrieval.top(retrieval.bm25(t.documents, [QUERY]), 100)
    near = retrieval.top(retrieval.dense(t.embeddings, q), 100)
    return retrieval.fused(sparse, near).withColumn("score", F.round("score", 9))


@query()
def hybrid_recall(t):
    q = t.embeddings.filter("vec_id = 7").first()["embedding"]
    return retrieval.recall(t.documents, t.embeddings, QUERY, q, 50, 200).withColumn("score", F.round("score", 9))


@query("SELECT l_orderkey, arg_max(l_linenumber, l_extendedprice) AS l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey")
def best_chunk_per_row(t):
    """Of equal prices the row that is stored first, as where DuckDB reads the table in one thread."""
    stored = {"_file": F.col("_metadata.file_path"), "_nth": F.col("_metadata.row_index")}
    chunks = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", *[c.alias(n) for n, c in stored.items()])
    return retrieval.best_per_row(chunks, "l_orderkey", F.col("l_extendedprice"), list(stored)).drop(*stored)


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def vector_codec(t):
    back = t.embeddings.select("vec_id", vectors.unpacked(vectors.packed("embedding")).alias("v"))
    return back.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE greatest(1, ceil(length(text) / 1.6)) END::BIGINT AS cost FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM d),
x(source, doc_id, cost, k, used, taken, fits) AS (SELECT source, doc_id, cost, k, CASE WHEN cost <= 5000 THEN cost ELSE 0 END, (cost <= 5000)::INTEGER, cost <= 5000 FROM r WHERE k = 1
UNION ALL SELECT r.source, r.doc_id, r.cost, r.k, x.used + CASE WHEN x.taken < 6 AND x.used + r.cost <= 5000 THEN r.cost ELSE 0 END, x.taken + (x.taken < 6 AND x.used + r.cost <= 5000)::INTEGER, x.taken < 6 AND x.used + r.cost <= 5000 FROM x JOIN r ON r.source = x.source AND r.k = x.k + 1)
SELECT source, doc_id, cost FROM x WHERE fits""")
def budget_topk(t):
    rows = t.documents.select("source", "doc_id", T.token_estimate(F.col("text")).alias("cost"))
    return within_budget(rows, "source", ["doc_id"], "cost", 5000, 6)


#: Of each item: its second to fifth sign (part of a word) and its first two words (a phrase).
ITEM_KEYS = "[substr(lower(text), 2, 4), regexp_extract(lower(text), '[a-z]+ [a-z]+')]"


def _item_keys():
    text = F.lower("text")
    return F.array(F.substring(text, 2, 4), F.regexp_extract(text, "[a-z]+ [a-z]+", 0))


@query(f"""WITH RECURSIVE e AS (SELECT item_id AS id, lower(text) AS t, list_filter({ITEM_KEYS}, lambda k: trim(k, ' ') <> '') AS k, item_id % 13 = 0 AS constant, item_id % 5 <> 0 AS follows, item_id % 7 <> 0 AS passes FROM benchmark),
said AS (SELECT DISTINCT a.id AS of, b.id AS id FROM e a JOIN (SELECT id, unnest(k) AS k FROM e WHERE follows AND NOT constant) b ON contains(a.t, b.k) WHERE a.passes),
x AS (SELECT id, 0 AS round FROM e WHERE constant UNION SELECT id, 1 FROM (SELECT id, unnest(k) AS k FROM e WHERE NOT constant) WHERE contains('and then the heart of the others was there', k)
      UNION SELECT s.id, x.round + 1 FROM x JOIN said s ON s.of = x.id WHERE x.round < 10)
SELECT id AS entry_id, min(round)::INTEGER AS round FROM x GROUP BY id""")
def keyword_expansion(t):
    entries = t.benchmark.select(F.col("item_id").alias("entry_id"), _item_keys().alias("keywords"), F.col("text").alias("content"), (F.col("item_id") % 13 == 0).alias("constant"), (F.col("item_id") % 7 != 0).alias("passes_on"), (F.col("item_id") % 5 != 0).alias("can_follow"))
    return expand(entries, "And then the heart of the others was there")


@query(f"SELECT DISTINCT doc_id, k AS keyword FROM documents JOIN (SELECT unnest({ITEM_KEYS}) AS k FROM benchmark) ON trim(k, ' ') <> '' AND contains(lower(text), k)")
def join_contained(t):
    """Every document with every item's phrase or part of a word that it holds."""
    return contained(t.documents, "doc_id", "text", t.benchmark.select(F.explode(_item_keys()).alias("keyword")))


@query(f"SELECT DISTINCT doc_id, k AS keyword FROM documents JOIN (SELECT unnest({ITEM_KEYS}) AS k FROM benchmark) ON trim(k, ' ') <> '' AND contains(lower(text), k)")
def join_contained_by_grams(t):
    """The same as if the keywords were too many for an automaton."""
    return contained(t.documents, "doc_id", "text", t.benchmark.select(F.explode(_item_keys()).alias("keyword")), signs=100)


@query("SELECT n_nationkey, '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation")
def markdown_sink(t):
    return markdown.lines(t.nation, "n_nationkey", ["n_name", "n_regionkey"])


@query("SELECT n_nationkey::VARCHAR AS a, n_name AS b, '' AS c FROM nation")
def markdown_parse(t):
    text = F.concat_ws("\n", F.lit("# nation"), F.lit(markdown.header(["k", "n"])), F.concat(F.lit("| "), F.col("n_nationkey"), F.lit(" | "), F.col("n_name"), F.lit(" |")))
    return t.nation.select(F.explode(markdown.parse(text, 3)).alias("r")).select(F.col("r")[0].alias("a"), F.col("r")[1].alias("b"), F.col("r")[2].alias("c"))


@query("SELECT s_suppkey, '- s_name: ' || s_name || chr(10) || '- s_nationkey: ' || s_nationkey AS text FROM supplier")
def record_sink(t):
    return markdown.records(t.supplier, "s_suppkey", ["s_name", "s_nationkey"])


@query("SELECT p_partkey, CASE WHEN contains(p_type, ' ') THEN p_type || '|' || replace(p_type, ' ', '(') || '|' || split_part(p_type, ' ', 1) ELSE p_type END AS k, p_name AS content FROM part")
def keyword_entries(t):
    rows = t.part.withColumn("keys", F.concat(F.col("p_type"), F.lit("，"), F.regexp_replace("p_type", " ", "(")))
    return markdown.entries(rows, "p_partkey", "keys", F.col("p_name")).select("p_partkey", F.array_join("keywords", "|").alias("k"), "content")
