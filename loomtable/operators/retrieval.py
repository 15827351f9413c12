"""Retrieval over text and vectors: BM25, cosine, reciprocal rank fusion, and their union.

Queries are small frames (a row each); the corpus is scanned once. Scores are partial sums by
(query, document); only top-k rows leave a partition (a bounded sort), never whole ranks."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine
from ..functions.text import fuzzy_score, tokens, words_of
from ..session import written
from .sieve import BITS, bitmap

K1, B, RRF_K = 1.5, 0.75, 60
#: Rows of terms that a task holds before it hands them on.
ROWS_OUT = 100_000


def term_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_terms, term, tf. A document is counted within its row, without a shuffle; only
    where an id repeats are the counts of rows added up by id."""
    import pyarrow as pa

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, n, terms, tf = [], [], [], []

            def made():
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(terms, pa.string()), pa.array(tf, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_terms", "term", "tf"])

            for i, t in enumerate(batch.column(1)):
                found = words_of(t.as_py())
                counted = Counter(found)
                at += [i] * len(counted)
                n += [len(found)] * len(counted)
                terms += counted
                tf += counted.values()
                if len(at) >= ROWS_OUT:
                    yield made()
                    at, n, terms, tf = [], [], [], []
            yield made()

    counts = rows.mapInArrow(run, f"doc_id {kind}, n_terms int, term string, tf long")
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        return counts
    merged = counts.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return merged.select("doc_id", F.sum("tf").over(Window.partitionBy("doc_id")).cast("int").alias("n_terms"), "term", "tf")


def bm25(docs: DataFrame, queries: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query (place in the list), doc_id, score > 0. Only the queries' terms are counted; the
    length statistics are of all documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("_t"))
    asked = spark.createDataFrame(list(enumerate(queries)), "query int, q string").select("query", F.explode(F.array_distinct(tokens(F.col("q")))).alias("term"))
    terms = [r["term"] for r in asked.select("term").distinct().collect()]  # of the queries
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    hits = rows.select("doc_id", F.size("_t").alias("n_terms"), F.filter("_t", lambda t: F.array_contains(wanted, t)).alias("_t"))
    facts = hits.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("avg_terms"))
    tf = hits.select("doc_id", "n_terms", F.explode("_t").alias("term")).groupBy("doc_id", "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    known = F.broadcast(df.join(asked, "term").crossJoin(facts))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.col("avg_terms")))
    return tf.join(known, "term").groupBy("query", "doc_id").agg(F.sum(part).alias("score")).filter("score > 0")


def dense(vectors: DataFrame, query: list[float], vec_id: str = "vec_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """doc_id, score by cosine with one query vector; a scan, no shuffle."""
    out = vectors.select(F.col(vec_id).alias("doc_id"), cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return out if least is None else out.filter(F.col("score") >= least)


def top(scored: DataFrame, k: int, by: str = "score", tie: str = "doc_id", scope: str | None = None) -> DataFrame:
    """The k best with their rank from 1; of each scope if given."""
    if scope is None:
        best = scored.orderBy(F.desc(by), tie).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), tie)))  # of k rows
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(by), tie))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def fused(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """doc_id, score: the sum of 1 / (k + rank) over ranked lists (doc_id, rank)."""
    parts = [r.select("doc_id", (1 / (k + F.col("rank"))).alias("part")) for r in ranked]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    return both.groupBy("doc_id").agg(F.sum("part").alias("score"))


def reranked(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """ranked with outside scores (doc_id, rerank) in place of its own where given; its own order
    (rank) tells ties apart."""
    return ranked.join(scores, "doc_id", "left").withColumn("score", F.coalesce("rerank", "score")).drop("rerank")


def recall(docs: DataFrame, vectors: DataFrame, text_query: str, vector_query: list[float], n_pinned: int, k: int, order: str = "doc_id", candidates: int = 1000, least: float = 0.45) -> DataFrame:
    """doc_id, source ('pinned' or 'found'), score: the most recent rows, and the k best of
    the older ones by both ways fused; in order."""
    pinned = docs.orderBy(F.desc(order)).limit(n_pinned).select("doc_id")
    older = docs.join(F.broadcast(pinned), "doc_id", "left_anti")
    sparse = top(bm25(older, [text_query]).drop("query"), candidates)
    near = vectors.join(F.broadcast(pinned.withColumnRenamed("doc_id", "vec_id")), "vec_id", "left_anti")
    near = near.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    found = top(fused(sparse, top(dense(near, vector_query, least=least), candidates)), k)
    out = pinned.select("doc_id", F.lit("pinned").alias("source"), F.lit(None).cast("double").alias("score"))
    return out.unionAll(found.select("doc_id", F.lit("found").alias("source"), "score"))


def best_per_row(chunks: DataFrame, row_key: str, by: Column, ties: list[Column | str] | None = None) -> DataFrame:
    """The best chunk of each row, by a partial maximum of a number. Of equal ones that with the
    least ties (columns of chunks), else with the least cells; chunks whose number is null lose."""
    cells = [c for c in chunks.columns if c != row_key]
    first = F.when(by.isNotNull(), F.struct(~F.isnan(by), -by, *(ties or cells)))
    return chunks.groupBy(row_key).agg(F.min_by(F.struct(*cells), first).alias("_best")).select(row_key, "_best.*")


def prepared_rows(df: DataFrame, table: str, row_id: str, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """row_key, row_id, cells, fingerprint of the rows to index. names: each cell with the
    headers that it may have; rows that are blank in `summary` or `code` go. A table without a
    column for one of these raises."""
    found = {cell: next((c for c in df.columns if c in own), None) for cell, own in names.items()}
    if missing := [c for c in ("summary", "code") if not found.get(c)]:
        raise ValueError(f"no column for {', '.join(missing)}")
    cell = lambda c: F.trim(F.coalesce(F.col(found[c]).cast("string"), F.lit(""))) if found[c] else F.lit("")
    rows = df.select(F.col(row_id), *[cell(c).alias(c) for c in names]).filter("summary <> '' AND code <> ''")
    key = F.concat_ws(":", F.lit(table), F.col(row_id).cast("string"), "code")
    return rows.withColumns({"row_key": key, "fingerprint": F.sha2(F.concat_ws("\x1f", *names), 256)})


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks with their vectors; those without one (or an empty one) go."""
    return chunks.join(vectors.filter(F.size("embedding") > 0), key)


def query_text(text: Column, keywords: Column) -> Column:
    """What is searched for: an input and its keywords."""
    return F.trim(F.concat_ws(" ", text, F.array_join(keywords, " ")))


def fuzzy_pairs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: float = 0.4) -> DataFrame:
    """doc_id, item_id, score: whole items found in whole documents, by `fuzzy_score`.

    Looked at are the pairs of a document and an item that share at least `least` of the item's
    distinct word pairs; they come from a join on the word pairs that a bitmap of the items' pairs
    lets through. Items of under two words match nothing. Repeated rows repeat their result, rows of one id with
    different texts are matched alone, null ids stay null."""
    import pyarrow as pa

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))

    own = items.select(F.col(item_id).alias("item_id"), F.xxhash64(text).alias("_item_id"), pairs(tokens(F.col(text))).alias("_p")).filter(F.size("_p") > 0)
    own = own.select("item_id", "_item_id", F.size("_p").alias("_n_item_id"), F.explode("_p").alias("_g"))
    asked = docs.sparkSession.sparkContext.broadcast(bitmap(own, F.crc32(F.encode("_g", "utf-8")).bitwiseAND(F.lit(BITS - 1))).tobytes())
    said = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    kind = said.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bits, mask = asked.value, BITS - 1
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(2)):
                w = words_of(t.as_py())
                hits = [p for p in set(map(" ".join, zip(w, w[1:], strict=False))) if bits[(h := crc32(p.encode()) & mask) >> 3] >> (h & 7) & 1]
                at += [i] * len(hits)
                found += hits
            ids = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.array(found, pa.string())], names=["doc_id", "_doc_id", "_g"])

    def texts(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_k"), F.col(text).alias(f"_text_{name}"))

    shared = said.mapInArrow(run, f"doc_id {kind}, _doc_id long, _g string").join(own, "_g")
    near = shared.groupBy("doc_id", "_doc_id", "item_id", "_item_id", "_n_item_id").agg(F.size(F.collect_set("_g")).alias("_n"))
    near = written(near.filter(F.col("_n") >= F.ceil(F.lit(least) * F.col("_n_item_id") - 1e-9)), "near-items")
    for df, key, name in ((items, item_id, "item_id"), (docs, doc_id, "doc_id")):
        near = near.join(texts(df, key, name), (F.col(f"_{name}") == F.col("_k")) & F.col(name).eqNullSafe(F.col("_id"))).drop("_id", "_k")
    return near.select("doc_id", "item_id", fuzzy_score(F.col("_text_item_id"), F.col("_text_doc_id")).alias("score")).filter("score > 0")


#: Bytes of query vectors that are multiplied at once.
QUERY_BYTES = 32 << 20
#: Bytes of vectors, as doubles, and of queries in one block: a task holds one of each.
BLOCK_BYTES = 8 << 20
#: Scores that a task holds at once.
SCORES = 1 << 20


def _by_length(vectors) -> list:
    """Places and matrix of the vectors of each length in an Arrow column; null ones go."""
    import numpy as np

    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    known = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    n = lengths[known].astype(np.int64)
    starts = np.cumsum(n) - n
    return [(known[n == m], flat[starts[n == m][:, None] + np.arange(m)]) for m in np.unique(n)]


def dense_many(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, query_bytes: int = QUERY_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, vec_id, score, rank: of every query (query_id, embedding) the k vectors (vec_id,
    embedding) of the greatest cosine, ties by vec_id, no score under `least`. Vectors and queries
    are dealt into blocks by their ids, and every pair of blocks meets in a task of its own; it
    multiplies query_bytes of queries at once and keeps k rows a query, and only those meet by
    query. Only the number of blocks comes to the driver. Scores have nine digits, so
    that the order does not hang on the last bits. Vectors of unlike length are compared on
    the length they share, a zero vector scores 0, a null one is no vector."""
    import numpy as np
    import pyarrow as pa

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "vec_id"))}

    def dealt(df: DataFrame, key: str) -> tuple[DataFrame, int]:
        own = df.select(key, "embedding").filter("embedding IS NOT NULL")
        n = -(-8 * (own.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0) // block_bytes) or 1
        return own.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n

    (v, n_v), (q, n_q) = dealt(vectors, "vec_id"), dealt(queries, "query_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumnRenamed("_own", "_v").withColumn("_q", every(n_q))
    q = q.withColumnRenamed("_own", "_q").withColumn("_v", every(n_v))
    arrow = {"bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([("query_id", arrow.get(kinds["query_id"], pa.string())), ("vec_id", arrow.get(kinds["vec_id"], pa.string())), ("score", pa.float64())])

    def unit(m: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(m, axis=1)[:, None]
        return np.divide(m, norms, out=np.zeros(m.shape), where=norms > 0)

    def best(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not asked.num_rows or not given.num_rows:
            return schema.empty_table()
        # Ids by their rank, so that ties are told by whole numbers; equal vectors stand by id.
        given = given.sort_by("vec_id").combine_chunks()
        asked = asked.combine_chunks()
        column = lambda t, c: t.column(c).chunk(0)
        parts = _by_length(column(given, "embedding"))
        rows, found, scores = [], [], []
        for places, a in _by_length(column(asked, "embedding")):
            units = [(at, unit(b[:, : a.shape[1]])) for at, b in parts]
            step = max(1, min(query_bytes // max(1, 8 * a.shape[1]), SCORES // given.num_rows))
            for lo in range(0, len(a), step):
                some, own = places[lo : lo + step], []
                for at, y in units:
                    near = unit(a[lo : lo + step, : y.shape[1]]) @ y.T
                    bar = np.full(len(near), least)
                    if len(y) > k:
                        bar = np.maximum(bar, np.partition(near, len(y) - k, axis=1)[:, len(y) - k])
                    i, j = np.nonzero(near >= bar[:, None] - 2e-9)  # whatever rounds to the bar
                    s = np.round(near[i, j], 9) + 0.0
                    own.append((i[s >= least], at[j[s >= least]], s[s >= least]))
                i, j, s = (np.concatenate(c) for c in zip(*own, strict=True))
                order = np.lexsort((j, -s, i))
                i, j, s = i[order], j[order], s[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                rows.append(some[i[kept]])
                found.append(j[kept])
                scores.append(s[kept])
        if not rows:
            return schema.empty_table()
        taken = [asked.column("query_id").take(pa.array(np.concatenate(rows))), given.column("vec_id").take(pa.array(np.concatenate(found)))]
        return pa.table([*(c.cast(t) for c, t in zip(taken, schema.types, strict=False)), pa.array(np.concatenate(scores))], schema=schema)

    met = q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v"))
    found = met.applyInArrow(best, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))  # k rows a block
    return found.withColumn("rank", nth).filter(F.col("rank") <= k)
