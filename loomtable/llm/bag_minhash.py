r"""Near duplicates by BagMinHash: weighted Jaccard over the multiset of five-word shingles.

Words are the lower-cased runs of letters and digits; a text of fewer than five words is one
shingle of them all. The similarity of two texts is the weighted Jaccard of their shingles
with their counts; a link is a similarity of `least` or more.

Signatures. A shingle of weight w owns the weight levels [0, w). On the levels runs a
Poisson process of points (time, level, slot), fixed by the shingle alone; a slot of the
signature keeps the least time of the points below w. So two texts agree in a slot with a
probability equal to their similarity. The levels are cut into [0,1), [1,2), [2,4), [4,8)
and so on, each one process whose rate is its width: a weight takes log w of them, and of
the last only the points below w. Points are made in order of time and only until no slot
can change. All texts of a batch are worked on at once in numpy.

Candidates. Signatures of 128 slots are cut into 32 bands of 4 (a pair at 0.8 is missed with
a chance of 5e-8). Equal texts are one node. Texts that share a band are a bucket: in those
of up to `small` texts every pair is compared; in larger ones every text with the bucket's
hub, the text that shares most (its buckets' sizes summed, then the least id): the original
of a group of copies is such a one, and mostly the hub of all its buckets. Comparing is by
the shingles (32-bit hashes, each occurrence one feature), not by signatures: two texts of
500 words share a feature by chance once in 17,000 pairs, which moves a similarity by 0.001.

The exact rest. Texts of a hub that are not in the hub's component may still be alike to
others of it. Distances (one less the similarity) keep the triangle inequality, so two texts
can only be linked if their known distances to the hub differ by 0.2 at most: they stand in
the same or in neighbouring cells of that width. Cells with such texts are dealt in blocks of
at most `block` texts and `BLOCK_BYTES`, and a task compares a block's rest with the others
by an inverted index of their features. So no link between different components is lost.

Classes are the components of the links. Nothing of the corpus is collected to the driver.

Results of the odd cases: null and empty texts are equal texts of one class; texts without
letters or digits have no shingles and join only their exact copies; a text's id is the least
doc_id that has it; a null doc_id, and a doc_id whose least text (by MD5) is another one, take
a negative id from the text. Columns of the input besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table
from .components import components

SLOTS, ROWS, WORDS, LEAST = 128, 4, 5, 0.8
SMALL, BLOCK, BLOCK_BYTES = 8, 1024, 16 << 20
STEP_WORDS = 500_000  # of a batch worked on at once
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def golden(n: int) -> np.uint64:
    return np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Place of its text and hash of every shingle of some texts (arrays of word hashes)."""
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.concatenate(words).astype(np.int64).view(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = np.where(sizes >= WORDS, sizes - WORDS + 1, (sizes > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(words)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[doc]
    s = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        has = first + k < ends[doc]
        s = np.where(has, mix(s * GOLDEN + padded[first + k] + np.uint64(k + 1)), s)
    return doc, s


def signatures(doc: np.ndarray, s: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x SLOTS least times; infinity for texts without shingles."""
    h = np.full((n_docs, SLOTS), np.inf)
    if not len(doc):
        return h
    _, at, weight = np.unique(s ^ mix(doc.astype(np.uint64) + GOLDEN), return_index=True, return_counts=True)
    doc, s, weight = doc[at], s[at], weight.astype(np.float64)
    d_, key_, low_, wide_, w_ = [doc], [mix(s)], [np.zeros(len(doc))], [np.ones(len(doc))], [weight]
    low = 1.0
    while (more := weight > low).any():  # the levels [low, 2 low)
        n = int(more.sum())
        d_.append(doc[more]), key_.append(mix(s[more] + golden(int(low)))), low_.append(np.full(n, low)), wide_.append(np.full(n, low)), w_.append(weight[more])
        low *= 2
    doc, key, low, wide, weight = map(np.concatenate, (d_, key_, low_, wide_, w_))
    time = np.zeros(len(doc))
    flat = h.reshape(-1)
    nth = 0
    while len(doc):
        nth += 1
        r = mix(key + golden(nth))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / wide
        place = mix(r)
        slot = (place & np.uint64(SLOTS - 1)).astype(np.int64)
        level = low + wide * ((place >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        hit = level < weight
        np.minimum.at(flat, doc[hit] * SLOTS + slot[hit], time[hit])
        if nth == 1 or len(doc) > n_docs:
            worst = h.max(1)
        else:
            some = np.unique(doc)
            worst[some] = h[some].max(1)
        live = time < worst[doc]
        doc, key, low, wide, weight, time = doc[live], key[live], low[live], wide[live], weight[live], time[live]
    return h


def bands(h: np.ndarray) -> np.ndarray:
    """n x (SLOTS / ROWS) hashes of the signature's bands."""
    parts = h.view(np.uint64).reshape(len(h), -1, ROWS)
    out = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64) * GOLDEN
    for k in range(ROWS):
        out = mix(out * GOLDEN + parts[:, :, k])
    return out.view(np.int64)


def features(words: np.ndarray) -> bytes:
    """The sorted features of a text: a 32-bit hash of each shingle and its occurrence."""
    _, s = shingles([words])
    if not len(s):
        return b""
    s = np.sort(s)
    new = np.concatenate([[True], s[1:] != s[:-1]])
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return np.sort((mix(s + GOLDEN * nth.astype(np.uint64)) >> np.uint64(32)).astype("<u4")).tobytes()


def similarity(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.sort(np.concatenate([x, y]))
    same = int((both[1:] == both[:-1]).sum())
    return same / max(1, len(x) + len(y) - same)


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


@F.pandas_udf(T.ArrayType(T.LongType()))
def bands_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        out: list[np.ndarray | None] = []
        some: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            doc, s = shingles(some)
            has = np.bincount(doc, minlength=len(some)) > 0
            out.extend(row if ok else None for row, ok in zip(bands(signatures(doc, s, len(some))), has, strict=True))
            some.clear()

        for words in batch:
            some.append(words)
            size += len(words)
            if size >= STEP_WORDS:
                flush()
                size = 0
        if some:
            flush()
        yield pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def features_of(words: pd.Series) -> pd.Series:
    return pd.Series([features(w) for w in words], dtype=object)


@F.pandas_udf(T.DoubleType())
def similarity_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def rest_links(rows: pd.DataFrame, least: float) -> list[tuple[int, int]]:
    """Links of the rest with others among rows (id, component, rest, low, d, features), as many
    as it takes to join their components. Of two rows one must be low, and one of the rest."""
    ids, components, d = rows["id"].to_numpy(), rows["component"].tolist(), rows["d"].to_numpy()
    rest, low = rows["rest"].to_numpy(bool), rows["low"].to_numpy(bool)
    x = [np.frombuffer(f, "<u4") for f in rows["features"]]
    sizes = np.array([len(f) for f in x])
    values = np.concatenate(x)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(x), dtype=np.int32), sizes)[order]
    root = {c: c for c in components}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    found = []
    for i in np.flatnonzero(rest):
        near = (low | low[i]) & (np.abs(d - d[i]) <= 1 - least + 1e-6) & (sizes >= least * sizes[i] - 1e-6) & (sizes * least <= sizes[i] + 1e-6)
        near[i] = False
        if not near.any():
            continue
        lo, hi = np.searchsorted(values, x[i], "left"), np.searchsorted(values, x[i], "right")
        n = hi - lo
        shared = np.bincount(owner[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)], minlength=len(x))
        for j in np.flatnonzero(near & (shared >= least * (sizes + sizes[i] - shared) - 1e-6)):
            a, b = find(components[i]), find(components[j])
            if a != b:
                root[a] = b
                found.append((int(ids[i]), int(ids[j])))
    return found


def own_id() -> Column:
    return F.coalesce("doc_id", -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62)))


def text_hash() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def classes(docs: DataFrame, least: float = LEAST, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, _text (hash of the text), first (is this the doc_id that its text is known by?),
    node (the text's id), class_id for every row of docs (doc_id, text). class_id is the least
    id of the class."""
    rows = staged(docs.select("doc_id", own_id().alias("_id"), text_hash().alias("_text"), bands_of(word_hashes(F.col("text"))).alias("bands")), "near-bands")
    nodes = rows.groupBy("_text").agg(F.min("_id").alias("_first"), F.first("bands").alias("bands"))
    # Texts under one doc_id: all but the one of the least hash take an id of their own.
    slim = rows.groupBy("_text").agg(F.min("_id").alias("_first"))
    many = slim.groupBy("_first").agg(F.min("_text").alias("_least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    other = -1 - F.pmod(F.xxhash64("_text"), F.lit(1 << 62))
    nodes = staged(nodes.join(many, "_first", "left").withColumn("node", F.when(F.col("_text") != F.col("_least"), other).otherwise(F.col("_first"))).drop("_least"), "near-nodes")

    banded = nodes.select(F.col("node").alias("id"), F.explode("bands").alias("band")).distinct()
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = staged(banded.join(buckets, "band"), "near-members")
    large = members.filter(F.col("n") > small)
    shares = large.groupBy("id").agg(F.sum("n").alias("shares"))
    hubs = large.join(shares, "id").groupBy("band").agg(F.max(F.struct("shares", (-F.col("id")).alias("id"))).alias("most")).select("band", (-F.col("most.id")).alias("hub"))
    stars = staged(large.select("band", "id").join(hubs, "band").filter("id <> hub").select("hub", "id").distinct(), "near-stars")
    each = members.filter(F.col("n") <= small).groupBy("band").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    pairs = each.select(F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, small), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    candidates = staged(stars.select(F.col("hub").alias("a"), F.col("id").alias("b")).union(pairs).distinct(), "near-pairs")

    used = candidates.select(F.col("a").alias("node")).union(candidates.select(F.col("b").alias("node"))).distinct()
    used = nodes.select("node", "_first", "_text").join(used, "node", "left_semi")
    texts = docs.select(own_id().alias("_first"), text_hash().alias("_text"), "text").join(used, ["_first", "_text"])
    known = staged(texts.select(F.col("node").alias("id"), features_of(word_hashes(F.col("text"))).alias("features")).dropDuplicates(["id"]), "near-features")
    a, b = known.toDF("a", "fa"), known.toDF("b", "fb")
    compared = staged(candidates.join(b, "b").join(a, "a").select("a", "b", similarity_of("fa", "fb").alias("s")), "near-compared")
    links = compared.filter(F.col("s") >= least).select("a", "b")
    found = staged(components(links), "near-components")

    # The exact rest: texts of a hub outside its component, and what may be linked with them.
    of_hub = stars.join(compared.select(F.col("a").alias("hub"), F.col("b").alias("id"), "s"), ["hub", "id"])
    mine = found.toDF("id", "component")
    placed = of_hub.join(mine, "id", "left").join(found.toDF("hub", "hub_component"), "hub", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.select("hub", "id", "component", (1 - F.col("s")).alias("d"), (F.col("component") != F.coalesce("hub_component", "hub")).alias("rest"))
    cell = F.floor(F.col("d") / (1 - least) + 1e-9).cast("int")
    celled = placed.withColumn("cell", F.explode(F.array(cell, cell - 1))).withColumn("low", F.col("cell") == cell)
    celled = staged(celled.join(known.select("id", F.length("features").alias("bytes")), "id"), "near-cells")
    total = lambda of, what: F.sum(F.when(of, what).otherwise(0))
    blocks = lambda of: F.greatest(F.ceil(total(of, F.lit(1)) / block), F.ceil(total(of, F.col("bytes")) / BLOCK_BYTES)).cast("long")
    sizes = celled.groupBy("hub", "cell").agg(blocks(F.col("rest")).alias("r"), blocks(~F.col("rest")).alias("o")).filter("r > 0")
    mixed = celled.join(sizes, ["hub", "cell"])
    mixed = mixed.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("o"))))
    # A block of the rest meets every block of the others, and every block of the rest once.
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i < n)
    with_others = F.transform(upto(F.col("o")), lambda o: F.struct(F.lit(0).alias("kind"), F.col("mine").alias("x"), o.alias("y")))
    with_rest = F.transform(upto(F.col("r")), lambda r: F.struct(F.lit(1).alias("kind"), F.least("mine", r).alias("x"), F.greatest("mine", r).alias("y")))
    from_others = F.transform(upto(F.col("r")), lambda r: F.struct(F.lit(0).alias("kind"), r.alias("x"), F.col("mine").alias("y")))
    dealt = mixed.select("id", "component", "d", "rest", "low", "hub", "cell", F.explode(F.when(F.col("rest"), F.concat(with_others, with_rest)).otherwise(from_others)).alias("at")).select("*", "at.*").drop("at")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(rest_links(group, least), columns=["a", "b"], dtype="int64")

    more = staged(dealt.join(known, "id").groupBy("hub", "cell", "kind", "x", "y").applyInPandas(compare, "a long, b long"), "near-more")
    # Components of components: few, as only these links are new.
    joined = more.join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    outer = components(joined) if not more.isEmpty() else joined.limit(0)
    own = nodes.select("node", "_text", "_first").join(found.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = own.join(outer.toDF("component", "outer"), "component", "left").select("_text", "node", "_first", F.coalesce("outer", "component").alias("class_id"))
    return rows.select("doc_id", "_id", "_text").join(own, "_text").select("doc_id", "_text", (F.col("_id") == F.col("_first")).alias("first"), "node", "class_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs less all but one document (doc_id and text) of each class: the one whose id is the
    class's. Of rows with its doc_id and text, one stays."""
    key = ["doc_id", "_text"]
    state = classes(docs.select("doc_id", "text"), **how).groupBy(*key).agg(F.max(F.col("first") & (F.col("node") == F.col("class_id"))).alias("stays"), F.count(F.lit(1)).alias("n")).filter("NOT stays OR n > 1")
    state = staged(state.select(F.col("doc_id").alias("_of"), F.col("_text").alias("_t"), "stays"), "near-state")
    rows = docs.withColumn("_text", text_hash())
    same = rows["doc_id"].eqNullSafe(state["_of"]) & (rows["_text"] == state["_t"])
    left = rows.join(state, same, "left_anti")
    twice = state.filter("stays")
    if not twice.isEmpty():
        left = left.union(rows.join(twice, same, "left_semi").dropDuplicates(key))
    return left.select(*docs.columns)


def op9_bag_minhash(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id")
