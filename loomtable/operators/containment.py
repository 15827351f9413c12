"""Which of many keywords are contained in which texts, parts of words and phrases as well.

Keywords that fit a bound go into an Aho-Corasick automaton in every task: one pass over a text
finds all of them. More keywords than that are looked for by the rarest of their grams (one
shorter than a gram by itself), in an equi-join with the texts' grams that a bitmap lets through,
and what is found is compared. Both give the same rows.

Texts and keywords are compared in lower case. Blank keywords are in no text; a null text holds
none; of equal keywords each is found."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .sieve import BITS, bitmap

#: Signs of keywords that one automaton takes: it is sent to every executor and built in every worker.
AUTOMATON_SIGNS, GRAM = 1_000_000, 6
#: Odd factors of the grams' hashes.
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_BUILT: dict[str, object] = {}


def _automaton(name: str, keywords: list[str]):
    """The automaton of this name; a worker keeps the last one it built."""
    import ahocorasick

    if name not in _BUILT:
        made = ahocorasick.Automaton()
        for word in keywords:
            made.add_word(word, word)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[name] = made
    return _BUILT[name]


def _scanned(texts: DataFrame, text_id: str, text: str, keywords: list[str], name: str) -> DataFrame:
    """text_id, keyword by one automaton over keywords, whose size the caller has checked."""
    shared = texts.sparkSession.sparkContext.broadcast(keywords)
    rows = texts.select(text_id, F.lower(text).alias("_text")).filter("_text IS NOT NULL")
    kind = rows.schema[text_id].dataType.simpleString()
    keyword_count = len(keywords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _automaton(name, shared.value)
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1)):
                hits = {word for _, word in built.iter(t.as_py())} if keyword_count else set()
                at += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[text_id, "keyword"])

    return rows.mapInArrow(run, f"{text_id} {kind}, keyword string")


def _hashed(text: str, most: int) -> list[np.ndarray]:
    """64-bit hashes of every gram of 1 to `most` signs, by place."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for n in range(min(most, len(signs))):
        h = signs[n:] + np.uint64(1) if not out else out[-1][:-1] * ODD + signs[n:] + np.uint64(1)
        out.append(h)
    return out


def _place(h: np.ndarray) -> np.ndarray:
    """Where hashes stand in the bitmap."""
    return ((h ^ (h >> np.uint64(29))) * MIX) >> np.uint64(64 - (BITS - 1).bit_length())


def _keyword_grams(keywords: DataFrame) -> DataFrame:
    """keyword, gram, place: the grams of GRAM signs, or the whole of a shorter keyword."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            hashes = [np.unique(_hashed(w, GRAM)[-1]) for w in words]
            flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
            words = batch.column(0).take(pa.array(np.repeat(np.arange(len(words)), [len(h) for h in hashes])))
            yield pa.RecordBatch.from_arrays([words, pa.array(flat.view(np.int64)), pa.array(_place(flat).astype(np.int64))], names=["keyword", "gram", "place"])

    return keywords.mapInArrow(run, "keyword string, gram long, place long")


def _joined(texts: DataFrame, text_id: str, text: str, keywords: DataFrame) -> DataFrame:
    """text_id, keyword by the keywords' rarest gram in the texts; one pass over the texts, whose
    grams are asked for in a bitmap before any join."""
    grams = written(_keyword_grams(keywords), "keyword-grams")
    asked = texts.sparkSession.sparkContext.broadcast(bitmap(grams, F.col("place")))
    sizes = [r.n for r in keywords.select(F.least(F.char_length("keyword"), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM at most
    said = texts.select(F.col(text_id), F.lower(text).alias("_text"))
    kind = said.schema[text_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = asked.value
        for batch in batches:
            found = []
            for t in batch.column(1):
                hashes = _hashed(t.as_py() or "", GRAM)
                kept = [np.zeros(0, np.uint64)]
                for h in (hashes[n - 1] for n in sizes if n <= len(hashes)):
                    at = _place(h)
                    kept.append(h[bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1])
                found.append(np.unique(np.concatenate(kept)))
            flat = np.concatenate([np.zeros(0, np.uint64), *found])
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat.view(np.int64))], names=[text_id, "gram"])

    known = written(said.mapInArrow(run, f"{text_id} {kind}, gram long"), "text-grams")
    often = known.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(often, "gram", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    candidates = written(known.join(rarest.filter("least.n > 0").select("keyword", F.col("least.gram").alias("gram")), "gram").select(text_id, "keyword"), "candidates")
    return candidates.join(said, text_id).filter(F.contains("_text", "keyword")).select(text_id, "keyword").distinct()


def contained(texts: DataFrame, text_id: str, text: str, keywords: DataFrame, signs: int = AUTOMATON_SIGNS) -> DataFrame:
    """text_id, keyword (lower case) of every keyword in every text. keywords: a column keyword;
    text_id tells the texts apart."""
    words = written(keywords.select(F.lower("keyword").alias("keyword")).filter(F.trim("keyword") != "").distinct(), "keywords")
    if (words.agg(F.sum(F.length("keyword")).alias("n")).first()["n"] or 0) > signs:
        return _joined(texts, text_id, text, words)
    listed = [r.keyword for r in words.orderBy("keyword").collect()]  # of checked size
    return _scanned(texts, text_id, text, listed, uuid.uuid4().hex)
