r"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Words are the lower-cased runs of letters and digits. A test item has a question and an
answer: its last sentence if it and what comes before have eight words at least, otherwise
the whole is both. Training passages are windows of twice the longest item's words that
begin at each multiple of that length, so any run as long as an item lies in one passage.
Every passage of every text is a query.

Bound. `need` of an item is the least BM25 score that a passage can have which holds
`least` of the question's words, or of the item's: the item's own score less the most
that the words left out can weigh. Impacts are divided by it, so the threshold is 1 for
every item and a passage that would be verified is always retrieved.

Index. Postings of a word are sorted by item, in blocks of `BLOCK` items, each with its
largest impact; a word has its largest of all. For the passages of a batch at once, in numpy:
words sorted by their largest impact, smallest first, make the passage's pivot where their
running sum reaches 1 (none: nothing can be found); only words from the pivot on name
blocks; a block whose block maxima, summed over all words of the passage, stay under 1 is
skipped unread; in the others every posting is summed. Items at 1 or more are retrieved.

Verification. Words of the item that stand in five-word shingles shared with the passage
are covered. An item leaks as a `whole` if `least` of all its words are covered, or as `both`
if `least` of its question's and `least_answer` of its answer's words are. A passage that
covers the question alone is reported apart, as `question`: it is no leak. Items of under
five words must occur as a whole.

Size. Document frequencies and lengths are those of all items. Items are dealt by hash over
shards of about `shard_postings` postings, built by executors and written to the shared
folder; a task hashes its texts once and reads the shards from there, one after the other.
What a task holds is bounded however large the benchmark is; the driver holds none of it.

Results of the odd cases: null and empty texts and items leak nothing; an empty benchmark
finds nothing; rows with equal doc_id are judged alone and give their best row once; equal
items are each reported; a null doc_id is reported as null. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bag_minhash import word_hashes
from .common import kept_in_worker, new_folder, staged, table, text_key

K1, B, LEAST, LEAST_ANSWER, SHINGLE = 1.5, 0.75, 0.8, 0.5, 5
KINDS = ["question", "both", "whole"]
BLOCK, SHARD_POSTINGS, PART_WORDS = 32, 2_000_000, 8
STEP_WORDS = 300_000  # of passages worked on at once


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    if not len(counts):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def shingled(words: np.ndarray) -> np.ndarray:
    """A hash for each five words in a row."""
    h = words.astype(np.int64).view(np.uint64)
    out = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """A shard of the index. items: (item_id, words, n_question) and the weights of their
    words (idf), avg: words of an item on average."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], idf: dict[int, float], avg: float, least: float, least_answer: float):
        self.items, self.least, self.least_answer = items, least, least_answer
        terms, owners, impacts = [], [], []
        for place, (_, words, n_question) in enumerate(items):
            own, at, tf = np.unique(words, return_inverse=True, return_counts=True)
            score = np.array([idf[int(w)] for w in own]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / avg))
            need = min(self._need(score, at, n_question, least), self._need(score, at, len(words), least))
            terms.append(own)
            owners.append(np.full(len(own), place))
            impacts.append(score / need)
        term, owner, impact = map(np.concatenate, (terms, owners, impacts))
        order = np.lexsort((owner, term))
        term, self.owner, self.impact = term[order], owner[order].astype(np.int64), impact[order]
        self.terms, first, count = np.unique(term, return_index=True, return_counts=True)
        term_at = np.repeat(np.arange(len(self.terms)), count)
        self.largest = np.maximum.reduceat(self.impact, first)
        self.n_blocks = len(items) // BLOCK + 1
        # Blocks: a word's postings with items of one block.
        self.block_key, self.block_first, self.block_count = np.unique(term_at * self.n_blocks + self.owner // BLOCK, return_index=True, return_counts=True)
        self.block_largest = np.maximum.reduceat(self.impact, self.block_first)
        self.word_first = np.searchsorted(self.block_key, np.arange(len(self.terms)) * self.n_blocks)
        self.word_blocks = np.diff(np.append(self.word_first, len(self.block_key)))

    @staticmethod
    def _need(score: np.ndarray, at: np.ndarray, n: int, least: float) -> float:
        """The least score of a passage with `least` of the first n words: each distinct word
        that may be missing takes one of the places left out at least."""
        own = np.sort(score[np.unique(at[:n])])
        missing = int(n * (1 - least) + 1e-9)
        return max(float(own[: max(1, len(own) - missing)].sum()) * (1 - 1e-9), 1e-9)

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, items and scores at or above the threshold. passage, term: the distinct
        (passage, place of the word in terms) pairs, sorted by passage."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(passage):
            return none
        nb = self.n_blocks
        most = self.largest[term]
        new = np.concatenate([[True], passage[1:] != passage[:-1]])
        begins = np.flatnonzero(new)
        live = np.add.reduceat(most, begins) >= 1
        live = np.repeat(live, np.diff(np.append(begins, len(passage))))
        passage, term, most = passage[live], term[live], most[live]
        if not len(passage):
            return none
        order = np.lexsort((most, passage))
        passage, term, most = passage[order], term[order], most[order]
        new = np.concatenate([[True], passage[1:] != passage[:-1]])
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(passage)))
        total = np.cumsum(most)
        running = total - np.repeat(total[begins] - most[begins], lengths)
        beyond = running >= 1 - 1e-6  # the pivot and the words after it
        names = np.repeat(np.flatnonzero(beyond), self.word_blocks[term[beyond]])
        blocks = self.block_key[runs(self.word_first[term[beyond]], self.word_blocks[term[beyond]])] % nb
        nth = np.cumsum(new) - 1  # the passage's place among the live ones
        asked = np.unique(nth[names] * nb + blocks)
        # The bound of each (passage, block) asked for, over all words of the passage.
        of, block = asked // nb, asked % nb
        pair = np.repeat(np.arange(len(asked)), lengths[of])
        key = term[runs(begins[of], lengths[of])] * nb + block[pair]
        at = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        has = self.block_key[at] == key
        pair, at = pair[has], at[has]
        reach = np.bincount(pair, self.block_largest[at], len(asked)) >= 1 - 1e-6
        pair, at = pair[reach[pair]], at[reach[pair]]
        if not len(pair):
            return none
        # Every posting of the blocks left.
        posting = runs(self.block_first[at], self.block_count[at])
        found, place = np.unique(of[np.repeat(pair, self.block_count[at])] * len(self.items) + self.owner[posting], return_inverse=True)
        score = np.bincount(place, self.impact[posting], len(found))
        good = score >= 1 - 1e-6
        return passage[begins][found[good] // len(self.items)], found[good] % len(self.items), score[good]

    def overlap(self, words: np.ndarray, item: int) -> tuple[float, float, float]:
        """Shares of the question, the answer and the whole item that the passage covers."""
        _, own, n_question = self.items[item]
        if len(own) < SHINGLE:
            w = np.lib.stride_tricks.sliding_window_view(words, len(own)) if len(words) >= len(own) else np.zeros((0, len(own)))
            share = float((w == own).all(1).any())
            return share, share, share
        shared = np.isin(shingled(own), shingled(words))
        covered = np.zeros(len(own), bool)
        for k in range(SHINGLE):
            covered[k : k + len(shared)] |= shared
        answer = covered[n_question:] if n_question < len(own) else covered
        return float(covered[:n_question].mean()), float(answer.mean()), float(covered.mean())

    def leaks(self, texts: list[np.ndarray], length: int) -> Iterator[tuple[int, int, float, float, float, str]]:
        """text's place, item, score, question and answer overlap, kind of every leak; the best
        passage's for each text and item."""
        step: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, words in enumerate(texts):
            if len(words):
                step.append((i, words))
                size += len(words)
            if size >= STEP_WORDS:
                yield from self._step(step, length)
                step, size = [], 0
        if step:
            yield from self._step(step, length)

    def _step(self, step: list[tuple[int, np.ndarray]], length: int) -> Iterator[tuple[int, int, float, float, float, str]]:
        sizes = np.array([len(w) for _, w in step])
        words = np.concatenate([w for _, w in step])
        ends = np.cumsum(sizes)
        slot = -(-sizes // length)  # passages of each text
        first_slot = np.cumsum(slot) - slot
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == words)
        text = np.searchsorted(ends, known, side="right")
        place = (known - (ends - sizes)[text]) // length
        passage = first_slot[text] + place
        earlier = place > 0
        pairs = np.unique(np.concatenate([passage * len(self.terms) + at[known], (passage[earlier] - 1) * len(self.terms) + at[known][earlier]]))
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        for p, item, score in zip(*self.retrieve(pairs // len(self.terms), pairs % len(self.terms)), strict=True):
            k = int(np.searchsorted(first_slot, p, side="right")) - 1
            start = int(p - first_slot[k]) * length
            question, answer, whole = self.overlap(step[k][1][start : start + 2 * length], int(item))
            if max(question, whole) >= self.least - 1e-9:
                kind = 2 if whole >= self.least - 1e-9 else int(answer >= self.least_answer - 1e-9)
                key = (step[k][0], int(item))
                best[key] = max(best.get(key, (0, 0.0, 0.0, 0.0, 0.0)), (kind, whole, float(score), question, answer))
        for (i, item), (kind, _, score, question, answer) in best.items():
            yield i, item, score, question, answer, KINDS[kind]


def index(benchmark: DataFrame, least: float = LEAST, least_answer: float = LEAST_ANSWER, shard_postings: int = SHARD_POSTINGS) -> tuple[str, int, int]:
    """Folder of the index, its number of shards (none without items), and the words of the
    longest item."""
    text = F.coalesce("text", F.lit(""))
    items = benchmark.select("item_id", word_hashes(text).alias("words"), word_hashes(F.regexp_extract(text, r"(?s)[.!?]\s+([^.!?]*(?:[.!?](?!\s+\S)[^.!?]*)*)$", 1)).alias("answer")).filter(F.size("words") > 0)
    last = F.when((F.size("answer") >= PART_WORDS) & (F.size("words") - F.size("answer") >= PART_WORDS), F.size("answer")).otherwise(0)
    items = staged(items.select(F.monotonically_increasing_id().alias("_i"), "item_id", "words", (F.size("words") - last).alias("n_question")), "leak-items")
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avg"), F.max(F.size("words")).alias("length"), F.sum(F.size(F.array_distinct("words"))).alias("postings")).first()
    if not facts["n"]:
        return "", 0, 1
    n, avg, length, shards = facts["n"], facts["avg"], facts["length"], -(-facts["postings"] // shard_postings)
    words = items.select("_i", F.explode(F.array_distinct("words")).alias("w"))
    weight = words.groupBy("w").agg(F.log(1 + (F.lit(n) - F.count(F.lit(1)) + 0.5) / (F.count(F.lit(1)) + 0.5)).alias("idf"))
    weighted = words.join(weight, "w").groupBy("_i").agg(F.map_from_entries(F.collect_list(F.struct("w", "idf"))).alias("idf"))  # one item's words
    rows = items.join(weighted, "_i").withColumn("shard", F.pmod(F.xxhash64("_i"), F.lit(shards)).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        idf: dict[int, float] = {}
        for m in part["idf"]:
            idf.update(m)
        made = Index([(i if i is None or i != i else int(i), np.asarray(w, np.int64), int(q)) for i, w, q in zip(part["item_id"], part["words"], part["n_question"], strict=True)], idf, avg, least, least_answer)
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "index": [pickle.dumps(made)]})

    folder = new_folder(benchmark.sparkSession, "leak-index")
    rows.groupBy("shard").applyInPandas(build, "shard int, index binary").write.partitionBy("shard").parquet(folder)
    return folder, shards, length


def _read_shards(folder: str, n: int) -> Iterator[Index]:
    """The shards that hold items, one at a time."""
    from pyarrow import dataset, fs

    store, base = fs.FileSystem.from_uri(folder)
    for k in range(n):
        if store.get_file_info(f"{base}/shard={k}").type != fs.FileType.NotFound:
            for made in dataset.dataset(f"{base}/shard={k}", filesystem=store, format="parquet").to_table(columns=["index"])["index"]:
                yield pickle.loads(made.as_buffer())


def _found(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, least_answer: float = LEAST_ANSWER, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """What leaks, and what covers a question, of every row, with the row's text key in _key."""
    folder, shards, length = index(benchmark, least, least_answer, shard_postings)
    out = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, kind string, _key long"
    if not shards:
        return docs.sparkSession.createDataFrame([], out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = kept_in_worker(folder, lambda: list(_read_shards(folder, 1))) if shards == 1 else None
        for batch in batches:
            ids, keys, words = batch["doc_id"].tolist(), batch["_key"].tolist(), batch["words"].tolist()
            for own in only or _read_shards(folder, shards):
                rows = [(ids[i], own.items[item][0], score, q, a, kind, keys[i]) for i, item, score, q, a, kind in own.leaks(words, length)]
                made = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "kind", "_key"])
                yield made.assign(doc_id=[None if x is None else int(x) for x in made["doc_id"]]).astype({"doc_id": "Int64", "item_id": "Int64", "_key": "int64"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key(F.col("text")).alias("_key"), word_hashes(F.col("text")).alias("words")).mapInPandas(run, out)


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, score (BM25 over what a leak needs at least), question_overlap,
    answer_overlap, kind of every leak, and of every question without its answer."""
    found = _found(docs, benchmark, **how).drop("_key")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc(rank), F.desc("score"), F.desc("question_overlap"), F.desc("answer_overlap")))
    return found.withColumn("_nth", nth).filter("_nth = 1").drop("_nth").withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs less the documents (doc_id and text) that leak an item."""
    gone = staged(_found(docs.select("doc_id", "text"), benchmark, **how).filter("kind <> 'question'").select(F.col("doc_id").alias("_gone"), F.col("_key").alias("_k")).distinct(), "leaks")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (text_key(docs["text"]) == gone["_k"]), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.filter("kind <> 'question'")
