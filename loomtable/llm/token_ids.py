r"""Token ids as binary files: frequency-ranked, in byte-aligned codes of variable length.

Texts are encoded, and every id is replaced by its rank among all ids of the corpus by
count (the commonest is 0; equal counts by id), so most numbers fit one byte. A file of one
range of doc_ids holds, little-endian:

    magic LOOMIDS1, n_docs u64, n_ids u64, n_ranks u32, 3 reserved u32
    ranks    u32 * n_ranks: the id of each rank
    docs     (doc_id i64, known u8, n_tokens u64) * n_docs, ascending doc_id
    control  a byte for four numbers, two bits each: its length less one
    data     the numbers, one to four bytes each

Control bytes stand apart from the data, so a reader knows the place of every number from a
table lookup of the control bytes and one cumulative sum; numpy does both for a whole file.

Work runs in three steps, each a written table: encode (a row a document), count (a sum by
id), and write: a range partition by doc_id, each sorted and written by one task under a
temporary name. Only files that a finished task reports are renamed; the report is the
manifest. Files are read back by one task each. A partition's ids must fit a task's memory:
`FILE_BYTES` of ids at most are buffered before the next file begins.

Folders are reached by pyarrow's file systems from the URI of the shared folder, so they
may be on any store that pyarrow opens.

Results of the odd cases: a null text is an empty one and has the end id alone; documents
with equal doc_id follow each other by their ids; a null doc_id comes first; an
empty table has no files and no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_in_worker, new_folder, staged, table

MAGIC, HEAD, DOC = b"LOOMIDS1", struct.Struct("<8sQQI3I"), np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<u8")])
FILE_BYTES = 16 << 20
KEPT = 400_000  # pre-tokens and their ids that a Python worker keeps
CHUNK = 2_000_000  # signs of plain texts that are cut at once, or one text
COUNTED = 4 << 20  # bytes of ids that are counted at once, or one document

#: Finds a sign outside the plain ones: printable ASCII with tab and line ends, Latin letters
#: and signs below U+0250 (all in composed form), dashes, quotation marks and their like.
UNPLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f\u2010-\u2027\u2030-\u205e\u20ac]").search
#: The printable sign that byte-level pre-tokenizers write for each byte.
UNPRINTED = [*range(33), *range(127, 161), 173]
BYTE_SIGNS = [chr(256 + UNPRINTED.index(b) if b in UNPRINTED else b) for b in range(256)]

#: The one pattern of pre-tokens that `WordEncoder` cuts by itself, in lower-cased plain text.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, OTHER = range(4)

#: By control byte: the lengths of its four numbers.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    x = numbers.astype("<u4")
    length = 1 + (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    codes = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    codes[: len(x)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    used = np.arange(4)[None, :] < length[:, None]
    return control.tobytes(), x.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        longer = length > k
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def to_file(docs: list[tuple[int, int, int]], numbers: np.ndarray, ids_of: np.ndarray) -> bytes:
    """docs: (doc_id, known, n_tokens); numbers: their ids as ranks."""
    control, data = pack(numbers)
    return HEAD.pack(MAGIC, len(docs), len(numbers), len(ids_of), 0, 0, 0) + ids_of.tobytes() + np.array(docs, DOC).tobytes() + control + data


def of_file(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """docs and ids of a file."""
    magic, n_docs, n_ids, n_ranks, *_ = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("this file holds no token ids")
    at = HEAD.size
    ids_of = np.frombuffer(raw, "<u4", n_ranks, at)
    docs = np.frombuffer(raw, DOC, n_docs, at := at + 4 * n_ranks)
    control = raw[(at := at + DOC.itemsize * n_docs) : (at := at + -(-n_ids // 4))]
    return docs, ids_of[unpack(control, raw[at:], n_ids)].astype("<u4")


def kinds() -> np.ndarray:
    """SPACE, LETTER, DIGIT or OTHER by code point below 65536, as `CUT` tells them."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    found = np.full(1 << 16, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}")):
        found[[ord(x) for x in regex.findall(pattern, every)]] = kind
    return found


class WordEncoder:
    """Texts by the parts of the tokenizers library, each pre-token through its model once.

    Of texts in plain signs (`UNPLAIN` finds none other), where lower case, composed forms and
    the classes of the tokenizer's own pattern are the same in Python and in the library, the
    pre-tokens are found with numpy, for many texts at once: one begins where the kind of sign
    changes, at every digit, and behind a contraction. Each different one of a chunk is looked
    up once. Other texts, those with a special token in them, and all of a tokenizer of another
    make, are cut at spaces and each stretch goes to the library whole: neither pre-tokens nor
    special tokens hold white space.

    Of the ids kept from earlier texts, `KEPT` entries stay at most."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.pack = {"<u2": "H", "<u4": "I"}[self.code]
        with open(path) as f:
            made = json.load(f)
        self.special = [t["content"] for t in made["added_tokens"]]
        self.kinds = kinds() if self._cuts_plain(made) else None
        self.pieces, self.stretches = Kept(self._piece), Kept(self._stretch)

    @staticmethod
    def _cuts_plain(made: dict) -> bool:
        """Whether the tokenizer's steps are of the make that plain texts allow."""
        normal = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        split, *rest = (made["pre_tokenizer"] or {}).get("pretokenizers", [None])
        fits = normal == ["NFC", "Replace", "Lowercase"] and made["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and made["normalizer"]["normalizers"][1]["content"] == " "
        fits = fits and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and [r["type"] for r in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        return fits and split["pattern"] == {"Regex": CUT} and not made["post_processor"]

    def _piece(self, piece: bytes) -> bytes:
        signs = piece.decode("utf-16-le")
        if not signs.isascii():  # plain ASCII signs other than white space stand for themselves
            signs = "".join(map(BYTE_SIGNS.__getitem__, signs.encode()))
        ids = [t.id for t in self.model.tokenize(signs)]
        return struct.pack(f"<{len(ids)}{self.pack}", *ids)

    def _stretch(self, stretch: str) -> bytes:
        ids = self.tokenizer.encode(stretch, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.pack}", *ids)

    def _starts(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a pre-token begins, and what is not white space. The first sign and the last
        two are white space."""
        kind = self.kinds[signs]
        inside = kind != SPACE
        start = kind == DIGIT
        start[1:] |= kind[1:] != kind[:-1]
        start &= inside
        at = np.flatnonzero((signs == ord("'")) & start)  # an apostrophe within a run of other signs begins none
        one, two = signs[at + 1], signs[at + 2]
        double = np.isin(one.astype(np.uint32) << 16 | two, [ord(x) << 16 | ord(y) for x, y in ("re", "ve", "ll")])
        length = np.where(np.isin(one, [ord(x) for x in "stmd"]), 2, np.where(double, 3, 0))
        at, length = at[length > 0], length[length > 0]
        start[at + 1] = False
        start[at + length] = inside[at + length]
        return start, inside

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each of the plain texts."""
        low = [t.lower() for t in texts]
        signs = np.frombuffer("\n".join(["", *low, "", ""]).encode("utf-16-le"), "<u2")
        start, inside = self._starts(signs)
        ends = np.cumsum([len(t) + 1 for t in low])
        ends = np.cumsum(np.add.reduceat(start, np.concatenate([[0], ends[:-1]]), dtype=np.int64))  # pre-tokens up to each text's end
        used = signs[inside]
        at = np.append(np.flatnonzero(start[inside]), len(used)) * used.itemsize
        if not len(used):
            return [b""] * len(texts)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(used)]).dictionary_encode()
        each = list(map(self.pieces.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)))
        _, at, ids = pa.array(each, pa.large_binary()).take(pieces.indices).buffers()
        ends = np.frombuffer(at, np.int64)[ends].tolist()
        ids = memoryview(ids or b"")  # no buffer if no pre-token has ids
        return [bytes(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned integers of `code`."""
        out, held, size = [b""] * len(texts), [], 0

        def flush() -> None:
            nonlocal held, size
            for k, ids in zip(held, self._plain([texts[k] for k in held]), strict=True):
                out[k] = ids
            held, size = [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            if self.kinds is None or UNPLAIN(text) or any(t in text for t in self.special):
                out[k] = b"".join(map(self.stretches.__getitem__, text.replace("\n", " ").split(" ")))
                continue
            if held and size + len(text) > CHUNK:
                flush()
            held.append(k)
            size += len(text)
        if held:
            flush()
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]


class Kept(dict):
    """What make gave by its argument. Of KEPT entries at most, half are the latest ones asked
    for, half those before; what is asked for again becomes a late one."""

    def __init__(self, make: Callable[[str | bytes], bytes]):
        self.make, self.before = make, {}

    def __missing__(self, key: str | bytes) -> bytes:
        if len(self) >= KEPT // 2:
            self.before = dict(self)
            self.clear()
        made = self.before.get(key)
        self[key] = made = self.make(key) if made is None else made
        return made


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, ids: a row for each row of docs (doc_id, text). ids are 16-bit integers if the
    vocabulary allows, else 32-bit ones, as `id_code` of the tokenizer says."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = kept_in_worker(tokenizer_path, lambda: WordEncoder(tokenizer_path))
        end = struct.pack(f"<{encoder.pack}", end_id)
        for batch in batches:
            yield pd.Series([ids + end for ids in encoder.encode_all(batch.to_list())], dtype=object)

    return docs.select("doc_id", run(docs["text"]).alias("ids"))


def id_code(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def counts(rows: DataFrame, code: str = "<u4") -> DataFrame:
    """id, n over all rows; every task sums its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        held: list[bytes] = []
        size = 0

        def add() -> None:
            nonlocal total, held, size
            found = np.bincount(np.frombuffer(b"".join(held), code), minlength=len(total))
            found[: len(total)] += total
            total, held, size = found, [], 0

        for batch in batches:
            for ids in batch["ids"]:
                held.append(ids)
                size += len(ids)
                if size >= COUNTED:
                    add()
        add()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    return rows.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(rows: DataFrame, folder: str, n_files: int, code: str = "<u4") -> DataFrame:
    """Files of rows (doc_id, ids as integers of code) in folder; the manifest: file, first (place of the file
    in doc_id order), n_docs, n_ids, n_bytes."""
    ranked = [r["id"] for r in counts(rows, code).orderBy(F.desc("n"), "id").select("id").collect()]  # the vocabulary at most
    known = rows.sparkSession.sparkContext.broadcast(np.array(ranked, "<u4"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids_of, width = known.value, np.dtype(code).itemsize
        rank_of = np.zeros(int(ids_of.max()) + 1 if len(ids_of) else 1, np.uint32)
        rank_of[ids_of] = np.arange(len(ids_of), dtype=np.uint32)
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        docs: list[tuple[int, int, int]] = []
        held: list[bytes] = []
        size, made = 0, []

        def close() -> None:
            nonlocal docs, held, size
            numbers = rank_of[np.frombuffer(b"".join(held), code)]
            raw = to_file(docs, numbers, ids_of)
            name = f"{base}/_tmp-{part:06d}-{len(made):04d}-{attempt}"
            with store.open_output_stream(name) as out:
                out.write(raw)
            made.append((name, f"{base}/ids-{part:06d}-{len(made):04d}.bin", part, len(made), len(docs), len(numbers), len(raw)))
            docs, held, size = [], [], 0

        for batch in batches:
            for doc_id, is_known, ids in zip(batch["doc_id"], batch["known"], batch["ids"], strict=True):
                docs.append((int(doc_id), int(is_known), len(ids) // width))
                held.append(ids)
                size += len(ids)
                if size >= FILE_BYTES:
                    close()
        if docs:
            close()
        yield pd.DataFrame(made, columns=["temporary", "file", "part", "roll", "n_docs", "n_ids", "n_bytes"])

    placed = rows.withColumns({"known": F.col("doc_id").isNotNull().cast("int"), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    placed = placed.repartitionByRange(n_files, "known", "doc_id").sortWithinPartitions("known", "doc_id", "ids")
    made = staged(placed.select("doc_id", "known", "ids").mapInPandas(run, "temporary string, file string, part int, roll int, n_docs long, n_ids long, n_bytes long"), "ids-manifest")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        store, _ = _store(folder)
        for batch in batches:
            for a, b in zip(batch["temporary"], batch["file"], strict=True):
                if store.get_file_info(a).type != FileType.NotFound:  # else an earlier attempt has renamed it
                    store.move(a, b)
            yield batch

    return staged(made.mapInPandas(commit, made.schema).drop("temporary"), "ids-committed")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document in the files."""
    from pyspark.sql import Window

    # A row for each file: the ids of all files before it. Files are few: FILE_BYTES each.
    order = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(folder)
        for batch in batches:
            for name, before in zip(batch["file"], batch["before"], strict=True):
                with store.open_input_stream(name) as f:
                    raw = f.read()
                docs, ids = of_file(raw)
                ends = np.cumsum(docs["n"]).astype(np.int64)
                starts = ends - docs["n"].astype(np.int64)
                for lo in range(0, len(docs), 1000):
                    some = slice(lo, lo + 1000)
                    each = [ids[a:b].tobytes() for a, b in zip(starts[some], ends[some], strict=True)]
                    yield pd.DataFrame({
                        "doc_id": pd.Series(np.where(docs["known"][some] == 1, docs["doc_id"][some], 0), dtype="Int64").mask(docs["known"][some] == 0),
                        "start": starts[some] + before, "n_tokens": docs["n"][some].astype(np.int64), "ids_crc32": [zlib.crc32(x) for x in each], "ids": each,
                    })

    return files.repartition(max(1, files.count()), "file").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, n_files: int | None = None) -> DataFrame:
    """docs (doc_id, text) encoded, written and read back."""
    spark: SparkSession = docs.sparkSession
    rows = staged(encoded(docs, tokenizer_path, end_id), "ids-encoded")
    folder = new_folder(spark, "token-ids")
    manifest = write(rows, folder, n_files or int(spark.conf.get("spark.sql.shuffle.partitions")), id_code(tokenizer_path))
    return read(manifest, folder)


def op2_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")
