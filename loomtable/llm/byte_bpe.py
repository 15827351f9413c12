r"""Byte-level BPE: encoding by ranks in two tiers, and decoding.

A text is cut into pre-tokens by the pattern, and each is encoded alone. Tier one is a
minimal perfect hash over the vocabulary's byte strings: a pre-token that is a token
itself has its id after two hashes and one comparison. Tier two takes the rest: its bytes
form a linked list, a heap holds the pairs of neighbours that the vocabulary knows, and the
pair of the lowest rank (the leftmost of equals) is joined until none is left.

Pre-tokens repeat, so every Python worker keeps the ids of pieces it has met, up to
`KEPT` of them. A piece is a stretch between single spaces, which no pre-token crosses;
texts in which white space stands beside white space are cut by the pattern as a whole.

The vocabulary is broadcast: its size is fixed, not the corpus's. Each text is worked on
alone, without a shuffle.

Results of the odd cases: a null text counts as empty: no ids, and the digests of no
bytes. Repeated rows give equal rows; other columns pass through, those named like a
result are replaced. Special tokens are never made: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, table

KEPT = 400_000


class PerfectHash:
    """A minimal perfect hash: n keys to 0..n-1 by one displacement for each bucket of
    about two keys. get() is the value of a key of the set, None for any other."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.n_buckets = max(1, n // 2)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[(h >> 96) % self.n_buckets].append(i)
        self.shift = array("q", bytes(8 * self.n_buckets))
        self.keys: list[bytes] = [b""] * n
        self.values = array("q", bytes(8 * n))
        taken, free = bytearray(n), 0
        for b in sorted(range(self.n_buckets), key=lambda b: (-len(buckets[b]), b)):
            if len(buckets[b]) == 1:  # a lone key goes straight to the next free slot
                free = taken.find(0, free)
                s, i = free, buckets[b][0]
                self.shift[b] = -1 - s
                taken[s], self.keys[s], self.values[s] = 1, keys[i], values[i]
                continue
            d = 0
            while True:
                slots = {self._slot(hashes[i], d) for i in buckets[b]}
                if len(slots) == len(buckets[b]) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i in buckets[b]:
                s = self._slot(hashes[i], d)
                taken[s], self.keys[s], self.values[s] = 1, keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        x = ((h & 0xFFFFFFFFFFFFFFFF) + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_128_intdigest(key)
        s = self._slot(h, self.shift[(h >> 96) % self.n_buckets])
        return self.values[s] if self.keys[s] == key else None


class Bpe:
    """Encodes and decodes by ranks (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash | None = None):
        self.ranks = ranks
        self.hash = whole or PerfectHash(list(ranks), list(ranks.values()))
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.two_spaces = regex.compile(r"\s\s")
        self.pieces: dict[str, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of a pre-token that is no token: the heap over linked bytes."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once joined to another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two parts has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def of_pre_token(self, token: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found = self.pre_tokens.get(token)
        if found is None:
            raw = token.encode("utf-8", "replace")
            whole = self.hash.get(raw)
            found = np.array(self.merge(raw) if whole is None else [whole], "<u4").tobytes()
            if len(self.pre_tokens) >= KEPT:
                self.pre_tokens.clear()
            self.pre_tokens[token] = found
        return found

    def of_piece(self, piece: str) -> bytes:
        found = b"".join(map(self.of_pre_token, self.pattern.findall(piece)))
        if len(piece) < 64:
            self.pieces[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.two_spaces.search(text):
            return b"".join(map(self.of_pre_token, self.pattern.findall(text)))
        if len(self.pieces) >= KEPT:
            self.pieces.clear()
        get, make = self.pieces.get, self.of_piece
        out: list[bytes] = []
        for at, line in enumerate(text.split("\n")):
            if at:
                out.append(get("\n") or make("\n"))
            first, *rest = line.split(" ")
            if first:
                out.append(get(first) or make(first))
            out += [get(p) or make(p) for p in map(" ".__add__, rest)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs without the text, with n_tokens, ids (binary, little-endian unsigned 32-bit, if
    keep_ids), ids_sha256, and decoded_sha256 of the bytes that the ids decode to."""
    known = docs.sparkSession.sparkContext.broadcast((ranks, pattern, PerfectHash(list(ranks), list(ranks.values()))))
    key = xxhash.xxh64_intdigest(pattern.encode() + b"".join(b"%d %b\n" % (i, k) for k, i in ranks.items()))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = kept_in_worker(key, lambda: Bpe(*known.value))  # with the pieces that earlier tasks met
        for batch in batches:
            rows = []
            for x in batch:
                ids = bpe.encode(x or "")
                rows.append((len(ids) // 4, ids if keep_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    made = F.pandas_udf(run, "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    names = ["n_tokens", *["ids"] * keep_ids, "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in (text, "n_tokens", "ids", "ids_sha256", "decoded_sha256")]
    return docs.select(*kept, made(docs[text]).alias("_e")).select(*kept, *[F.col(f"_e.{c}").alias(c) for c in names])


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """rows with text: what the ids decode to, bytes that are no UTF-8 replaced."""
    known = rows.sparkSession.sparkContext.broadcast({i: k for k, i in ranks.items()})

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = known.value
        for batch in batches:
            yield pd.Series([b"".join(map(bytes_of.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in batch], dtype=object)

    return rows.withColumn("text", run(rows[ids]))


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_ids=False)
