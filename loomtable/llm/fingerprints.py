r"""Document fingerprints: improbable-feature digests, compared by overlap of Bloom filters.

A feature is a window of 64 bytes of the text's UTF-8. Its entropy, in steps of a thousandth of
the greatest, is ranked by rarity: `rarity` counts the entropies of all windows of all
documents, and the rarer an entropy is, the better its rank (windows under `LEAST`, runs of one
sign or so, never rank). Of every 64 windows in a row the best ranked (leftmost of equals) gets
a point; windows of 16 points or more are selected. Their SHA-1 sets five bits each in a Bloom
filter of 2,048 bits; after 160 unlike features the next filter of the chain begins. A text of
under 512 bytes has few such windows, so all its windows of 8 bytes follow them. A fingerprint is
the chain in base64.

Two filters with a and b bits set share a * b / 2048 by chance and min(a, b) at most; their
overlap is placed between the two, and below `CUTOFF` counts as none. The likeness of two
fingerprints is the mean, weighted by bits, of the best overlap of each filter of the shorter
chain (of equally long ones: both ways). Equal fingerprints have likeness 1.

Entropies are sums over a sliding window in whole numbers, so a window has the same entropy
wherever it stands; all windows of some megabyte of texts are worked out at once, and a long
text goes in overlapping pieces with the same result. What is selected around a byte depends on
189 bytes beside it, so an edited text only needs work from its edit on.

To meet the next document, texts (packed) go through one range partition by doc_id; a task takes
neighbours as they come. The last text of a part and the first of the next part are written with
the results and meet in a join by part number.

Results of the odd cases: a null text is an empty one, with an empty fingerprint (likeness 1 to
an empty one, else 0); a text of under 8 bytes is one feature as it is; of one of 512 bytes or
more without a selected window the one with most points, else the best ranked, stands for it;
rows go by doc_id (null first), then by the text's crc32, so equal rows follow each other; one row alone is
its own next; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

WINDOW, SPAN, POINTS = 64, 64, 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Texts under SHORT bytes have few selected windows, so all their windows of SMALL bytes go in too.
SHORT, SMALL = 512, 8
STEPS, LEAST, CUTOFF = 1000, 100, 0.3
#: Bytes beside a window on which its selection depends: before its first, behind its first.
BEFORE, BEHIND = SPAN - 1, SPAN - 1 + WINDOW - 1
PIECE, CHUNK = 1 << 20, 1 << 17
PLACE_BITS = 21

#: n log2 n of a byte's n occurrences in a window, in whole numbers, and what one more adds.
_N_LOG_N = np.array([0] + [round(n * math.log2(n) * (1 << 16)) for n in range(1, WINDOW + 1)], np.int64)
_ONE_MORE = np.diff(_N_LOG_N)


def entropies(data: np.ndarray) -> np.ndarray:
    """Of every window of data, 0 (one sign) to STEPS (no sign twice)."""
    found = np.empty(max(0, len(data) - WINDOW + 1), np.int16)
    for at in range(0, len(found), CHUNK):
        x = data[at : at + CHUNK + WINDOW - 1]
        before, behind = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
        same = np.empty(len(x), np.bool_)
        for d in range(1, WINDOW):
            eq = np.equal(x[d:], x[:-d], out=same[d:]).view(np.uint8)
            before[d:] += eq
            behind[:-d] += eq
        # A byte that enters has so many like it before it in the window, one that leaves behind it.
        sums = np.cumsum(_ONE_MORE[before])
        sums[WINDOW:] -= np.cumsum(_ONE_MORE[behind[:-WINDOW]])
        found[at : at + CHUNK] = (_N_LOG_N[-1] - sums[WINDOW - 1 :]) * STEPS // _N_LOG_N[-1]
    return found


Piece = tuple[bytes, int, int]


def pieces(text: bytes, begin: int = 0) -> Iterator[tuple[int, Piece]]:
    """A text's windows from begin on, in pieces (bytes, first window, end of windows) with what
    lies beside them; and the byte at which a piece begins."""
    for at in range(begin, max(begin + 1, len(text) - WINDOW + 1), PIECE):
        end = min(at + PIECE, len(text) - WINDOW + 1)
        if end > at:
            lo = max(0, at - BEFORE)
            yield lo, (text[lo : end + BEHIND], at - lo, end - lo)


def _groups(given: Sequence[Piece]) -> Iterator[range]:
    """Runs of pieces of so many bytes that places fit their bits."""
    at = size = 0
    for i, (data, _, _) in enumerate(given):
        if size and size + len(data) >= 1 << PLACE_BITS:
            yield range(at, i)
            at, size = i, 0
        size += len(data)
    if at < len(given):
        yield range(at, len(given))


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of n places those that lie in one of the runs."""
    change = np.zeros(n + 1, np.int32)
    real = ends > starts
    np.add.at(change, starts[real], 1)
    np.add.at(change, ends[real], -1)
    return np.cumsum(change[:n]) > 0


def counted(given: Sequence[Piece]) -> np.ndarray:
    """How often each entropy occurs among the pieces' windows."""
    total = np.zeros(STEPS + 1, np.int64)
    for group in _groups(given):
        data = np.frombuffer(b"".join(given[i][0] for i in group), np.uint8)
        starts = np.cumsum([0] + [len(given[i][0]) for i in group])[:-1]
        found = entropies(data)
        lo, hi = (np.array([given[i][k] for i in group]) for k in (1, 2))
        total += np.bincount(found[_inside(len(found), starts + lo, starts + hi)], minlength=STEPS + 1)
    return total


def ranked(counts: Sequence[int]) -> np.ndarray:
    """By entropy its rank: 0 is the rarest; entropies under LEAST have the rank STEPS + 1."""
    ranks = np.full(STEPS + 1, STEPS + 1, np.int32)
    order = sorted(range(LEAST, STEPS + 1), key=lambda e: (counts[e], e))
    ranks[order] = np.arange(len(order))
    return ranks


def points(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of every window of the texts laid end to end, and the windows' (rank, place)
    as one number."""
    keys = (ranks[entropies(data)].astype(np.int32) << PLACE_BITS) + np.arange(max(0, len(data) - WINDOW + 1), dtype=np.int32)
    best, width = keys, 1
    while width < SPAN and len(best) > width:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < SPAN or not len(best):
        return np.zeros(len(keys), np.int64), keys
    won = best[_inside(len(best), starts, starts + np.maximum(sizes - BEHIND, 0))]
    won = won[won >> PLACE_BITS <= STEPS]
    return np.bincount(won & (1 << PLACE_BITS) - 1, minlength=len(keys)), keys


def selected(given: Sequence[Piece], ranks: np.ndarray) -> list[list[int]]:
    """By piece the places of its selected windows."""
    found: list[list[int]] = [[] for _ in given]
    for group in _groups(given):
        sizes = np.array([len(given[i][0]) for i in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        given_points, _ = points(np.frombuffer(b"".join(given[i][0] for i in group), np.uint8), starts, sizes, ranks)
        places = np.flatnonzero(given_points >= POINTS)
        of = np.searchsorted(ends, places, "right")
        for k, place in zip(of.tolist(), (places - starts[of]).tolist(), strict=True):
            _, lo, hi = given[group[k]]
            if lo <= place < hi:
                found[group[k]].append(place)
    return found


def stand_in(text: bytes, ranks: np.ndarray) -> list[bytes]:
    """The feature of a long text that has no selected window."""
    most = None
    for lo, piece in pieces(text):
        data = np.frombuffer(piece[0], np.uint8)
        got, keys = points(data, np.array([0]), np.array([len(data)]), ranks)
        core = slice(piece[1], piece[2])
        i = int(np.argmax(got[core])) if got[core].any() else int(np.argmin(keys[core]))
        found = (-int(got[core][i]), int(keys[core][i] >> PLACE_BITS), lo + piece[1] + i)
        most = min(most or found, found)
    return [hashlib.sha1(text[most[2] : most[2] + WINDOW]).digest()]


def inserted(text: bytes, digests: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """What goes into a text's filters, given the digests of its selected windows."""
    if len(text) >= SHORT:
        return digests or stand_in(text, ranks)
    n = len(text) - SMALL + 1
    return digests + [hashlib.sha1(text[i : i + SMALL]).digest() for i in range(n if n > 0 else len(text) > 0)]


def features(texts: Sequence[bytes], begins: Sequence[int], ranks: np.ndarray) -> list[list[tuple[int, bytes]]]:
    """By text the (place, SHA-1) of its selected windows from begin on."""
    of, lows, given = [], [], []
    for k, (text, begin) in enumerate(zip(texts, begins, strict=True)):
        for lo, piece in pieces(text, begin):
            of.append(k)
            lows.append(lo)
            given.append(piece)
    found: list[list[tuple[int, bytes]]] = [[] for _ in texts]
    for k, lo, (data, _, _), places in zip(of, lows, given, selected(given, ranks), strict=True):
        found[k] += [(lo + p, hashlib.sha1(data[p : p + WINDOW]).digest()) for p in places]
    return found


def chains(digests: Sequence[Sequence[bytes]]) -> list[list[int]]:
    """By text its Bloom filters, each a number of BITS bits; features count once a text."""
    unlike = [list(dict.fromkeys(d)) for d in digests]
    n_filters = [-(-len(d) // PER_FILTER) for d in unlike]
    base = np.cumsum([0, *n_filters])
    if not base[-1]:
        return [[] for _ in unlike]
    rows = np.concatenate([base[k] + np.arange(len(d)) // PER_FILTER for k, d in enumerate(unlike)])
    columns = np.frombuffer(b"".join(x for d in unlike for x in d), ">u4").reshape(-1, HASHES) % BITS
    bits = np.zeros((base[-1], BITS), np.uint8)
    bits[rows[:, None], columns] = 1
    packed = [int.from_bytes(x.tobytes()) for x in np.packbits(bits, axis=1)]
    return [packed[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


def shown(chain: Sequence[int]) -> str:
    return base64.b64encode(b"".join(x.to_bytes(BITS // 8) for x in chain)).decode()


def read(fingerprint: str) -> list[int]:
    raw = base64.b64decode(fingerprint)
    return [int.from_bytes(raw[i : i + BITS // 8]) for i in range(0, len(raw), BITS // 8)]


def overlap(a: int, b: int) -> float:
    """0 (what chance gives, or under CUTOFF) to 1 (one filter's bits are all in the other)."""
    n, m = a.bit_count(), b.bit_count()
    chance, most = n * m / BITS, min(n, m)
    share = ((a & b).bit_count() - chance) / (most - chance) if most > chance else 1.0
    return share if share >= CUTOFF else 0.0


def likeness(one: Sequence[int], other: Sequence[int]) -> float:
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    way = lambda x, y: sum(a.bit_count() * max(overlap(a, b) for b in y) for a in x) / sum(a.bit_count() for a in x)
    if len(one) == len(other):
        return (way(one, other) + way(other, one)) / 2
    return way(one, other) if len(one) < len(other) else way(other, one)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FOUND = f"{RESULT}, part int, edge string, packed binary"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.string()), ("packed", pa.binary())])


def _marked(texts: Sequence[bytes], ranks: np.ndarray) -> list[tuple[list[tuple[int, bytes]], list[int]]]:
    """By text its features and its chain."""
    found = features(texts, [0] * len(texts), ranks)
    return list(zip(found, chains([inserted(t, [d for _, d in f], ranks) for t, f in zip(texts, found, strict=True)]), strict=True))


def compared(rows: Sequence[tuple[int | None, str]], marks: Sequence[tuple[list, list[int]]], ranks: np.ndarray) -> list[tuple]:
    """Results of all rows but the last, each beside the one that follows it."""
    edited, cuts = [], []
    for (_, text), (_, after) in zip(rows, rows[1:]):
        q = len(text) // 4
        head = text[: len(text) - q].encode("utf-8", "surrogatepass")
        edited.append(head + after[:q].encode("utf-8", "surrogatepass"))
        cuts.append(max(0, len(head) - BEHIND))
    tails = features(edited, cuts, ranks)
    digests = []
    for text, cut, (own, _), tail in zip(edited, cuts, marks, tails, strict=False):
        both = [d for place, d in own if place < cut] + [d for _, d in tail]
        digests.append(inserted(text, both, ranks))
    made = []
    for (doc_id, text), other, new, (_, chain), (_, after) in zip(rows, edited, chains(digests), marks, marks[1:], strict=False):
        made.append((doc_id, len(text), hashlib.sha256(other).hexdigest(), shown(chain), shown(new), likeness(chain, new), likeness(chain, after)))
    return made


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, str]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield doc_id, packed, unpack.decompress(packed).decode("utf-8", "surrogatepass")


def _neighbours(ranks: np.ndarray):
    """A sorted part to the results of all its rows but the last; its first and last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, marks, size, last, first = TaskContext.get().partitionId(), [], [], 0, None, None
        none = (None,) * 6

        def done() -> pa.RecordBatch:
            nonlocal held, marks, size
            marks += _marked([t.encode("utf-8", "surrogatepass") for _, t in held[len(marks) :]], ranks)
            made = [(*r, part, None, None) for r in compared(held, marks, ranks)]
            held, marks, size = held[-1:], marks[-1:], 0
            return _batch(made)

        for doc_id, packed, text in _texts(batches):
            if first is None:
                first = (doc_id, packed)
            last = (doc_id, packed)
            held.append((doc_id, text))
            size += len(text)
            if size >= PIECE and len(held) > 1:
                yield done()
        if len(held) > 1:
            yield done()
        if first is not None:
            yield _batch([(first[0], *none, part, "first", first[1]), (last[0], *none, part, "last", last[1])])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA)


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of entropies, by how often they occur in all windows of all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(STEPS + 1, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    raw = text.as_buffer().to_pybytes()
                    held += [p for _, p in pieces(raw)]
                    size += len(raw)
                    if size >= PIECE:
                        total, held, size = total + counted(held), [], 0
        total += counted(held)
        yield pa.RecordBatch.from_pydict({"entropy": pa.array(range(STEPS + 1), pa.int32()), "n": pa.array(total)})

    counts = [0] * (STEPS + 1)
    for r in docs.select("text").mapInArrow(run, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        counts[r.entropy] = r.n
    return ranked(counts)


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    of docs (doc_id, text). ranks of another corpus make fingerprints comparable with its own."""
    ranks = rarity(docs) if ranks is None else ranks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([packer.compress(t.as_buffer()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(1), batch.column(3)], names=["doc_id", "packed", "crc", "row"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.crc32(text.cast("binary")).alias("crc"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), "crc", "row"]
    parts = rows.mapInArrow(pack, "doc_id long, packed binary, crc long, row long").repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(parts.select("doc_id", "packed").mapInArrow(_neighbours(ranks), FOUND), "fingerprints")
    lasts, firsts = found.filter("edge = 'last'"), found.filter("edge = 'first'")
    by_part = Window.orderBy("part")  # a row for each part
    after = firsts.select("part").select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("next"))
    meet = lasts.select("part", "doc_id", "packed").join(after, "part").join(firsts.select(F.col("part").alias("next"), F.col("packed").alias("next_packed")), "next")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        plain = lambda x: unpack.decompress(x).decode("utf-8", "surrogatepass")
        for batch in batches:
            for doc_id, packed, other in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = [(doc_id, plain(packed)), (None, plain(other))]
                made = compared(rows, _marked([t.encode("utf-8", "surrogatepass") for _, t in rows], ranks), ranks)
                yield _batch([(*r, None, None, None) for r in made])

    names = [x.split()[0] for x in RESULT.split(", ")]
    at_edges = meet.select("doc_id", "packed", "next_packed").mapInArrow(edges, FOUND).select(*names)
    return found.filter("edge IS NULL").select(*names).union(at_edges)


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
