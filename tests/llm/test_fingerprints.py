"""Document fingerprints against the same digests worked out window by window in plain Python."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtable.llm import fingerprints as f


def entropy(window):
    n_log_n = lambda n: round(n * math.log2(n) * 65536)
    return (n_log_n(64) - sum(n_log_n(n) for n in Counter(window).values())) * 1000 // n_log_n(64)


def plain_windows(raw):
    return [raw[i : i + 64] for i in range(len(raw) - 63)]


def plain_ranks(raws):
    counts = Counter(entropy(w) for raw in raws for w in plain_windows(raw))
    return {e: k for k, e in enumerate(sorted(range(100, 1001), key=lambda e: (counts[e], e)))}


def plain_chain(raw, ranks):
    windows = plain_windows(raw)
    rank = [ranks.get(entropy(w), 1001) for w in windows]
    points = Counter()
    for j in range(len(windows) - 63):
        best = min(range(j, j + 64), key=lambda i: (rank[i], i))
        if rank[best] < 1001:
            points[best] += 1
    chosen = [windows[i] for i in sorted(points) if points[i] >= 16]
    if len(raw) < 512:
        chosen += [raw[i : i + 8] for i in range(len(raw) - 7)] or ([raw] if raw else [])
    elif not chosen:
        chosen = [windows[min(range(len(windows)), key=lambda i: (-points[i], rank[i], i))]]
    filters = []
    for nth, w in enumerate(dict.fromkeys(chosen)):
        if nth % 160 == 0:
            filters.append(set())
        digest = hashlib.sha1(w).digest()
        filters[-1] |= {int.from_bytes(digest[k : k + 4]) % 2048 for k in range(0, 20, 4)}
    return filters


def plain_shown(filters):
    return base64.b64encode(b"".join(sum(1 << (2047 - b) for b in bits).to_bytes(256) for bits in filters)).decode()


def plain_likeness(one, other):
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0

    def share(a, b):
        chance, most = len(a) * len(b) / 2048, min(len(a), len(b))
        x = (len(a & b) - chance) / (most - chance)
        return x if x >= 0.3 else 0.0

    way = lambda x, y: sum(len(a) * max(share(a, b) for b in y) for a in x) / sum(map(len, x))
    if len(one) == len(other):
        return (way(one, other) + way(other, one)) / 2
    return way(min(one, other, key=len), max(one, other, key=len))


def plain(rows):
    """Sorted results of rows (doc_id, text)."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    ranks = plain_ranks([t.encode() for _, t in rows])
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = (plain_chain(x.encode(), ranks) for x in (text, edited, after))
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_shown(a), plain_shown(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def made(rng, n):
    words = ["".join(rng.choice("etaoinshrdluäß🙂") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_query_equals_window_by_window(spark):
    rng = random.Random(3)
    long = made(rng, 2500)
    rows = [(i, made(rng, rng.choice([0, 1, 2, 9, 40, 90, 300]))) for i in range(24)]
    rows += [(30, long), (31, long), (32, long[: len(long) // 2]), (33, None), (34, ""), (35, "abc"), (36, "a" * 900), (37, "ab" * 700), (5, rows[5][1]), (None, "no id " * 30), (None, rows[6][1]), (40, "x" * 63), (41, "y" * 64), (42, made(rng, 20)[:127])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit(1), "part": F.lit(2), "edge": F.lit("mine"), "row": F.lit(3)}).repartition(3)
    out = f.fingerprints(docs)
    assert got(out) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone " * 200)], [(None, None)]])
def test_few_rows(spark, rows):
    assert got(f.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_pieces_and_groups_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = [made(rng, n).encode() for n in (1500, 30, 700, 5, 0, 900)]
    ranks = f.ranked(f.counted([p for t in texts for _, p in f.pieces(t)]))
    whole = f._marked(texts, ranks)
    monkeypatch.setattr(f, "PIECE", 500)
    monkeypatch.setattr(f, "CHUNK", 300)
    assert list(f.ranked(f.counted([p for t in texts for _, p in f.pieces(t)]))) == list(ranks)
    assert f._marked(texts, ranks) == whole
    monkeypatch.setattr(f, "PLACE_BITS", 13)
    assert f._marked(texts, ranks) == whole


def test_likeness_tells_texts_apart(spark):
    rng = random.Random(9)
    texts = [made(rng, 400) for _ in range(12)]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, t if i % 2 else t[:-40] + made(rng, 8)) for i, t in enumerate(texts)]
    for r in f.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 0.5 < r.near_edited <= 1
        assert r.near_next > 0.85 if r.doc_id % 2 == 0 else r.near_next < 0.3
    ranks = np.arange(1001, dtype=np.int32)
    a, b = f._marked([t.encode() for t in texts[:2]], ranks)
    assert f.read(f.shown(a[1])) == a[1] and f.likeness(a[1], a[1]) == 1 and f.likeness(a[1], b[1]) < 0.3
