"""The Merkle manifest against trees built in plain Python, whole and from unaligned runs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomtable.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h(*row[i : i + fanout]) for i in range(0, len(row), fanout)])
    return levels


def way(levels, at, fanout):
    """(left, right) by level of a leaf."""
    for row in levels[:-1]:
        lo = at // fanout * fanout
        yield "".join(row[lo:at]), "".join(row[at + 1 : lo + fanout])
        at //= fanout


def brute(rows, fanout, forged=lambda r: False):
    """Sorted (id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: h(*(field(v if k != 3 or v is None else v + more) for k, v in enumerate(r)))
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault("" if r[2] is None else f"={r[2]}", []).append(r)
    trees = {g: tree([leaf(r) for r in groups[g]], fanout) for g in sorted(groups, key=str.encode)}
    crown = tree([t[-1][0] for t in trees.values()], fanout)
    out = []
    for k, (g, t) in enumerate(trees.items()):
        for i, r in enumerate(groups[g]):
            steps = [*way(t, i, fanout), *way(crown, k, fanout)]
            node = leaf(r, 1 if forged(r) else 0)
            for left, right in steps:
                node = h(left, node, right)
            out.append((str(r[0]), t[0][i], t[-1][0], crown[-1][0], h(*(x for s in steps for x in s)), node))
    return sorted(out)


def got(df):
    return sorted((str(r.id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in df.collect())


@pytest.mark.parametrize("fanout,block,band_nodes,n", [(2, 3, 4, 90), (3, 5, 9, 140), (2, 64, 1024, 33), (4, 2, 16, 70)])
def test_proofs_equal_plain_trees(spark, fanout, block, band_nodes, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "s", "ü"]), rng.choice([None, "", "de", "en", "en", "en", "zh"]), rng.choice([None, 5, 10**12]), rng.choice([None, "", "text 🙂 " * rng.randrange(5)])) for _ in range(n)]
    rows += rows[:7] + [(3, None, "only", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "_g": F.lit("mine"), "id": F.lit(2)}).repartition(5)
    odd = lambda r: r[3] is not None and (r[0] or 0) % 3 == 0 and r[0] is not None
    forge = F.coalesce((F.col("doc_id") % 3 == 0) & F.col("n_chars").isNotNull(), F.lit(False))
    df = merkle.proofs(docs, forged={"n_chars": F.col("n_chars") + 1}, forge=forge, fanout=fanout, block=block, band_nodes=band_nodes)
    assert got(df) == brute(rows, fanout, odd)


def test_one_row_none_and_long_text(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.proofs(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a", "en", 3, "x" * 2_000_000)]
    assert got(merkle.proofs(spark.createDataFrame(rows, schema))) == brute(rows, 2)


def test_steps_fold_to_the_root_and_a_change_shows(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for r in merkle.proofs(docs, block=7, with_steps=True).collect():
        steps = [(bytes(s["left"]), bytes(s["right"])) for s in r.steps]
        assert merkle.folded(bytes.fromhex(r.leaf), steps).hex() == r.root == r.folded_root
        assert merkle.folded(bytes.fromhex(h("other")), steps).hex() != r.root


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_mountains_complete_what_they_hold(fanout):
    rng = random.Random(fanout)
    for _ in range(60):
        n = rng.randrange(1, 60)
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        whole = tree([x.hex() for x in leaves], fanout)
        a = rng.randrange(n)
        b = rng.randrange(a + 1, n + 1)
        first, nodes = merkle.mountains(a, leaves[a:b], n, fanout)
        for level, (lo, row) in enumerate(zip(first, nodes, strict=True)):
            span = fanout**level
            want = [i for i in range(len(whole[level])) if i * span >= a and min((i + 1) * span, n) <= b]
            assert [lo + i for i in range(len(row))] == want and [x.hex() for x in row] == [whole[level][i] for i in want]
