"""Repeated passages of lines against every stretch of lines of every text."""

import random

import pytest

from loomtable.llm import line_dedup


def every_stretch(texts, least):
    """(doc_id, line) of the lines of stretches of two lines and `least` words or more that begin
    at an earlier place as well, less those that lie in the first such stretch."""
    first, gone = {}, set()
    for doc_id in sorted(texts):
        lines = texts[doc_id].split("\n")
        for lo in range(len(lines)):
            for hi in range(lo + 2, len(lines) + 1):
                if sum(len(x.split()) for x in lines[lo:hi]) >= least:
                    known, at = first.setdefault(tuple(lines[lo:hi]), (doc_id, lo))
                    if (known, at) != (doc_id, lo):
                        gone |= {(doc_id, i) for i in range(max(lo, at + hi - lo) if known == doc_id else lo, hi)}
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_every_stretch(spark, seed):
    rng = random.Random(seed)
    lines = ["", " ", "one"] + [" ".join(f"w{k}x{j}" for j in range(rng.choice([3, 10, 20, 30, 60]))) for k in range(14)]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))) for i in range(60)}
    for i in range(60, 90):  # stretches of other texts, put together
        texts[i] = "\n".join(rng.choice(lines) if rng.random() < 0.4 else texts[rng.randrange(i)] for _ in range(3))
    texts[90] = "\n".join([lines[5]] * 9)
    df = spark.createDataFrame(list(texts.items()) + [(3, texts[3])], "doc_id long, text string").repartition(5)
    got = {(r.doc_id, i) for r in line_dedup.runs(line_dedup.line_facts(df)).collect() for i in range(r.at, r.at + r.n_lines)}
    assert got == every_stretch(texts, 50)


def test_pairs_of_several_texts_make_no_passage(spark):
    a, b, c = (" ".join(f"{x}{j}" for j in range(22)) for x in "abc")
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}")]
    schema = "doc_id long, text string"
    assert line_dedup.runs(line_dedup.line_facts(spark.createDataFrame(rows, schema))).count() == 0
    rows.append((4, f"x\n{a}\n{b}\n{c}"))
    got = {(r.doc_id, i) for r in line_dedup.runs(line_dedup.line_facts(spark.createDataFrame(rows, schema))).collect() for i in range(r.at, r.at + r.n_lines)}
    assert got == {(4, 1), (4, 2), (4, 3)}
