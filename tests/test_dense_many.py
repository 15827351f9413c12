"""Many query vectors at once against plain Python."""

import math
import random

import pytest

from loomtable.operators import frames, retrieval


def cosine(a, b):
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / norms, 9) + 0.0 if norms else 0.0


@pytest.mark.parametrize("query_bytes", [100, 1 << 20])
def test_dense_many_equals_every_pair(spark, query_bytes):
    rng = random.Random(1)
    vector = lambda: [float(rng.randrange(-3, 4)) for _ in range(rng.choice([4, 4, 6]))]
    vectors = {i: rng.choice([None, []]) if i % 17 == 3 else vector() for i in range(120)} | {200: [0.0] * 4}
    queries = {i: vector() for i in range(9)} | {50: None, 51: [0.0] * 4}
    v = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(list(queries.items()), "query_id long, embedding array<float>")
    for least in (-1.0, 0.3):
        want = []
        for i, a in queries.items():
            if a is not None:
                every = sorted((-cosine(a, b), k) for k, b in vectors.items() if b is not None and cosine(a, b) >= least)
                want += [(i, k, -s, nth) for nth, (s, k) in enumerate(every[:5], 1)]
        got = [(r.query_id, r.vec_id, r.score, r.rank) for r in retrieval.dense_many(v, q, 5, least, query_bytes).collect()]
        assert sorted(got) == [(i, k, pytest.approx(s, abs=2e-9), n) for i, k, s, n in sorted(want)]
    assert retrieval.dense_many(v.limit(0), q, 5).count() == retrieval.dense_many(v, q.limit(0), 5).count() == 0


def test_frames_refuse_and_take_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (2, 3), (None, 4)], "o int, v int")
    with pytest.raises(ValueError):
        frames.groups_frame(df, [], ["o"], "v", 1, 1, "rows")
    got = {(r.o, r.v): (r["sum"], r["count"], r["avg"]) for r in frames.groups_frame(df, [], ["o"], "v", 0, 0, "current row").collect()}
    assert got == {(1, None): (2, 1, 2.0), (1, 2): (None, 0, None), (2, 3): (None, 0, None), (None, 4): (None, 0, None)}


def test_dense_many_over_many_blocks_asks_the_driver_for_no_vector(spark, monkeypatch):
    rng = random.Random(2)
    vectors = {i: [float(rng.randrange(-2, 3)) for _ in range(4)] for i in range(150)}
    v = spark.createDataFrame(list(vectors.items()), "vec_id int, embedding array<float>")
    q = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(type(v), "toLocalIterator", lambda *_: pytest.fail("vectors came to the driver"))
    want = []
    for i in range(0, 150, 20):
        every = sorted((-cosine(vectors[i], b), k) for k, b in vectors.items() if cosine(vectors[i], b) >= 0.2)
        want += [(i, k, pytest.approx(-s, abs=2e-9), nth) for nth, (s, k) in enumerate(every[:5], 1)]
    got = retrieval.dense_many(v, q, 5, 0.2, 64, block_bytes=200)
    assert sorted((r.query_id, r.vec_id, r.score, r.rank) for r in got.collect()) == sorted(want, key=lambda r: r[:2])


def test_frames_of_few_sorts_equal_every_row(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, -2, 0, 5])) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, p int, o int, v int").repartition(3)
    framed = {"a": (1, 1, "no others"), "b": (1, 0, "current row"), "c": (2, 1, "group"), "d": (None, 1, "ties"), "e": (-1, 2, "group"), "f": (0, None, "ties")}
    made = frames.groups_frames(df, ["p"], ["-o"], "v", framed)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "- Window [" in x]) == 1
    for r in made.collect():
        numbers = sorted({-9 if x[2] is None else x[2] for x in rows if x[1] == r.p}, reverse=True)  # nulls last
        at = {i: numbers.index(-9 if o is None else o) for i, p, o, _ in rows if p == r.p}
        for name, (before, after, exclude) in framed.items():
            taken = []
            for i, v in ((x[0], x[3]) for x in rows if x[1] == r.p):
                step = at[i] - at[r.i]
                inside = (before is None or step >= -before) and (after is None or step <= after)
                out = {"no others": False, "current row": i == r.i, "group": step == 0, "ties": step == 0 and i != r.i}[exclude]
                taken += [v] if inside and not out and v is not None else []
            assert (r[f"{name}count"], r[f"{name}sum"]) == (len(taken), sum(taken) if taken else None), (name, r)
