"""Base and delta layers against a dict."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtable.session import new_folder
from loomtable.sources import layers

SCHEMA = "id long, v string, n int"


def test_layers_equal_a_dict(spark):
    rng = random.Random(4)
    state = {i: (f"v{i}", i) for i in [None, *range(300)]}
    frame = lambda d: spark.createDataFrame([(k, *x) for k, x in d.items()], SCHEMA)
    folder = new_folder(spark, "layers")
    base = frame(state)
    layers.write_base(base, "id", folder, pack_rows=32)
    shown = lambda: {r.id: (r.v, r.n) for r in layers.read(spark, folder, base.schema, "id").collect()}
    assert shown() == state
    packs = lambda: {r.path for r in layers.current(spark, folder)[1].collect()}
    before = packs()
    folds = []
    for nth in range(3):
        change = {rng.choice([None, *range(nth, 320)]): None if rng.random() < 0.3 else (f"new {nth}", nth) for _ in range(12)}
        rows = [(k, *(x or (None, None)), "delete" if x is None else "upsert") for k, x in change.items()]
        folds.append(layers.write_delta(spark.createDataFrame(rows, f"{SCHEMA}, op string"), "id", folder, base.schema, fold_at=30, pack_rows=32))
        state = {k: x for k, x in (state | change).items() if x is not None}
        assert shown() == state
    assert folds[-1] and not folds[0] and all(r.layer == 0 and r.n <= 32 for r in layers.current(spark, folder)[1].collect())
    assert before & packs()  # packs without a change stay the same files
    with pytest.raises(ValueError, match="repeats"):
        layers.write_base(base.union(base), "id", new_folder(spark, "layers"))
    broken = Path(next(iter(packs())))
    shutil.copy(broken, f"{broken}.kept")
    broken.write_bytes(broken.read_bytes()[:-1] + b"x")
    with pytest.raises(Exception, match="not what the manifest says"):
        shown()


def test_an_empty_base_takes_a_delta(spark):
    folder = new_folder(spark, "layers")
    base = spark.createDataFrame([], SCHEMA)
    layers.write_base(base, "id", folder)
    assert layers.read(spark, folder, base.schema, "id").count() == 0
    layers.write_delta(spark.createDataFrame([(1, "a", 2, "upsert"), (2, None, None, "delete")], f"{SCHEMA}, op string"), "id", folder, base.schema, fold_at=100)
    assert [tuple(r) for r in layers.read(spark, folder, base.schema, "id").select("id", "v", F.col("n")).collect()] == [(1, "a", 2)]
