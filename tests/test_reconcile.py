"""Hash trees, decisions between two stored states, compaction, and templates, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomtable.operators import reconcile
from loomtable.operators.templates import Sheet, reconciled
from loomtable.session import new_folder
from loomtable.sources import compaction, trees

SCHEMA = "sheet string, id string, v string"


def stored(spark, rows):
    folder = new_folder(spark, "state")
    df = spark.createDataFrame(rows, SCHEMA)
    trees.store(df, ["sheet", "id"], folder)
    return folder, df.schema


def test_differing_rows_equal_a_dict(spark):
    rng = random.Random(7)
    a = {(s, str(i)): f"v{i}" for s in ("x", "y") for i in range(400)} | {("x", None): "n", (None, "1"): None}
    b = {k: v for k, v in a.items() if rng.random() > 0.01} | {("y", "7"): "other", ("z", "new"): "", ("x", None): None}
    (fa, schema), (fb, _), (fc, _) = (stored(spark, [(*k, v) for k, v in d.items()]) for d in (a, b, dict(reversed(a.items()))))
    want = {(k, "only_a" if k not in b else "only_b" if k not in a else "other") for k in a.keys() | b.keys() if k not in a or k not in b or a[k] != b[k]}
    got = {((r.sheet, r.id), r.kind) for r in reconcile.row_kinds(spark, fa, fb, schema, ["sheet", "id"]).collect()}
    assert got == want
    leaves = trees.differing(spark, fa, fb)
    assert 0 < leaves.count() <= len(want)
    assert trees.root(spark, fa) == trees.root(spark, fc) and trees.differing(spark, fa, fc).count() == 0
    assert reconcile.row_kinds(spark, fa, fc, schema, ["sheet", "id"]).count() == 0


def test_repeats_nulls_and_empty_states(spark):
    (one, schema), (two, _), (none, _), (text, _) = (stored(spark, r) for r in ([("s", "1", None)], [("s", "1", None)] * 2, [], [("s", "1", "")]))
    kinds = lambda a, b: [tuple(r) for r in reconcile.row_kinds(spark, a, b, schema, ["sheet", "id"]).collect()]
    assert kinds(one, two) == kinds(one, text) == [("s", "1", "other")]
    assert kinds(none, one) == [("s", "1", "only_b")] and kinds(none, none) == [] and trees.root(spark, none) == ""
    assert trees.facts(spark, two).first().n_unstable == 1 and trees.facts(spark, none).first().n == 0
    with pytest.raises(ValueError, match="other cells"):
        reconcile.merged(spark, one, text, schema, ["sheet", "id"])


def test_decisions_from_states_and_logs(spark):
    key, base = ["sheet", "id"], [("s", str(i), "v") for i in range(50)]
    log = spark.createDataFrame([("s", 1, "1:a", None, 4), ("s", 2, "2:b", "1:a", 6)], "sheet string, seq int, revision string, parent string, floor int")
    broken = log.withColumn("parent", F.when(F.col("seq") == 2, "9:z"))
    changed = lambda floor: spark.createDataFrame([("s", floor)], "sheet string, floor int")
    a, schema = stored(spark, base)
    mark = trees.root(spark, a)
    state = lambda rows: stored(spark, rows)[0]
    more, less, other, twice = state([*base, ("s", "new", "w")]), state(base[:-2]), state([*base[:-1], ("s", "49", "x"), ("s", "new", "w")]), state([*base, base[0]])
    decide = lambda b, log=log, floor=5, noted=mark, anchor=1: reconcile.decided(spark, a, b, schema, key, log, changed(floor), noted, anchor).first()
    assert decide(state(base)).kind == "equivalent_provenance_verified"
    assert decide(more).kind == "v2_successor_verified" and decide(more).n_only_b == 1
    assert decide(less, noted=None).kind == "legacy_has_v2_missing_data" and decide(less, floor=7).n_only_a == 2
    assert decide(other, noted=None).kind == "conflict_requires_user_choice"
    assert decide(more, anchor=2).kind == "legacy_has_v2_missing_data"
    assert decide(more, log=broken).kind == "blocked_replay_unavailable"
    assert decide(twice).kind == "blocked_checkpoint_convergence"
    merged = reconcile.merged(spark, a, state([*base[:-2], ("s", "new", "w")]), schema, key)
    assert sorted(map(tuple, merged.collect())) == sorted([*base, ("s", "new", "w")])


def test_compaction_keeps_the_state(spark):
    rng = random.Random(3)
    schema = spark.createDataFrame([], "id long, layer int, seq int, v string, gone boolean").schema
    folder, rows, seq = new_folder(spark, "log"), [], 0
    compaction.create(spark, folder)
    args = (schema, "id", "layer", ["seq"], "gone")
    shown = lambda until=None: {r.id: r.v for r in compaction.state(spark, folder, *args, until).collect()}

    def expected(until):
        state = {}
        for i, layer, _, v, gone in rows:
            if layer <= until:
                state.pop(i, None) if gone else state.update({i: v})
        return state

    assert shown() == {} and not compaction.compact(spark, folder, *args, keep=2, buffer=1)
    shrunk = []
    for part in range(4):
        new = []
        for layer in range(part * 3, part * 3 + 3):
            for _ in range(8):
                seq += 1
                new.append((rng.choice([None, *range(6)]), layer, seq, f"v{seq}", rng.random() < 0.3))
        rows += new
        compaction.append(spark.createDataFrame(new, schema), folder, "layer")
        before = shown()
        shrunk.append(compaction.compact(spark, folder, *args, keep=4, buffer=2))
        assert shown() == before == expected(99)
    assert shrunk == [False, True, True, True]  # boundaries at layers 1, 4 and 7
    assert {u: shown(u) for u in (7, 9, 11)} == {u: expected(u) for u in (7, 9, 11)}
    assert len(compaction.current(spark, folder)[1]) == 3  # a snapshot and the two parts over it
    with pytest.raises(ValueError, match="begins after"):
        shown(6)
    with pytest.raises(ValueError, match="below the snapshot"):
        compaction.append(spark.createDataFrame(rows[:1], schema), folder, "layer")


def test_templates(spark):
    template = [
        Sheet("s1", "Stock", {"Name": "name", "Count": "qty"}, ["Inventory"], {"Count": ["Number"]}),
        Sheet("s2", "People", {"Name": "name"}, former=["Persons"]),
        Sheet("s3", "Notes", {"Text": "text"}),
    ]
    rows = [
        (1, "s1", "stock ", "Name", "name"), (1, "s1", "stock ", "Quantity", "QTY"),  # other shown names, the same key and stored name
        (1, "s2", "Persons", "Name", "name"), (1, "s9", "Old", "x", "x"),
        (2, "t1", "Inventory", "Name", "item"), (2, "t1", "Inventory", "Number", "n"), (2, "s3", "Other", None, None),  # by alias; key of Notes taken
        (3, "s1", "Stock", "Name", "name"), (3, "s1", "Stock", "Count", "qty"),
        (4, "a", "Stock", "Name", "name"), (4, "b", "STOCK", "Name", "name"),  # two of one name
        (5, "u", "Stock", "Sum", "qty"), (5, "u", "Stock", "Name", "name"),  # another key: stored names tell nothing
        (6, None, None, None, None),
    ]
    before = spark.createDataFrame(rows, "scope long, sheet string, name string, column string, physical string")
    got = {(r.scope, r.sheet, r.template): r for r in reconciled(before, template).collect()}
    short = {k: (r.outcome, r.why) for k, r in got.items()}
    assert {k: v for k, v in short.items() if k[0] == 1} == {(1, "s1", "s1"): ("rebase", None), (1, "s2", "s2"): ("rebase", None), (1, "s9", None): ("hide", None), (1, None, "s3"): ("introduce", None)}
    assert got[1, "s1", "s1"].renames == {"QTY": "qty"} and got[1, "s1", "s1"].inherited == ["Count", "Name"] and got[1, "s1", "s1"].ready
    assert short[2, "t1", "s1"] == ("rebase", None) and got[2, "t1", "s1"].renames == {"item": "name", "n": "qty"}
    assert short[2, None, "s3"] == ("blocked", "key_taken") and not got[2, "t1", "s1"].ready
    assert short[3, "s1", "s1"] == ("keep", None)
    assert short[4, None, "s1"] == ("blocked", "ambiguous") and short[4, "a", None] == ("hide", None)
    assert short[5, "u", "s1"] == ("blocked", "column_reused") and got[5, "u", "s1"].hidden == ["Sum"]
    assert short[6, None, "s1"] == ("introduce", None)
    outcomes = lambda **k: {r.outcome for r in reconciled(before, [], **k).collect()}
    assert outcomes() == {"hide"} and outcomes(delete_missing=True) == {"blocked"} and outcomes(delete_missing=True, confirmed=True) == {"delete"}
    assert reconciled(before.limit(0), template).count() == 0
