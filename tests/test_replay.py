"""Replay of mixed logs against a fold of plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomtable.operators.replay import replayed

SCHEMA = "message long, seq int, op int, part int, kind string, sheet string, row_id string, cells map<string,string>, name string, to string"


def plain(log):
    sheets = {}
    for r in sorted(log, key=lambda r: r[:4]):
        *_, kind, sheet, row, cells, name, to = r
        rows = sheets.setdefault(sheet, {}) if kind != "data_replace" else None
        if kind == "data_replace":
            sheets = {}
        elif kind == "sheet_replace":
            sheets[sheet] = {}
        elif kind == "row_upsert":
            rows[row] = dict(cells)
        elif kind == "row_delete":
            rows.pop(row, None)
        elif kind == "cell_edit" and row in rows:
            rows[row] |= cells
        elif kind.startswith("column_"):
            for own in rows.values():
                if kind == "column_add":
                    own[name] = to
                elif name in own:
                    value = own.pop(name)
                    if kind == "column_rename":
                        own[to] = value
    return sorted((str(s), str(i), c, str(v)) for s, rows in sheets.items() for i, own in rows.items() for c, v in own.items())


def made(rng, n):
    log, columns, fresh = [], {s: ["a", "b"] for s in ("s", "t", None)}, 0
    for message in range(n):
        sheet, row = rng.choice(["s", "s", "t", None]), rng.choice(["1", "2", "3", "4", None])
        kind = rng.choice(["row_upsert"] * 6 + ["cell_edit"] * 6 + ["row_delete"] * 2 + ["column_rename", "column_add", "column_drop"] + ["sheet_replace"] * (message % 5 == 0) + ["data_replace"] * (message % 19 == 0))
        own, place = columns[sheet], (message // 3, message % 3, rng.randrange(2))
        value = lambda: rng.choice([None, f"v{rng.randrange(10**6)}"])
        if kind in ("sheet_replace", "data_replace"):
            log.append((*place, 0, kind, sheet if kind == "sheet_replace" else None, None, None, None, None))
            for s in [sheet] if kind == "sheet_replace" else columns:
                columns[s] = ["a", "b"]
                log += [(*place, 1 + len(log), "row_upsert", s, str(k), {"a": value(), "b": value()}, None, None) for k in range(rng.randrange(3))]
        elif kind.startswith("column_"):
            fresh += 1
            name = f"c{fresh}" if kind == "column_add" else rng.choice(own) if own else "none"
            to = value() if kind == "column_add" else f"c{fresh}" if kind == "column_rename" else None
            if kind != "column_add" and name in own:
                own.remove(name)
            own += [name] if kind == "column_add" else [to] if kind == "column_rename" and name != "none" else []
            log.append((*place, 0, kind, sheet, None, None, name, to))
        else:
            cells = None if kind == "row_delete" else {c: value() for c in own if kind == "row_upsert" or rng.random() < 0.5}
            log.append((*place, 0, kind, sheet, row, cells, None, None))
    return log


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 160), (3, 0)])
def test_replay_equals_a_fold(spark, seed, n):
    log = made(random.Random(seed), n)
    df = spark.createDataFrame(log, SCHEMA).repartition(4)
    show = lambda df: sorted((str(r.sheet), str(r.row_id), r.column, str(r.value)) for r in df.collect())
    assert show(replayed(df)) == plain(log)
    if n:
        assert show(replayed(df, F.col("message") <= n // 6)) == plain([r for r in log if r[0] <= n // 6])


def test_unknown_kinds_are_refused(spark):
    with pytest.raises(ValueError, match="meta"):
        replayed(spark.createDataFrame([(0, 0, 0, 0, "meta", "s", None, None, None, None)], SCHEMA))
