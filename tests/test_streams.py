"""Streams run in several goes against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomtable.session import new_folder
from loomtable.streaming import triggers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def goes(spark, schema, make, batches, rocks=False):
    """The rows of the stream make(stream) after each of the batches."""
    folder, out, state = (new_folder(spark, k) for k in ("in", "out", "state"))
    found = []
    for nth, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        found.append(rows(triggers.run_to_end(make(stream), out, state, rocks=rocks)))
    return found


@pytest.mark.parametrize("frequency,skip,window", [(2, 1, 8), (5, 0, 3)])
def test_due_floors_batch_by_batch(spark, frequency, skip, window):
    rng = random.Random(frequency)
    batches = [[(rng.randrange(3), nth) for nth in range(rng.randrange(1, 14))] for _ in range(3)]
    want, state = [], {}
    for batch in batches:
        for key in {k for k, _ in batch}:
            floors, recorded = state.get(key, (0, 0))
            floors += sum(k == key for k, _ in batch)
            done = floors - skip
            if done - recorded >= frequency:
                due = [x for x in range(recorded + 1, done + 1) if x > done - window]
                want.append((key, len(due), due[0], due[-1]))
                recorded = done
            state[key] = (floors, recorded)
    got = goes(spark, "k long, x long", lambda s: triggers.due_floors(s, "k", frequency, skip, window), batches, rocks=True)
    assert got[-1] == sorted(want, key=str)


def test_idle_floors_become_due(spark):
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    batches = [[(1, at(0)), (1, at(1)), (1, at(2)), (2, at(3))], [(2, at(30))], [(3, at(200))], [(3, at(201))]]
    make = lambda s: triggers.due_floors(s, "k", 100, 1, 2, "ts", 600)
    got = goes(spark, "k long, ts timestamp", make, batches, rocks=True)
    assert got[0] == [] and (1, 2, 2, 3) in got[-1] and (2, 2, 1, 2) in got[-1] and all(k != 3 for k, *_ in got[-1])


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def made(given):
    """events at minutes, as timestamps without zone."""
    return [(i, datetime(2024, 1, 1) + timedelta(minutes=m), u, k) for i, m, u, k in given]


def test_sessions_close_and_late_rows_go(spark):
    first = made([(1, 0, 7, "a"), (2, 9, 7, "a"), (3, 20, 7, "a"), (4, 5, None, "a")])
    second = made([(5, 200, 7, "a"), (6, 1, 8, "a")])  # the second is taken before the watermark has moved on
    third = made([(7, 2, 9, "a")])  # this one is too late
    got = goes(spark, EVENTS, lambda s: triggers.sessions(s, "ts", ["user_id"], "10 minutes", "30 minutes"), [first, second, third])
    assert [(r[2], r[3]) for r in got[-1]] and all(r[2] != 9 for r in got[-1])
    assert sorted((r[2], r[3]) for r in got[-1] if r[2] == 7) == [(7, 1), (7, 2)]


def test_interval_join_keeps_what_has_no_partner(spark):
    given = made([(1, 0, 7, "v"), (2, 30, 7, "p"), (3, 61, 7, "p"), (4, 0, 8, "v"), (5, 10, 9, "p"), (6, 5, None, "v"), (7, 6, None, "p")])

    def make(stream):
        events = triggers.closed(stream, "ts", user_id=-1)
        side = lambda k, name: events.filter(F.col("event_type").isNull() | (F.col("event_type") == k)).select(F.col("event_id").alias(name), "ts", "user_id")
        return triggers.interval_joined(side("v", "v"), side("p", "p"), ["user_id"], "ts", "1 hour", "5 minutes", "leftOuter").select("v", "p")

    got = goes(spark, EVENTS, make, [given])[-1]
    assert sorted((v, p) for v, p in got if v is not None and (v, p) != (None, None)) == sorted([(1, 2), (4, None), (6, None)], key=str)
