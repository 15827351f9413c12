"""Equal bests and times between two milliseconds, against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomtable import plans
from loomtable.operators import logs, retrieval


@pytest.fixture
def ordered_duck():
    return duckdb.connect(config={"threads": 1})


def test_best_per_row_of_equal_prices_is_the_first_stored(spark, tmp_path, ordered_duck):
    rows = "SELECT i // 4 AS l_orderkey, (i * 7 % 5)::INTEGER AS l_linenumber, CASE WHEN i % 24 < 4 THEN NULL WHEN i % 24 = 5 THEN 'nan'::DOUBLE ELSE -5 * (i % 3) END AS l_extendedprice FROM range(400) t(i)"
    ordered_duck.execute(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet'")
    ordered_duck.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    got = plans.QUERIES["best_chunk_per_row"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("string")).collect()
    want = ordered_duck.execute(plans.SQL["best_chunk_per_row"]).fetchall()
    said = lambda x: None if x is None else "NaN" if x != x else str(x)
    assert sorted(map(tuple, got)) == sorted((k, n, said(p)) for k, n, p in want)


def test_best_per_row_takes_the_least_cells(spark):
    df = spark.createDataFrame([(1, 9, 2.0), (1, 3, 2.0), (1, 5, 2.0), (2, 1, None)], "k int, n int, p double").repartition(3)
    assert sorted(map(tuple, retrieval.best_per_row(df, "k", F.col("p")).collect())) == [(1, 3, 2.0), (2, None, None)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_schedule_rounds_to_milliseconds(spark, tmp_path, ordered_duck, zone):
    us = [-2999501, -2999500, -2999499, -1000500, -1000400, -500, -1, 0, 499, 500, 999499, 999500, 1706654933999959]
    rows = ", ".join(f"({i}, make_timestamp({x}), {i}, 'view', 1.0)" for i, x in enumerate(us))
    ordered_duck.execute(f"COPY (FROM (VALUES {rows}, (99, NULL, 3, 'view', 1.0)) v(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    ordered_duck.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = plans.QUERIES["log_schedule"](spark, str(tmp_path)).select("user_id", "last_filled", "last_changed").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(tuple, got)) == sorted(ordered_duck.execute(plans.SQL["log_schedule"]).fetchall())


def test_last_row_without_a_floor_is_passed_over(spark):
    log = spark.createDataFrame([("t", 1, 5), ("t", 2, None)], "table string, seq int, floor int")
    assert logs.schedule_summary(log, "table", "floor", "seq", F.lit(True), F.lit(False)).collect() == [("t", 5, None)]
