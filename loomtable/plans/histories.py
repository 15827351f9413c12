"""Change capture, writes, migration, snapshots and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, migrate, ordered, replay
from ..session import new_folder
from ..sources import layers, snapshots
from ..streaming import triggers
from .registry import query

MUTATED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 = 1)"


def _before(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


def _after(t):
    rows = _before(t)
    changed = rows.filter("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return changed.unionByName(rows.filter("o_orderkey % 50 = 1").withColumn("o_orderkey", -F.col("o_orderkey")))


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'delete' ELSE 'upsert' END AS op, a.o_orderstatus, a.o_totalprice FROM {MUTATED} a FULL JOIN orders b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice")
def delta_build(t):
    return changes.delta(_before(t), _after(t), "o_orderkey")


@query(f"SELECT * FROM {MUTATED}")
def delta_roundtrip(t):
    return changes.apply_delta(_before(t), changes.delta(_before(t), _after(t), "o_orderkey"), "o_orderkey")


LAST = "arg_max({0}, event_id)"


@query("SELECT user_id, event_type, value FROM events WHERE event_type <> 'error' AND (user_id, event_id) IN (SELECT user_id, max(event_id) FROM events GROUP BY user_id)")
def replay_lww(t):
    return changes.last_writes(t.events, "user_id", ["event_id"], ["event_type", "value"], F.col("event_type") == "error")


@query("SELECT user_id, event_type, value FROM events WHERE event_type <> 'error' AND (user_id, event_id) IN (SELECT user_id, max(event_id) FROM events WHERE event_id <= 5000 GROUP BY user_id)")
def replay_as_of(t):
    return changes.last_writes(t.events, "user_id", ["event_id"], ["event_type", "value"], F.col("event_type") == "error", F.col("event_id") <= 5000)


@query("SELECT user_id, event_type, value FROM events WHERE event_type <> 'error' AND (user_id, event_id) IN (SELECT user_id, max(event_id) FROM events GROUP BY user_id)")
def replay_checkpoint(t):
    error = F.col("event_type") == "error"
    state = changes.last_writes(t.events, "user_id", ["event_id"], ["event_type", "value"], error, F.col("event_id") <= 5000)
    late = t.events.filter("event_id > 5000").select("user_id", "event_type", "value", "event_id")
    return changes.replay(state, late, "user_id", ["event_id"], error)


@query("SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS cut FROM events WHERE event_type = 'error' GROUP BY user_id) c ON e.user_id = c.user_id WHERE cut IS NULL OR event_id >= cut")
def replay_reset(t):
    return changes.after_reset(t.events, "user_id", "event_id", F.col("event_type") == "error").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value IS NULL OR value <= b")
def log_seq_check(t):
    return changes.sequence_faults(t.events, "user_id", "event_id", "value").select("event_id")


@query("SELECT 'blank doc_id' AS issue, count(*) FILTER (WHERE doc_id IS NULL) AS n FROM documents UNION ALL SELECT 'blank text', count(*) FILTER (WHERE trim(coalesce(text, ''), ' ') = '') FROM documents UNION ALL SELECT 'repeated doc_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)")
def row_audit(t):
    return changes.audit(t.documents, "doc_id", ["text"])


@query("SELECT count(*) = count(DISTINCT o_orderkey) AS stable FROM orders")
def stable_ids(t):
    return changes.stable_ids(t.orders, "o_orderkey")


@query("WITH b AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS x FROM events), c AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS batch FROM b) SELECT user_id, batch::BIGINT AS batch, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n_ops FROM c GROUP BY ALL")
def op_batches(t):
    return changes.runs(t.events, "user_id", "event_id", "event_type")


@query("SELECT conv_id, turn FROM conversations WHERE turn > (SELECT max(turn) FROM conversations) - 5")
def compaction_kept(t):
    return changes.kept_layers(t.conversations, "turn", 3, 2).select("conv_id", "turn")


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'drop' WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus THEN 'reuse' ELSE 'embed' END AS status FROM {MUTATED} a FULL JOIN orders b ON a.o_orderkey = b.o_orderkey")
def index_increment(t):
    return changes.to_recompute(_after(t), _before(t), "o_orderkey", "o_orderstatus")


@query("SELECT user_id, value FROM events WHERE event_type <> 'error' AND (user_id, event_id) IN (SELECT user_id, max(event_id) FROM events GROUP BY user_id)")
def merged_layers(t):
    return changes.merged_layers(t.events.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "value")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey > 10")
def unreached_files(t):
    return changes.unreached(t.supplier.select("s_suppkey"), t.supplier.filter("s_suppkey % 3 = 0").select("s_suppkey"), "s_suppkey", F.col("s_suppkey"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'locked out' WHEN n_nationkey < 10 AND n_nationkey <> 5 THEN 'new' ELSE n_name END AS n_name FROM nation")
def locked_edits(t):
    edits = t.nation.filter("n_nationkey < 10").select("n_nationkey", F.lit("n_name").alias("column"), F.lit("new").alias("value"), F.lit(1).alias("seq"))
    more = edits.filter("n_nationkey = 3").withColumns({"value": F.lit("locked out"), "seq": F.lit(2)})
    locks = t.spark.createDataFrame([(5, None), (None, "n_regionkey")], "n_nationkey int, column string")
    return changes.edited(t.nation, changes.locked(edits.unionByName(more), locks, "n_nationkey"), "n_nationkey").select("n_nationkey", "n_name")


#: Write sets made of the tables: kinds all, sheet, schema, row, cell over customers' segments.
UNITS_A = "SELECT c_custkey AS id, CASE WHEN c_custkey = 700 THEN 'all' WHEN c_custkey % 400 = 1 THEN 'sheet' WHEN c_custkey % 3 = 0 THEN 'cell' ELSE 'row' END AS kind, c_mktsegment || (c_nationkey // 2) AS sheet, (c_custkey // 10)::VARCHAR AS row, CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'balance' END AS col FROM customer"
UNITS_B = "SELECT c_custkey AS id, CASE WHEN c_custkey % 500 = 7 THEN 'schema' WHEN c_custkey % 4 = 0 THEN 'row' ELSE 'cell' END AS kind, c_mktsegment || (c_nationkey // 2) AS sheet, (c_custkey // 10)::VARCHAR AS row, CASE WHEN c_custkey % 5 = 0 THEN 'name' ELSE 'balance' END AS col FROM customer"


@query(f"""SELECT a.id AS a, b.id AS b FROM ({UNITS_A}) a JOIN ({UNITS_B}) b ON a.kind = 'all' OR b.kind = 'all' OR (a.sheet = b.sheet AND (a.kind IN ('sheet', 'schema') OR b.kind IN ('sheet', 'schema') OR (a.row = b.row AND (a.kind = 'row' OR b.kind = 'row' OR a.col = b.col))))""")
def write_conflicts(t):
    key, of = F.col("c_custkey"), lambda c, n: F.col("c_custkey") % c == n
    sheet = F.concat("c_mktsegment", F.floor(F.col("c_nationkey") / 2))
    row = F.floor(key / 10).cast("string")
    a = t.customer.select(key.alias("id"), F.when(key == 700, "all").when(of(400, 1), "sheet").when(of(3, 0), "cell").otherwise("row").alias("kind"), sheet.alias("sheet"), row.alias("row"), F.when(of(2, 0), "name").otherwise("balance").alias("column"))
    b = t.customer.select(key.alias("id"), F.when(of(500, 7), "schema").when(of(4, 0), "row").otherwise("cell").alias("kind"), sheet.alias("sheet"), row.alias("row"), F.when(of(5, 0), "name").otherwise("balance").alias("column"))
    return changes.conflicts(a, b)


@query("SELECT n_nationkey AS id FROM nation UNION ALL SELECT 24 + row_number() OVER (ORDER BY r_regionkey) FROM region")
def remapped_ids(t):
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), "n_name").unionAll(t.region.select(F.col("r_regionkey").cast("long"), F.concat(F.lit("~"), "r_name")))
    return changes.remapped_ids(rows, "id", ["n_name"]).select("id")


@query("SELECT conv_id, count(*) AS n_due, min(floor)::BIGINT AS first, max(floor)::BIGINT AS last FROM (SELECT *, max(floor) OVER (PARTITION BY conv_id) AS top FROM (SELECT conv_id, turn, sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS floor, role FROM conversations)) WHERE role <> 'user' AND floor <= top - 1 AND floor > top - 9 GROUP BY conv_id HAVING count(*) >= 2")
def stream_count_trigger(t):
    floors = ordered.logical_clock(t.conversations, "conv_id", "turn", F.col("role") != "user").filter("role <> 'user'")
    return ordered.due(floors, "conv_id", "floor", F.lit(False), 2, 1, 8)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE c >= 12 AND r <= c - 4")
def summary_merge(t):
    return ordered.to_merge(t.events, "user_id", "event_id", 8, 4).select("user_id", "event_id")


MIXED = """WITH m AS (SELECT max(event_id) AS m FROM events), live AS (SELECT events.* FROM events, m WHERE event_id > CASE WHEN user_id % 4 = 1 THEN m // 4 ELSE m // 10 END),
ops AS (SELECT user_id, event_id AS pos, event_type AS kind, floor(value)::BIGINT::VARCHAR AS v FROM live WHERE event_type IN ('signup', 'error') UNION ALL SELECT DISTINCT user_id, m // 4, 'seed', '0' FROM events, m WHERE user_id % 4 = 1 AND user_id < 400),
r AS (SELECT user_id, max(pos) AS pos, arg_max(kind, pos) AS kind, arg_max(v, pos) AS v FROM ops GROUP BY user_id HAVING arg_max(kind, pos) <> 'error'),
w AS (SELECT r.user_id, arg_max(CASE event_type WHEN 'view' THEN floor(value)::BIGINT::VARCHAR ELSE 'c' || event_id END, event_id) FILTER (WHERE event_type IN ('view', 'click')) AS v, count(*) FILTER (WHERE event_type = 'purchase') AS bought
      FROM r JOIN live ON live.user_id = r.user_id AND event_id > r.pos GROUP BY r.user_id)
SELECT 's' || (r.user_id % 4) AS sheet, r.user_id::VARCHAR AS row_id, c AS "column", CASE WHEN c = 'kind' THEN CASE WHEN bought > 0 THEN 'purchase' ELSE r.kind END WHEN c = 'amount' THEN coalesce(w.v, r.v) WHEN pos > m // 2 THEN 'new' ELSE 'none' END AS value
FROM r LEFT JOIN w ON w.user_id = r.user_id, m, (SELECT unnest(['kind', 'amount', 'note']) AS c)"""


@query(MIXED)
def replay_mixed(t):
    """events as a log: rows, cells, a replaced sheet, replaced data, and three changes of columns
    at a third, half and two thirds of it."""
    none = {"row_id": F.lit(None).cast("string"), "cells": F.lit(None).cast("map<string,string>"), "name": F.lit(None).cast("string"), "to": F.lit(None).cast("string"), "part": F.lit(0), "seq": F.lit(0), "op": F.lit(1)}
    columns = ["message", "seq", "op", "part", "kind", "sheet", "row_id", "cells", "name", "to"]
    last = t.events.agg(F.max("event_id").alias("m"))  # one row
    events = t.events.crossJoin(F.broadcast(last)).withColumns(none).withColumns({"message": F.col("event_id"), "sheet": F.concat(F.lit("s"), F.col("user_id") % 4), "row_id": F.col("user_id").cast("string"), "op": F.lit(0)})
    third, half, late = (F.col("event_id") > F.floor(F.col("m") * n / 6) for n in (2, 3, 4))
    value, amount = F.floor("value").cast("long").cast("string"), F.when(third, "amount").otherwise("value")
    cells = F.map_concat(F.create_map(F.lit("kind"), F.col("event_type"), amount, value), F.when(late, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("props"), F.col("props"))), F.when(half, F.create_map(F.lit("note"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>")))
    edit = F.when(F.col("event_type") == "view", F.create_map(amount, value)).when(F.col("event_type") == "click", F.create_map(amount, F.concat(F.lit("c"), "event_id"))).otherwise(F.create_map(F.lit("kind"), F.lit("purchase")))
    kind = F.when(F.col("event_type") == "signup", "row_upsert").when(F.col("event_type") == "error", "row_delete").otherwise("cell_edit")
    rows = events.withColumns({"kind": kind, "cells": F.when(kind == "row_upsert", cells).when(kind == "cell_edit", edit)}).select(*columns)
    marks = last.withColumns(none)
    at = lambda n, d: F.floor(F.col("m") * n / d)
    sheets = F.explode(F.array(*[F.lit(f"s{k}") for k in range(4)]))
    one = lambda kind, place, **cells: marks.withColumns({"message": place, "kind": F.lit(kind), "sheet": sheets if kind.startswith("column") else F.lit("s1" if kind == "sheet_replace" else None).cast("string"), **{k: F.lit(v) for k, v in cells.items()}}).select(*columns)
    seeds = events.filter("user_id % 4 = 1 AND user_id < 400").select("row_id", "m").distinct().withColumns({**{k: v for k, v in none.items() if k != "row_id"}, "message": at(1, 4), "kind": F.lit("row_upsert"), "sheet": F.lit("s1"), "part": F.lit(1), "cells": F.create_map(F.lit("kind"), F.lit("seed"), F.lit("value"), F.lit("0"), F.lit("props"), F.lit("p"))}).select(*columns)
    log = rows
    for more in (one("data_replace", at(1, 10)), one("sheet_replace", at(1, 4)), seeds, one("column_rename", at(1, 3), name="value", to="amount"), one("column_add", at(1, 2), name="note", to="none"), one("column_drop", at(2, 3), name="props")):
        log = log.unionByName(more)
    return replay.replayed(log)


# Migration
@query("SELECT p_partkey, p_name AS title, p_size::VARCHAR AS p_size, 'none' AS note FROM part")
def migrate_table(t):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    old = t.part.select("p_partkey", "p_name", "p_size", "p_type")
    old = old.withMetadata("p_name", {"display": "Title"})
    new = StructType([StructField("p_partkey", LongType()), StructField("title", StringType(), True, {"display": "Title"}), StructField("p_size", StringType()), StructField("note", StringType(), False)])
    return migrate.migrate(old, migrate.plan(old.schema, new, {"note": "none"}), new, confirm_drops=True)


@query("SELECT 'p_brand' AS \"column\", count(p_brand) AS n_lost FROM part")
def migrate_lossy(t):
    from pyspark.sql.types import LongType, StructField, StructType

    old = t.part.select("p_partkey", "p_brand")
    p = migrate.plan(old.schema, StructType([StructField("p_partkey", LongType()), StructField("p_brand", LongType())]))
    return migrate.lossy(old, p)


@query("SELECT r_regionkey, r_name, NULL::VARCHAR AS note FROM region")
def migrate_reconcile(t):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    template = StructType([StructField("r_regionkey", IntegerType()), StructField("r_name", StringType()), StructField("note", StringType())])
    return migrate.reconciled(t.region.withColumnRenamed("r_name", "region"), template, {"region": "r_name"})


@query("SELECT 'size' AS rule, count(*) FILTER (WHERE NOT p_size < 40) AS n FROM part UNION ALL SELECT 'brand', count(*) FILTER (WHERE NOT p_brand LIKE 'Brand%') FROM part")
def constraint_check(t):
    return migrate.violations(t.part, {"size": "p_size < 40", "brand": "p_brand LIKE 'Brand%'"})


# Snapshots
@query("SELECT nation.*, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def snapshot_roundtrip(t):
    folder = new_folder(t.spark, "snapshot")
    snapshots.save({"nation": t.nation, "region": t.region}, folder)
    back = snapshots.load(t.spark, folder)
    return back["nation"].join(back["region"].select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).drop("r_regionkey")


@query("SELECT * FROM part")
def cells_roundtrip(t):
    return snapshots.from_cells(snapshots.to_cells(t.part, "part", "p_partkey"), t.part.schema)


@query("SELECT * FROM region WHERE r_regionkey > 1")
def versions_current(t):
    folder = new_folder(t.spark, "versions")
    for i in (0, 1):
        snapshots.publish(t.region.filter(F.col("r_regionkey") > i), folder, i)
    return snapshots.current(t.spark, folder)


@query("""SELECT vec_id, CASE WHEN vec_id = 22 THEN 5 WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label, len(embedding) AS n FROM embeddings WHERE vec_id % 11 <> 0 OR vec_id = 22
UNION ALL SELECT -vec_id - 1, label, len(embedding) FROM embeddings WHERE vec_id % 5 = 0""")
def index_layers(t):
    """A vector index as base and deltas: changed rows, deletes, new rows, and a fold on the way."""
    folder, base = new_folder(t.spark, "layers"), t.embeddings.select("vec_id", "label", "embedding")
    layers.write_base(base, "vec_id", folder, pack_rows=100)
    op = lambda df, name: df.withColumn("op", F.lit(name))
    changed = op(base.filter("vec_id % 7 = 0").withColumn("label", F.col("label") + 100), "upsert")
    new = op(base.filter("vec_id % 5 = 0").withColumn("vec_id", -F.col("vec_id") - 1).unionByName(base.filter("vec_id = 22").withColumn("label", F.lit(5))), "upsert")
    n = changed.count()
    for delta in (changed, op(base.filter("vec_id % 11 = 0"), "delete"), new):
        layers.write_delta(delta, "vec_id", folder, base.schema, fold_at=n + 2, pack_rows=100)
    return layers.read(t.spark, folder, base.schema, "vec_id").select("vec_id", "label", F.size("embedding").alias("n"))


# Streams: the events table as a stream of files, run to its end
def _stream(t, name):
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/{name}.parquet*")


@query("SELECT user_id, unnest(range(0, c // 10))::BIGINT AS batch, 10::BIGINT AS n FROM (SELECT user_id, count(*) AS c FROM events GROUP BY user_id) WHERE c >= 10")
def stream_counted(t):
    return triggers.collected(triggers.counted(_stream(t, "events"), "user_id", 10), "counted")


@query("SELECT DISTINCT event_id FROM events")
def stream_without_repeats(t):
    doubled = _stream(t, "events").union(_stream(t, "events"))
    return triggers.collected(triggers.without_repeats(doubled, "ts", ["event_id"], 60), "unrepeated").select("event_id")


@query("SELECT user_id, event_type, value FROM events WHERE event_type <> 'error' AND (user_id, event_id) IN (SELECT user_id, max(event_id) FROM events GROUP BY user_id)")
def stream_keep_table(t):
    folder, state = new_folder(t.spark, "kept"), new_folder(t.spark, "kept-state")
    q = triggers.keep_table(_stream(t, "events"), "user_id", ["event_id"], ["event_type", "value"], "event_type = 'error'", folder, state)
    q.awaitTermination()
    schema = t.events.select("user_id", "event_id", "event_type", "value", F.lit(True).alias("_gone")).schema
    return triggers.table_of(t.spark, schema, folder, "user_id", ["event_id"], ["event_type", "value"], q.lastProgress["batchId"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(t):
    """Hourly counts; the row at the end of time closes the last window."""
    found = triggers.collected(triggers.windowed(triggers.closed(_stream(t, "events"), "ts"), "ts", ["event_type"], "1 hour", "2 hours"), "windows")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS x FROM events), c AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM b)
SELECT min(ts) AS start, max(ts) AS last, user_id, count(*) AS n FROM c GROUP BY user_id, s""")
def stream_sessions(t):
    """A user's events less than six hours apart."""
    found = triggers.collected(triggers.sessions(triggers.closed(_stream(t, "events"), "ts"), "ts", ["user_id"], "6 hours", "1 hour"), "sessions")
    return found.filter("user_id IS NOT NULL").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


@query("SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id FROM events v LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 2 DAY WHERE v.event_type = 'view'")
def stream_interval_join(t):
    """Each view with the purchases of its user within two days, or none."""
    events = triggers.closed(_stream(t, "events").select("event_id", "ts", "user_id", "event_type"), "ts", user_id=-1)
    kind = lambda k, name: events.filter(F.col("event_type").isNull() | (F.col("event_type") == k)).select(F.col("event_id").alias(name), "ts", "user_id")
    found = triggers.collected(triggers.interval_joined(kind("view", "view_id"), kind("purchase", "purchase_id"), ["user_id"], "ts", "2 days", "1 hour", "leftOuter"), "joined")
    return found.filter("view_id IS NOT NULL").select("view_id", "purchase_id", "user_id")


DUE = "SELECT conv_id, count(*) AS n_due, min(floor)::BIGINT AS first, max(floor)::BIGINT AS last FROM (SELECT *, max(floor) OVER (PARTITION BY conv_id) AS top FROM (SELECT conv_id, turn, sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS floor, role FROM conversations)) WHERE role <> 'user' AND floor <= top - 1 AND floor > top - 9 GROUP BY conv_id HAVING count(*) >= 2"


@query(DUE)
def stream_due_floors(t):
    """The plan of stream_count_trigger from a stream's state."""
    floors = _stream(t, "conversations").filter("role <> 'user'")
    return triggers.collected(triggers.due_floors(floors, "conv_id", 2, 1, 8), "due", rocks=True)
