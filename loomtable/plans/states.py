"""Stored states compared and merged, logs compacted, databases brought to a template."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import reconcile
from ..operators.templates import Sheet, reconciled
from ..session import new_folder
from ..sources import compaction, trees
from .histories import MUTATED, _after, _before
from .registry import query

KEY = ["o_orderkey"]
EVENTS = "user_id, event_id, event_type, value"


def _stored(df):
    folder = new_folder(df.sparkSession, "state")
    trees.store(df, KEY, folder)
    return folder


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b' ELSE 'other' END AS kind FROM orders a FULL JOIN {MUTATED} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice")
def state_rows(t):
    a, b = _before(t), _after(t)
    return reconcile.row_kinds(t.spark, _stored(a), _stored(b), a.schema, KEY)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 = 1")
def state_merged(t):
    """Rows lost in one state come back from the other, its new ones stay."""
    a = _before(t)
    b = a.filter("o_orderkey % 11 <> 0").unionByName(a.filter("o_orderkey % 50 = 1").withColumn("o_orderkey", -F.col("o_orderkey")))
    return reconcile.merged(t.spark, _stored(a), _stored(b), a.schema, KEY)


_COUNT = "(SELECT count(*) FROM orders WHERE {})"


@query(f"""SELECT 'equal' AS name, 'equivalent_provenance_verified' AS kind, 0::BIGINT AS n_only_a, 0::BIGINT AS n_only_b, 0::BIGINT AS n_other
UNION ALL SELECT 'grown', 'v2_successor_verified', 0, {_COUNT.format("o_orderkey % 50 = 1")}, 0
UNION ALL SELECT 'short', 'legacy_has_v2_missing_data', {_COUNT.format("o_orderkey % 11 = 0")}, 0, 0
UNION ALL SELECT 'edited', 'conflict_requires_user_choice', 0, 0, {_COUNT.format("o_orderkey % 7 = 0")}""")
def state_decisions(t):
    """What to do with a second state, decided from the stored rows, its log and its note."""
    a = _before(t)
    grown = a.unionByName(a.filter("o_orderkey % 50 = 1").withColumn("o_orderkey", -F.col("o_orderkey")))
    edited = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    # The log's floors are those of the table: a checkpoint at 1 and one more entry.
    last = t.orders.agg(F.max("o_orderkey").cast("int").alias("floor"))
    entry = F.inline(F.array(*[F.struct(F.lit("orders").alias("sheet"), F.lit(n).alias("seq"), F.lit(f"{n}:e").alias("revision"), F.lit(p).cast("string").alias("parent")) for n, p in ((1, None), (2, "1:e"))]))
    log, changed = last.select(entry, "floor"), last.select(F.lit("orders").alias("sheet"), "floor")
    base = _stored(a)
    mark = trees.root(t.spark, base)
    cases = {"equal": (a, mark), "grown": (grown, mark), "short": (a.filter("o_orderkey % 11 <> 0"), None), "edited": (edited, None)}
    decided = [reconcile.decided(t.spark, base, _stored(b), a.schema, KEY, log, changed, noted, 1).select(F.lit(name).alias("name"), "kind", "n_only_a", "n_only_b", "n_other") for name, (b, noted) in cases.items()]
    return reduce(lambda x, y: x.unionAll(y), decided)


@query("SELECT user_id, event_type, value FROM events WHERE event_type <> 'error' AND (user_id, event_id) IN (SELECT user_id, max(event_id) FROM events GROUP BY user_id)")
def compacted_log(t):
    """The events' state out of a snapshot and the parts that two compactions left."""
    n = t.events.agg(F.max("event_id")).first()[0] + 1
    layered = t.events.select("user_id", "event_id", "event_type", "value", F.floor(F.col("event_id") * 60 / n).cast("int").alias("layer"))
    folder, args = new_folder(t.spark, "log"), (layered.schema, "user_id", "layer", ["event_id"], "event_type = 'error'")
    compaction.create(t.spark, folder)
    for part in range(3):
        compaction.append(layered.filter(F.col("layer").between(20 * part, 20 * part + 19)), folder, "layer")
        compaction.compact(t.spark, folder, *args, keep=10, buffer=10)
    return compaction.state(t.spark, folder, *args)


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS scope, c_mktsegment AS seg FROM customer),
b AS (SELECT scope, CASE WHEN scope % 3 = 1 THEN 'old_' ELSE '' END || seg AS sheet, seg FROM s),
m AS (SELECT scope, sheet, seg AS template, CASE WHEN scope % 3 = 0 THEN 'keep' ELSE 'rebase' END AS outcome FROM b WHERE seg IN ('BUILDING', 'MACHINERY')),
o AS (SELECT * FROM m UNION ALL SELECT scope, sheet, NULL, 'hide' FROM b WHERE seg NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT scope, NULL, template, 'introduce' FROM (SELECT DISTINCT scope FROM b) CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY'), ('EXTRA')) v(template) WHERE (scope, template) NOT IN (SELECT (scope, template) FROM m))
SELECT scope, sheet, template, outcome, CASE WHEN outcome = 'rebase' AND scope % 3 = 1 THEN 'acct' END AS renamed, true AS ready FROM o""")
def template_outcomes(t):
    """A database a nation, a table a segment: names as in the template, former names under
    another key, or other shown columns under the same key."""
    kind, of = F.col("scope") % 3, t.customer.select(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("seg")).distinct()
    columns = F.array(F.struct(F.lit("Name").alias("column"), F.lit("name").alias("physical")), F.struct(F.when(kind == 0, "Balance").otherwise("Account").alias("column"), F.when(kind == 1, "acct").otherwise("balance").alias("physical")))
    before = of.select("scope", F.concat(F.when(kind == 1, "old_").otherwise(""), "seg").alias("sheet"), F.concat(F.when(kind == 1, "Former ").otherwise("  "), F.lower("seg")).alias("name"), F.inline(columns))
    shown = {"Name": "name", "Balance": "balance"}
    template = [Sheet(s, s, shown, [f"former {s}"], {"Balance": ["account"]}) for s in ("BUILDING", "MACHINERY")] + [Sheet("EXTRA", "Extra", shown)]
    out = reconciled(before.withColumn("name", F.when(kind == 0, F.upper(F.trim("name"))).otherwise(F.col("name"))), template)
    return out.select("scope", "sheet", "template", "outcome", F.array_max(F.map_keys("renames")).alias("renamed"), "ready")
