"""The builder, joins, aggregates, windows, orders and sets over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.predicates import any_cell, compare, glob, keywords, truthy
from ..operators.ordered import batches, codes, elementary, last_rows, logical_clock, overlapping, spliced
from ..operators.query import TableQuery, rows_of
from ..operators import frames
from .registry import query

R2 = lambda c: F.round(c, 2)


# Builder: filters
@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem WHERE l_quantity > 10 AND l_linestatus IN ('O', 'F') OR l_discount = 0 GROUP BY l_returnflag HAVING count(*) > 10")
def builder_revenue(t):
    q = TableQuery(t.lineitem).where("l_quantity", ">", 10).where_in("l_linestatus", ["O", "F"]).or_where("l_discount", 0)
    revenue = R2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue")
    return q.group_by("l_returnflag").select("l_returnflag", revenue, F.count(F.lit(1)).alias("n_lines")).having("count(1) > 10").frame().select("l_returnflag", "revenue", "n_lines")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 200000) OR (o_orderpriority = '1-URGENT' AND o_totalprice <= 20000)")
def builder_where_and_or(t):
    q = TableQuery(t.orders).where("o_orderstatus", "O").where("o_totalprice", ">", 200000)
    return q.or_where("o_orderpriority", "1-URGENT").where("o_totalprice", "<=", 20000).select("o_orderkey", "o_totalprice").frame()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus NOT IN ('O') AND l_quantity BETWEEN 5 AND 7")
def builder_in_notin_between(t):
    q = TableQuery(t.lineitem).where_in("l_returnflag", ["R", "A"]).where_not_in("l_linestatus", ["O"]).where_not_in("l_returnflag", [])
    return q.where_between("l_quantity", 7, 5).select("l_orderkey", "l_linenumber", "l_quantity").frame()


@query("SELECT p_partkey FROM part WHERE false")
def builder_empty_in(t):
    return TableQuery(t.part).where_in("p_size", []).select("p_partkey").frame()


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%e%' AND p_brand IS NOT NULL AND NOT p_type IS NULL")
def builder_like_null(t):
    return TableQuery(t.part).where_like("p_name", "%A%e%").where_not_null("p_brand").where("p_type", ">", None).select("p_partkey", "p_name").frame()


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 2 AND max(value) > 1")
def builder_group_having(t):
    q = TableQuery(t.events).where("event_type", "error").group_by("event_type").group_by("user_id")
    return q.select(F.count(F.lit(1)).alias("n")).having("count(1) >= 2 AND max(value) > 1").frame()


@query("SELECT count(*) AS n, round(coalesce(sum(l_quantity), 0), 2) AS s, round(coalesce(avg(l_tax), 0), 6) AS a, coalesce(min(l_discount), 0) AS lo, coalesce(max(l_discount), 0) AS hi, 0.0::DOUBLE AS none FROM lineitem WHERE l_returnflag = 'N'")
def builder_agg_suite(t):
    q = TableQuery(t.lineitem).where("l_returnflag", "N")
    one = [q.aggregate("count", alias="n"), q.aggregate("sum", "l_quantity", "s"), q.aggregate("avg", "l_tax", "a"), q.aggregate("min", "l_discount", "lo"), q.aggregate("max", "l_discount", "hi"), q.where("l_quantity", "<", 0).aggregate("sum", "l_quantity", "none")]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # rows of one
    return out.withColumns({"s": R2("s"), "a": F.round("a", 6)})


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey")
def builder_bare_columns(t):
    return TableQuery(t.orders, "o_orderkey").group_by("o_custkey").select("o_custkey", "o_orderkey", "o_orderstatus", F.count(F.lit(1)).alias("n")).frame()


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def builder_distinct(t):
    return TableQuery(t.customer).select("c_mktsegment", "c_nationkey").distinct().frame()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def builder_page(t):
    return TableQuery(t.orders).order_by("o_orderkey").order_by(("o_totalprice", "desc"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(25).offset(10).frame()


@query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 90")
def builder_bare_offset(t):
    return TableQuery(t.supplier).order_by("s_suppkey").select("s_suppkey").offset(90).frame()


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 2, 3) AND p_brand IS NOT NULL ORDER BY p_size DESC, p_partkey LIMIT 1000 OFFSET 5")
def declarative_rows(t):
    return rows_of(t.part.filter("p_brand IS NOT NULL"), ["p_partkey", "p_brand", "p_size"], {"p_size": [1, 2, 3]}, [("p_size", "desc"), "p_partkey"], 5000, 5)


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_regionkey > 1 LIMIT 1000")
def catalog_sql(t):
    c = Catalog(t.spark, "cat_")
    c.register("nation", t.nation, ("nations",))
    c.register("region", t.region)
    return c.sql("SELECT n_name, r_name FROM cat_nations JOIN cat_region ON n_regionkey = r_regionkey WHERE r_regionkey > ?", [1], limit=1000)


# Predicates
@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') AND NOT contains(lower(text), 'mit')) OR contains(lower(text), 'apache')")
def seed_predicate(t):
    return t.documents.filter(keywords(F.col("text"), "license&!mit,APACHE")).select("doc_id")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey::VARCHAR = '3' OR trim(n_name) = '3' OR n_regionkey::VARCHAR = '3'")
def cell_predicate(t):
    return t.nation.filter(any_cell(t.nation.columns, "3")).select("n_nationkey")


@query("SELECT p_partkey FROM part WHERE CASE WHEN try_cast(p_size::VARCHAR AS DOUBLE) IS NOT NULL THEN p_size >= 40 ELSE p_size::VARCHAR >= '40' END AND p_brand >= 'Brand#3'")
def loose_compare(t):
    return t.part.filter(compare(F.col("p_size"), "≥", "40") & compare(F.col("p_brand"), ">=", "Brand#3")).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, coalesce(l_discount <> 0, false) AS yes FROM lineitem")
def truthiness(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", truthy(F.col("l_discount")).alias("yes"))


@query("SELECT c_custkey FROM customer WHERE c_name GLOB '*[0-4]?5'")
def glob_predicate(t):
    return t.customer.filter(glob(F.col("c_name"), "*[0-4]?5")).select("c_custkey")


# Joins
@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 150000")
def join_inner(t):
    return t.orders.filter("o_totalprice > 150000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def join_left(t):
    o = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, s_suppkey * 3 AS s_key FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3")
def join_right_full(t):
    return t.customer.join(t.supplier.select((F.col("s_suppkey") * 3).alias("s_key")), F.col("c_custkey") == F.col("s_key"), "full").select("c_custkey", "s_key")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return t.nation.select("n_name").crossJoin(t.region.select("r_name"))  # dimensions of 25 and 5 rows


@query("SELECT p_partkey, w FROM part JOIN (VALUES ('red'), ('blue'), ('STEEL'), ('a')) v(w) ON instr(p_name, w) > 0 OR instr(p_type, w) > 0")
def join_theta_instr(t):
    words = F.array(*map(F.lit, ["red", "blue", "STEEL", "a"]))
    return t.part.select("p_partkey", "p_name", "p_type", F.explode(words).alias("w")).filter("instr(p_name, w) > 0 OR instr(p_type, w) > 0").select("p_partkey", "w")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi(t):
    return t.customer.join(t.orders.filter("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def join_anti(t):
    return t.customer.join(t.orders.filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) GROUP BY c_nationkey")
def scalar_subquery(t):
    mean = t.customer.agg(F.avg("c_acctbal")).scalar()
    return t.customer.filter(F.col("c_acctbal") > mean).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey AS r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_using(t):
    return t.nation.withColumnRenamed("n_regionkey", "r_regionkey").join(t.region, ["r_regionkey"])


@query("SELECT e.event_id, p.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_asof(t):
    """The last other event of the user at or before each error: one sort by user and time."""
    is_error = F.col("event_type") == "error"
    place = F.struct("ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(~is_error, place)).over(w)
    return t.events.withColumn("_last", last).filter(is_error).select("event_id", F.col("_last.event_id").alias("before_id"))


@query("WITH r AS (SELECT (o_orderkey * 7) % 100003 AS lo, (o_orderkey * 7) % 100003 + 5 + o_orderkey % 40 AS hi FROM orders), b AS (SELECT x, sum(d) AS d FROM (SELECT lo AS x, 1 AS d FROM r UNION ALL SELECT hi, -1 FROM r) GROUP BY x) SELECT * FROM (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi, (sum(d) OVER (ORDER BY x))::BIGINT AS n FROM b) WHERE hi IS NOT NULL AND n > 0")
def join_interval_waves(t):
    r = t.orders.selectExpr("(o_orderkey * 7) % 100003 AS lo", "(o_orderkey * 7) % 100003 + 5 + o_orderkey % 40 AS hi")
    return elementary(r, "lo", "hi")


@query("WITH a AS (SELECT o_orderkey AS a_id, o_orderkey * 3 AS alo, o_orderkey * 3 + 1 + o_orderkey % 50 AS ahi FROM orders), b AS (SELECT p_partkey AS b_id, p_partkey * 5 AS blo, p_partkey * 5 + 1 + p_partkey % 30 AS bhi FROM part) SELECT a_id, b_id FROM a JOIN b ON alo < bhi AND blo < ahi")
def join_overlap(t):
    a = t.orders.selectExpr("o_orderkey AS a_id", "o_orderkey * 3 AS alo", "o_orderkey * 3 + 1 + o_orderkey % 50 AS ahi")
    b = t.part.selectExpr("p_partkey AS b_id", "p_partkey * 5 AS blo", "p_partkey * 5 + 1 + p_partkey % 30 AS bhi")
    return overlapping(a, b, "alo", "ahi", "blo", "bhi", 64).select("a_id", "b_id")


# Aggregates
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def agg_pricing(t):
    price = F.col("l_extendedprice")
    return t.lineitem.filter("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(R2(F.sum("l_quantity")).alias("sum_qty"), R2(F.sum(price)).alias("sum_price"), R2(F.sum(price * (1 - F.col("l_discount")))).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'X'), 0), 2) AS none FROM orders GROUP BY o_orderpriority")
def agg_multi_distinct_filter(t):
    x = F.sum(F.when(F.col("o_orderstatus") == "X", F.col("o_totalprice")))
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), R2(F.coalesce(x, F.lit(0.0))).alias("none"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_group_concat(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT p_partkey, greatest(p_size, p_retailprice, 30) AS hi, least(p_size, p_retailprice, 30) AS lo FROM part")
def minmax_scalar(t):
    from ..functions.numbers import largest, smallest

    v = [F.col("p_size"), F.col("p_retailprice"), F.lit(30)]
    return t.part.select("p_partkey", largest(*v).alias("hi"), smallest(*v).alias("lo"))


@query("SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_slow, count(*) FILTER (WHERE value > 200) AS n_long FROM events GROUP BY user_id")
def agg_spans(t):
    return t.events.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_slow"), F.count_if(F.col("value") > 200).alias("n_long"))


@query("SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type")
def agg_first_seen(t):
    return t.events.groupBy("event_type").agg(F.min("event_id").alias("first_id"))


@query("SELECT sig, count(*) AS n, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS members FROM (SELECT c_mktsegment, count(*) % 3 AS sig FROM customer GROUP BY c_mktsegment) GROUP BY sig")
def agg_signature(t):
    each = t.customer.groupBy("c_mktsegment").agg((F.count(F.lit(1)) % 3).alias("sig"))
    return each.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("c_mktsegment")), ",").alias("members"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


# Windows
@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER p, 6) AS pr, round(cume_dist() OVER p, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def win_rank_suite(t):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.ntile(4).over(w).alias("nt"), F.round(F.percent_rank().over(p), 6).alias("pr"), F.round(F.cume_dist().over(p), 6).alias("cd"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, round(avg(o_totalprice) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS a, first_value(o_orderkey) OVER w AS f, count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def win_frame(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", R2(F.sum("o_totalprice").over(w.rowsBetween(-2, 0))).alias("s"), R2(F.avg("o_totalprice").over(w.rowsBetween(-1, 1))).alias("a"), F.first("o_orderkey").over(w).alias("f"), F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("c"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_lag_lead(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("after"))


@query("SELECT conv_id, turn, (sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS floor FROM conversations")
def win_floor_clock(t):
    return logical_clock(t.conversations, "conv_id", "turn", F.col("role") != "user").select("conv_id", "turn", "floor")


@query("SELECT conv_id, turn, 'AM' || CASE WHEN row_number() OVER w < 1000 THEN lpad((row_number() OVER w)::VARCHAR, 4, '0') ELSE (row_number() OVER w)::VARCHAR END AS code, floor((row_number() OVER w - 1) / 3)::BIGINT AS batch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win_codes_batches(t):
    return batches(codes(t.conversations, "conv_id", "turn"), 3, "turn", "conv_id").select("conv_id", "turn", "code", "batch")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) GROUP BY user_id")
def win_latest_per_key(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


# Orders
@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def top_last_rows(t):
    return last_rows(t.conversations, 2, ["turn"], "conv_id").select("conv_id", "turn")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_name, s_suppkey LIMIT 10")
def top_multi_key(t):
    return t.supplier.orderBy(F.desc("s_acctbal"), "s_name", "s_suppkey").limit(10).select("s_suppkey", "s_acctbal")


# Sets
@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).unionAll(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def set_except(t):
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.customer.filter("c_nationkey < 12").select("c_custkey"))


@query("WITH RECURSIVE c(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM c WHERE n < 20) SELECT n::BIGINT AS n, s::BIGINT AS s FROM c")
def cte_recursive(t):
    return t.spark.sql("WITH RECURSIVE c(n, s) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, s + n + 1 FROM c WHERE n < 20) SELECT n, s FROM c")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 500000) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey")
def cte_join(t):
    big = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).filter("total > 500000")
    return big.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("c_name", R2("total").alias("total"))


@query("SELECT 0 AS segment, n_nationkey AS place, n_name AS name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 1, 5, 'merged' UNION ALL SELECT 2, n_nationkey, n_name FROM nation WHERE n_nationkey >= 9")
def splice_rows(t):
    rows = t.nation.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    merged = t.spark.createDataFrame([(5, "merged")], "place int, name string")
    return spliced(rows, "place", 5, 9, merged).select("segment", "place", "name")


# TPC-H-like joins used by the bench
@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_star_revenue(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(R2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))


#: Peer groups of a supplier's rows by quantity.
EXCLUDED = {"a": ("1", "1", "NO OTHERS"), "b": ("1", "0", "CURRENT ROW"), "c": ("2", "1", "GROUP"), "d": ("UNBOUNDED", "1", "TIES")}


FRAMES = {n: f"OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity GROUPS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING EXCLUDE {what})" for n, (lo, hi, what) in EXCLUDED.items()}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"sum(l_linenumber) {f} AS {n}sum, count(l_linenumber) {f} AS {n}count, round(avg(l_linenumber) {f}, 9) AS {n}avg" for n, f in FRAMES.items()) + " FROM lineitem")
def win_groups_exclude(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    framed = {name: (None if lo == "UNBOUNDED" else int(lo), int(hi), what.lower()) for name, (lo, hi, what) in EXCLUDED.items()}
    rows = frames.groups_frames(rows, ["l_suppkey", "l_returnflag"], ["l_quantity"], "l_linenumber", framed)
    return rows.drop("l_suppkey", "l_returnflag", "l_quantity").withColumns({f"{n}avg": F.round(f"{n}avg", 9) for n in EXCLUDED})
