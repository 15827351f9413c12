import random
import re

import pytest
from pyspark.sql import functions as F

from loomtable.catalog import Catalog, QueryError, is_read_only
from loomtable.functions import text as T
from loomtable.functions.predicates import keywords
from loomtable.functions import jsons, numbers
from loomtable.operators import changes, logs, migrate, ordered, retrieval, writes
from loomtable.operators.expansion import expand
from loomtable.operators.query import TableQuery
from loomtable.sources import sinks, snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 3), (2, "Bob", None), (3, "ann", 5)], "row_id long, name string, n int")


def test_builder_rules(people):
    q = TableQuery(people)
    assert q.where("n", "!=", None).count() == 2
    assert q.where_like("name", "ANN").count() == 2
    assert q.where_in("n", []).count() == 0 and q.where_not_in("n", []).count() == 3
    assert q.where_between("n", 9, 4).get("name") == "ann"
    assert q.where("n", ">", 99).value_of("sum", "n") == 0
    assert q.where({"name": "Bob", "n": None}).exists()
    assert q.order_by("name").order_by(("row_id", "desc")).limit(1).first()["row_id"] == 3
    with pytest.raises(ValueError):
        q.where("n", "; drop", 1)


def test_keyword_predicate(spark):
    df = spark.createDataFrame([("red Apple",), ("green pear",), (None,)], "t string")
    hits = lambda c: [r[0] for r in df.filter(keywords(F.col("t"), c)).collect()]
    assert hits("APPLE&red,pear&!green") == ["red Apple"]
    assert hits("!(apple,pear)") == [None]
    assert hits("") == ["red Apple", "green pear", None]
    for bad in ("a,,b", "(a", "a)"):
        with pytest.raises(ValueError):
            keywords(F.col("t"), bad)


def test_read_only_gate(spark, people):
    assert is_read_only("select 'drop table x; --' as a") and is_read_only("WITH a AS (SELECT 1) SELECT * FROM a")
    assert not is_read_only("with a as (select 1 x) from a insert into b select *")
    assert not is_read_only(r"with a as (select '\' , ' as x) from a insert into t select x, 'q'")
    assert is_read_only("explain insert into b select 1") and is_read_only("show tables") and not is_read_only("set a=1")
    assert not is_read_only("drop table a") and not is_read_only("select 1; delete from a") and not is_read_only("WITH a AS (SELECT 1) INSERT INTO b SELECT 1")
    c = Catalog(spark)
    c.register("people", people, ("folk",), hidden=("n",))
    assert c.sql("SELECT * FROM folk WHERE name = ?", ["Bob"]).columns == ["row_id", "name"]
    for sql, code in (("SELECT * FROM nowhere_at_all", "table_not_found"), ("SELECT zzz FROM folk", "column_not_resolved"), ("DELETE FROM folk", "read_only_violation"), ("SELECT (1", "sql_error")):
        with pytest.raises(QueryError) as e:
            c.sql(sql).collect()
        assert e.value.code == code
    with pytest.raises(QueryError):
        c.register("others", people, ("folk",))


def test_delta_roundtrip_of_random_tables(spark):
    rng = random.Random(5)
    for _ in range(3):
        a = {rng.randrange(30): rng.choice(["x", "y", None]) for _ in range(20)}
        b = {k: rng.choice(["x", "y", None]) for k in rng.sample(range(30), 15)}
        frame = lambda d: spark.createDataFrame(list(d.items()) or [], "id long, v string")
        d = changes.delta(frame(a), frame(b), "id")
        assert rows(changes.apply_delta(frame(a), d, "id")) == sorted(b.items(), key=str)
        assert d.count() == len(set(a) - set(b)) + sum(k not in a or a[k] != v for k, v in b.items())


def test_budget_passes_over_what_overflows(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([4, 9, 5, 1, 1])], "g string, i int, cost int")
    assert [r.i for r in ordered.within_budget(df, "g", ["i"], "cost", 10, 3).orderBy("i").collect()] == [0, 2, 3]
    assert ordered.within_budget(df.limit(0), "g", ["i"], "cost", 10, 3).count() == 0


def test_expansion(spark):
    entries = [(1, ["fire"], "the dragon", False, True, True), (2, ["dragon"], "gold", False, True, True), (3, ["gold"], "x", False, True, False), (4, [], "y", True, False, True), (5, ["absent"], "z", False, True, True)]
    df = spark.createDataFrame(entries, "entry_id long, keywords array<string>, content string, constant boolean, passes_on boolean, can_follow boolean")
    assert rows(expand(df, "Fire!")) == [(1, 1), (2, 2), (4, 0)]


def test_null_and_unstable_keys_in_deltas(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b")], "id long, v string")
    assert changes.delta(df, df, "id").count() == 0
    d = changes.delta(df, df.withColumn("v", F.lit("c")), "id")
    assert rows(changes.apply_delta(df, d, "id")) == [(1, "c"), (None, "c")]
    fine = df.filter("id = 1")
    assert changes.delta_fault(None, df, "id") == "no_base" and changes.delta_fault(fine, fine, "id") is None
    assert changes.delta_fault(fine, fine.withColumn("w", F.lit(1)), "id") == "columns_changed"
    assert changes.delta_fault(fine, fine.union(fine), "id") == changes.delta_fault(df, fine, "id") == "unstable_ids"


def test_inserts_and_replaces_by_key(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, v string, n int")
    new = lambda *ids: spark.createDataFrame([(i, f"new {k}", k) for k, i in enumerate(ids)], "id long, v string, seq int")
    for kind, ids in (("insert", (1,)), ("insert", (3, 3)), ("replace", (3, 3))):
        with pytest.raises(ValueError):
            writes.mutated(df, kind, rows=new(*ids).drop("seq"), key="id")
    table, n = writes.mutated(df, "insert", rows=new(3).drop("seq"), key="id", defaults={"n": F.lit(9)})
    assert rows(table) == [(1, "a", 1), (2, "b", 2), (3, "new 0", 9)] and n.first()[0] == 1
    table, n = writes.mutated(df, "replace", rows=new(2, 3, 2), key="id", order=["seq"])
    assert rows(table) == [(1, "a", 1), (2, "new 2", None), (3, "new 1", None)] and n.first()[0] == 2


def test_division_by_a_zero_column_is_null(spark):
    df = spark.createDataFrame([(0, 7), (2, 7), (None, 7)], "a int, b int")
    assert [r.x for r in df.select("a", numbers.calculated("(b + 1) / a").alias("x")).orderBy("a").collect()] == [None, None, 4]
    assert [r.x for r in df.select(numbers.calculated("-b % 4 * 2.5").alias("x")).limit(1).collect()] == [-8]
    for wrong in ("b / 0", "b ** 2", "b +", "f(b)"):
        with pytest.raises(ValueError):
            numbers.calculated(wrong)


def test_fingerprints_tell_nulls_and_names(spark):
    mark = lambda rows, schema: logs.fingerprint(spark.createDataFrame(rows, schema)).first()["mark"]
    assert len({mark([(1, None)], "a int, b string"), mark([(1, "\0")], "a int, b string"), mark([(1, "")], "a int, b string"), mark([(1, "")], "a int, c string")}) == 4
    assert mark([(1, "x"), (2, "y")], "a int, b string") == mark([("y", 2), ("x", 1)], "b string, a int")


def test_last_edit_by_place_wins_and_keys_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    edits = spark.createDataFrame([(0, "v", "zz", 1), (0, "v", "aa", 2), (1, "id", "7", 3)], "place long, column string, value string, seq int")
    table, refused = writes.at_places(df, ["id"], "id", edits)
    assert rows(table) == [(1, "aa"), (2, "b")] and rows(refused) == [(1, "id", "7")]


def test_bm25_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert retrieval.bm25(docs, ["a b"]).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a a b")], "doc_id long, text string")
    assert [r.doc_id for r in retrieval.bm25(docs, ["b", "zzz"]).collect()] == [3]


def test_migration_plans(spark):
    a = spark.createDataFrame([(1, "x")], "id long, n string")
    p = migrate.plan(a.schema, spark.createDataFrame([], "id long, n long").schema)
    assert p.decision == "auto_apply" and rows(migrate.lossy(a, p)) == [("n", 1)]
    p = migrate.plan(a.schema, spark.createDataFrame([], "id long").schema)
    assert p.decision == "needs_choice"
    with pytest.raises(ValueError):
        migrate.migrate(a, p, spark.createDataFrame([], "id long").schema)


def test_text_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("一。b!c",)], "t string")
    made = df.select(F.size(T.tokens(F.col("t"))), T.sentences(F.col("t")), T.token_estimate(F.col("t")), F.size(T.slices(F.coalesce("t", F.lit("")), 2))).collect()
    assert [tuple(r) for r in made] == [(0, [], 0, 0), (0, [], 0, 0), (0, [], 0, 1), (3, ["一。", "b!", "c"], 4, 3)]


def test_overlap_is_brute_force(spark):
    rng = random.Random(3)
    a = [(i, (s := rng.randrange(200)), s + rng.randrange(1, 60)) for i in range(40)]
    b = [(i, (s := rng.randrange(200)), s + rng.randrange(1, 60)) for i in range(40)]
    got = ordered.overlapping(spark.createDataFrame(a, "x int, alo int, ahi int"), spark.createDataFrame(b, "y int, blo int, bhi int"), "alo", "ahi", "blo", "bhi", 16).select("x", "y")
    assert rows(got) == sorted([(i, j) for i, s, e in a for j, p, q in b if s < q and p < e], key=str)


def test_writes_refuse(people):
    with pytest.raises(ValueError):
        writes.mutated(people, "drop")
    with pytest.raises(ValueError):
        writes.mutated(people, "update", None, {"n": F.lit(1)}, hidden=("n",))
    with pytest.raises(ValueError):
        writes.mutated(people, "update", None, {"zzz": F.lit(1)})
    table, n = writes.mutated(people, "update", F.col("n") > 1, {"name": F.lit("x")})
    assert rows(table) == [(1, "x", 3), (2, "Bob", None), (3, "x", 5)] and n.first()["affected"] == 2  # a null condition touches nothing
    with pytest.raises(ValueError):
        writes.content_patch(people, ["row_id"], [(0, "name", "x")], [], [])
    with pytest.raises(ValueError):
        writes.schema_patch(people, {}, [], {"name": "string"})


def test_rows_by_place_refuse_what_is_not_there(spark, people):
    edits = spark.createDataFrame([(0, "name", "x"), (9, "name", "y"), (1, "zzz", "z"), (2, None, None)], "place long, column string, value string")
    table, refused = writes.at_places(people, ["row_id"], "row_id", edits)
    assert rows(table) == [(1, "x", 3), (2, "Bob", None)]
    assert rows(refused) == [(1, "zzz", "z"), (9, "name", "y")]


def test_strict_edits_need_one_row(spark, people):
    wanted = spark.createDataFrame([(1, {"name": "Bob"}), (2, {"name": "Ann", "n": "5"}), (3, {"name": "none"})], "op int, where map<string,string>")
    twice = people.unionByName(people.filter("row_id = 2").withColumn("row_id", F.lit(7).cast("long")))
    assert rows(writes.strict_matches(people, "row_id", wanted)) == [(1, 1, 2), (2, 0, None), (3, 0, None)]
    assert rows(writes.strict_matches(twice, "row_id", wanted))[0] == (1, 2, None)


def test_log_chain(spark):
    none = spark.createDataFrame([], "s string, seq int, revision string")
    entries = spark.createDataFrame([("a", 5), ("a", 6), ("b", 1)], "s string, e int")
    log = logs.appended(none, entries, "s", "e", "e")
    assert [(r.revision, r.parent) for r in log.orderBy("s", "seq").collect()] == [("1:5", None), ("2:6", "1:5"), ("1:1", None)]
    assert logs.chain_faults(log, "s").count() == 0
    assert logs.chain_faults(log.withColumn("parent", F.lit("x")), "s").count() == 1


def test_elementary_is_brute_force(spark):
    rng = random.Random(9)
    ranges = [((s := rng.randrange(300)), s + rng.randrange(1, 40)) for _ in range(120)]
    cuts = sorted({x for r in ranges for x in r})
    want = [(a, b, n) for a, b in zip(cuts, cuts[1:], strict=False) if (n := sum(lo <= a and b <= hi for lo, hi in ranges))]
    got = ordered.elementary(spark.createDataFrame(ranges, "lo int, hi int"), "lo", "hi")
    assert sorted(map(tuple, got.collect())) == want


def test_codes_keep_their_digits(spark):
    df = spark.range(10_001).withColumn("s", F.lit("a"))
    codes = [r.code for r in ordered.codes(df, "s", "id").collect()]
    assert len(set(codes)) == 10_001 and {"AM0001", "AM9999", "AM10000", "AM10001"} <= set(codes)


def test_budget_is_brute_force(spark):
    rng = random.Random(10)
    items = [(rng.choice("ab"), i, rng.choice([0, 1, 2, 3, 5, 40])) for i in range(300)]
    want = []
    for g in "ab":
        used = taken = 0
        for s, i, c in items:
            if s == g and taken < 9 and used + c <= 17:
                used, taken = used + c, taken + 1
                want.append((s, i, c))
    df = spark.createDataFrame(items, "g string, i int, cost int")
    assert rows(ordered.within_budget(df, "g", ["i"], "cost", 17, 9)) == sorted(want, key=str)


def test_input_hash(spark):
    """Against shifts as a 32-bit machine has them."""
    import ctypes

    def machine(text):
        h = 2166136261
        for c in text:
            h = ctypes.c_int32(h).value ^ ord(c)
            h = h + ctypes.c_int32(h << 1).value + ctypes.c_int32(h << 4).value + ctypes.c_int32(h << 7).value + ctypes.c_int32(h << 8).value + ctypes.c_int32(h << 24).value
        return h

    df = spark.createDataFrame([("abc",), (" a\r\nb ",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.input_hash("t")).collect()]
    assert [int(x, 36) for x in got[:2]] == [machine("abc"), machine("a\nb")] and got[2:] == ["", ""]


def test_loose_objects():
    assert jsons.loose_object('{"a": 1, b: "x", "c,d", {"e": [1]}, 7: 2, 3}') == {"a": "1", "b": "x", "0": "c,d", "1": '{"e": [1]}', "7": "2", "8": "3"}
    assert jsons.loose_object("{}") == {} and jsons.loose_object("[1]") is None and jsons.loose_object("{a: }") is None and jsons.loose_object(None) is None
    assert jsons.segments('a, "b,c", [1, {2, 3}], ') == ["a", '"b,c"', "[1, {2, 3}]"]


def test_catalog_columns(spark, people):
    c = Catalog(spark, "cols_")
    c.register("people", people, ("folk",), column_aliases={"name": ("Name", "who")})
    assert c.column("folk", "who") == "name" and c.listing() == [("people", ("folk",), 3)]
    with pytest.raises(QueryError):
        c.column("people", "zzz")
    with pytest.raises(QueryError):
        c.register("others", people, column_aliases={"name": ("x",), "n": ("x",)})
    assert c.header_faults("people", ["row_id", "who", "n"]) == [] and c.header_faults("people", ["n", "row_id", "zzz"]) == [("unknown", "zzz"), ("missing", "name"), ("order", "n")]
    assert c.in_scope({"people": ["row_id", "who"], "gone": []}).frame("people").columns == ["row_id", "name"]


def test_unfinished_versions_are_not_read(spark, people, tmp_path):
    folder = f"file://{tmp_path}/v"
    snapshots.publish(people, folder, 1)
    people.limit(1).write.parquet(f"{folder}/version=2")  # no pointer yet
    assert snapshots.current(spark, folder).count() == 3


def test_sheets_that_do_not_fit_become_strings(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    text = spark.createDataFrame([('{"sheet_a": {"name": "x", "content": [["n", "s"], ["1", "a"], ["two", null]]}, "mate": 1}',), ("{",), (None,)], "t string")
    cells = snapshots.cells_of(snapshots.sheets_of(text, "t"))
    schema = StructType([StructField("n", LongType()), StructField("s", StringType())])
    assert rows(snapshots.load_sheet(cells, schema)) == [("1", "a"), ("two", None)]
    assert snapshots.load_sheet(cells.filter("row = 1"), schema).dtypes == [("n", "bigint"), ("s", "string")]


def test_free_slot_wraps(spark):
    used = spark.createDataFrame([(x,) for x in (1, 2, 4, 8, 9, 10)], "x int")
    slot = lambda **how: sinks.free_slot(used, "x", **how).first()["slot"]
    assert slot(low=1, high=10) == 3 and slot(preferred=8, low=1, high=10) == 3 and slot(size=3, low=1, high=10) == 5 and slot(size=4, low=1, high=10) is None


def brute_span(target, text):
    """Every start and length in turn."""
    if target in text:
        return 1.0
    sign = r"[^一-龥a-zA-Z0-9]"
    want, plain = re.sub(sign, "", target), re.sub(sign, "", text)
    n, keys, best = max(3, min(10, len(want) // 4)), [], 0.0
    for size in (4, 3, 2):
        for i in range(len(want) - size + 1):
            keys += [want[i : i + size]] if want[i : i + size] not in keys and len(keys) < 5 else []
    for i in range(len(plain)) if len(want) >= 10 else ():
        for size in range(len(want) // 2, len(want) * 3 // 2 + 1) if plain.startswith(want[:n], i) else ():
            span = plain[i : i + size]
            if len(span) == size and span.endswith(want[-n:]):
                score = sum(k in span for k in keys) / len(keys)
                best = score if score >= 0.4 and score > best else best
    return best


def test_fuzzy_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, said(rng.randint(2, 40) if i % 3 else 5)) for i in range(15)] + [(None, said(12)), (99, "one"), (98, None), (97, ""), (3, said(9)), (96, "你好世界，这是一个测试的段落。今天天气很好")]
    docs = [(100, None), (101, ""), (102, "你好世界这是一个测试的段落 今天天气很好啊"), (102, "其他")]
    for i in range(150):
        w = rng.choice([x for _, x in items if x and " " in x]).split()
        for _ in range(rng.randint(0, 4)):  # edits within
            w[rng.randrange(len(w))] = rng.choice(words)
        part = rng.choice([" ", ", ", "\n"]).join(w)
        part = part[:7] + rng.choice(["", "x", "xyz"]) + part[7:]  # within the keywords, past a short prefix
        docs.append((rng.choice([i, i, i, None, 7]), f"{said(rng.randint(0, 60))} {part} {said(rng.randint(0, 60))}"))
    docs += docs[-2:]

    def pairs(x):
        t = []
        for run in re.findall(r"[a-z0-9_]+|[㐀-鿿]+", (x or "").lower()):
            t += [run] if run[0].isascii() else [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
        return set(zip(t, t[1:], strict=False))

    want = []
    for d, text in docs:
        for i, item in items:
            p = pairs(item)
            if p and len(p & pairs(text)) >= 0.4 * len(p) - 1e-9 and (score := brute_span(item, text)):
                want.append((str(d), str(i), round(score, 6)))
    a = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(str(r.doc_id), str(r.item_id), round(r.score, 6)) for r in retrieval.fuzzy_pairs(a, b).collect()]
    assert sorted(got) == sorted(want)
    assert len({s for _, _, s in want}) > 2 and any(i == "96" for _, i, _ in want)
    assert retrieval.fuzzy_pairs(a.limit(0), b).count() == retrieval.fuzzy_pairs(a, b.limit(0)).count() == 0


def test_strict_edits_count_rows_and_take_nulls(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, "x", 2), (3, None, 3), (None, "y", 4)], "row_id long, name string, n int")
    wanted = spark.createDataFrame([(1, {"name": "x", "n": "1"}), (2, {"name": "x", "n": "2"}), (3, {"n": "3", "name": None}), (4, {}), (5, None), (6, {"zzz": "1"}), (7, {"name": "y"}), (8, {"name": "x"})], "op int, where map<string,string>")
    got = {r.op: (r.n_rows, r.row_id) for r in writes.strict_matches(df, "row_id", wanted).collect()}
    assert got == {1: (2, None), 2: (1, 2), 3: (0, None), 4: (0, None), 5: (0, None), 6: (0, None), 7: (1, None), 8: (3, None)}
