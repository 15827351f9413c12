r"""Conversation structure repair: faults by window, the cheapest edits by a fold in Spark SQL.

The rows of a conversation in order of turn (nulls first, then by the digest of role and text)
should have the role initials `(s?(ua)+)?`. Edits are Keep (0), Rerole to user or assistant (1),
Delete (2; blank rows and rows whose role and text were seen earlier must go) and Insert of an
empty user or assistant turn anywhere (5); a truncated row that stays costs 5 more. Of the
cheapest edits those whose audit (initials of the edits in order) is least by ASCII are taken.

The initials end in one of four states: nothing yet, after s, after u, after a. What a Rerole or
an Insert makes follows from the state, so an audit fixes the result, and a fold carries one
(cost, audit) struct for each state: `aggregate()` over the sorted turn structs, `least` of what
leads to a state. Two audits of one state and cost are never each other's beginning (they would
differ by Inserts, which cost), so the least one stays the least whatever follows.

A conversation of any length is folded in segments: rows are range-sorted and written with their
places, `1 << segment_bits` places are a segment. A segment is folded from all four states (the
first of a conversation from the first state alone), which gives a table of 4 by 4 structs, and
a second fold joins the tables of a conversation's segments and says with which state and part
of the audit each segment goes. The turns of a segment are then edited where they are. Equal
turns are found by a grouping on digests and a join, not in the conversation's own task. What
belongs to one conversation as a whole, its audit and the hash over its text, is made by one
task: the audit is a string, the hash reads segment after segment and keeps nothing.

Results of the odd cases: a null id is a conversation, a null role or text is one space (so the
row is blank), null turns come first and count neither for gaps nor for order, a blank role has
no initial and fits nowhere; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table
from .merkle import CRC_SQL, crc_sql

SEGMENT_BITS = 8
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: By state: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
MOVE = "struct<cost:bigint,audit:string>"
NO_BLANKS = r"[^\x20\x09-\x0D]"
LINES = "array<struct<role:string,text:string>>"


def _plus(move: Column, cost: Column | int, letter: str) -> Column:
    return F.when(move.isNotNull(), F.struct((move["cost"] + cost).cast("long").alias("cost"), F.concat(move["audit"], F.lit(letter)).alias("audit")))


def _turn(states: Column, turn: Column) -> Column:
    """The four states' best moves after one more turn (initial, fault), Inserts before it."""
    s0, s1, s2, s3 = (states[f"s{k}"] for k in range(4))
    into_u = F.least(s2, _plus(s0, INSERT, "I"), _plus(s1, INSERT, "I"), _plus(s3, INSERT, "I"))
    into_a = F.least(s3, _plus(into_u, INSERT, "I"))
    stays = turn["fault"] == 3
    extra = F.when(stays, F.lit(TRUNCATED)).otherwise(F.lit(0))
    may = turn["fault"].isin(0, 3)
    keep = lambda move, role: F.when(may & (turn["initial"] == role), _plus(move, extra, "K"))
    rerole = lambda move: F.when(may, _plus(move, extra + REROLE, "R"))
    ahead_of_u = F.least(s0, s1, into_a)
    return F.struct(
        _plus(s0, DELETE, "D").alias("s0"),
        F.least(_plus(s1, DELETE, "D"), keep(s0, "s")).alias("s1"),
        F.least(_plus(into_u, DELETE, "D"), keep(ahead_of_u, "u"), rerole(ahead_of_u)).alias("s2"),
        F.least(_plus(into_a, DELETE, "D"), keep(into_u, "a"), rerole(into_u)).alias("s3"),
    )


def _moves(turns: Column, start: Column) -> Column:
    """From a state, over sorted turns: the best (cost, audit) into each of the four."""
    begin = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    zero = F.struct(*[F.when(start == k, begin).cast(MOVE).alias(f"s{k}") for k in range(4)])
    return F.aggregate(turns, zero, _turn, lambda s: F.array(s["s0"], s["s1"], s["s2"], s["s3"]))


def _joined(segments: Column) -> Column:
    """(cost, parts) of the cheapest way through a conversation's segments; a part is the
    audit of a segment and the state it begins in."""
    kind = "struct<cost:bigint,parts:array<struct<audit:string,begins:int>>>"

    def step(states: Column, segment: Column) -> Column:
        def into(q: int) -> Column:
            ways = []
            for p in range(4):
                best = segment["moves"][p][q]
                part = F.array(F.struct(best["audit"].alias("audit"), F.lit(p).alias("begins")))
                ways.append(F.when(states[f"s{p}"].isNotNull() & best.isNotNull(), F.struct((states[f"s{p}"]["cost"] + best["cost"]).alias("cost"), F.concat(states[f"s{p}"]["parts"], part).alias("parts"))))
            return F.least(*ways)

        return F.struct(*[into(q).alias(f"s{q}") for q in range(4)])

    nothing = F.expr("named_struct('cost', 0L, 'parts', cast(array() as array<struct<audit:string,begins:int>>))").cast(kind)
    zero = F.struct(nothing.alias("s0"), *[F.lit(None).cast(kind).alias(f"s{k}") for k in (1, 2, 3)])

    def end(states: Column) -> Column:
        def more(move: Column, letters: str) -> Column:
            last = F.element_at(move["parts"], -1)
            parts = F.concat(F.slice(move["parts"], F.lit(1), F.size(move["parts"]) - 1), F.array(F.struct(F.concat(last["audit"], F.lit(letters)).alias("audit"), last["begins"].alias("begins"))))
            return F.when(move.isNotNull(), F.struct((move["cost"] + len(letters) * INSERT).alias("cost"), parts.alias("parts")))

        return F.least(states["s0"], states["s3"], more(states["s2"], "I"), more(states["s1"], "II"))

    return F.aggregate(segments, zero, step, end)


def _lines(turns: Column, part: Column) -> Column:
    """The turns (role, text, initial) of a segment after the edits of its part."""
    marks = F.regexp_extract_all(part["audit"], F.lit("(I*[DKR])"), F.lit(1))
    tail = F.length(F.regexp_extract(part["audit"], "(I*)$", 1))
    role_at = lambda state: F.when(state == AFTER_U, F.lit("assistant")).otherwise(F.lit("user"))
    after = lambda state: F.when(state == AFTER_U, F.lit(AFTER_A)).otherwise(F.lit(AFTER_U))
    line = lambda role, text: F.array(F.struct(role.alias("role"), text.alias("text")))
    none = F.array().cast(LINES)

    def inserted(state: Column, n: Column) -> Column:
        one, two = line(role_at(state), F.lit("")), line(role_at(after(state)), F.lit(""))
        return F.when(n == 0, none).when(n == 1, one).otherwise(F.concat(one, two))

    def moved(state: Column, n: Column) -> Column:
        return F.when(n == 0, state).when(n == 1, after(state)).otherwise(after(after(state)))

    def step(acc: Column, x: Column) -> Column:
        n, letter = F.length(x["mark"]) - 1, F.right(x["mark"], F.lit(1))
        state = moved(acc["state"], n)
        own = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
        kept = F.lit(START)
        for initial, to in own.items():
            kept = F.when(x["turn"]["initial"] == initial, F.lit(to)).otherwise(kept)
        mine = F.when(letter == "K", line(x["turn"]["role"], x["turn"]["text"])).when(letter == "R", line(role_at(state), x["turn"]["text"])).otherwise(none)
        to = F.when(letter == "K", kept).when(letter == "R", after(state)).otherwise(state)
        return F.struct(to.alias("state"), F.concat(acc["lines"], inserted(acc["state"], n), mine).alias("lines"))

    both = F.zip_with(turns, marks, lambda t, m: F.struct(t.alias("turn"), m.alias("mark")))
    return F.aggregate(both, F.struct(part["begins"].alias("state"), none.alias("lines")), step, lambda acc: F.concat(acc["lines"], inserted(acc["state"], tail)))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(`conv_id:turn`) % 20 names: 0 drops
    a row, 1 empties its text, 2 takes the text's [.!?], 3 repeats it, 4 makes its role user."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", what.alias("_what"), shown("role").alias("role"), shown("text").alias("text")).filter("_what <> 0")
    text = F.when(F.col("_what") == 1, "").when(F.col("_what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_what") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def placed(turns: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """The rows sorted and written, with place and seg (global, ascending), the conversation's
    key c, digest, initial and what a row alone tells of faults."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    last = F.regexp_extract("text", rf"({NO_BLANKS})[\x20\x09-\x0D]*\z", 1)
    rows = rows.withColumns({"digest": F.sha2(F.concat("role", F.lit("\n"), "text").cast("binary"), 256), "initial": F.left("role", F.lit(1)), "_last": last, "_row": F.monotonically_increasing_id()})
    rows = rows.withColumns({"is_blank": F.col("_last") == "", "is_cut": ~F.col("_last").isin(".", "!", "?")}).drop("_last")
    order = ["c", F.col("turn").asc_nulls_first(), "digest", "_row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("place", F.monotonically_increasing_id())
    return staged(rows.withColumn("seg", F.shiftright("place", segment_bits)), "turns-placed")


def faults(rows: DataFrame) -> DataFrame:
    """c, seg, place, initial, before (initial of the row before in the segment), fault of
    placed rows: 0 none, 1 blank, 2 duplicate, 3 truncated; the first that holds."""
    facts = rows.select("c", "seg", "place", "initial", "is_blank", "is_cut", "digest")
    first = facts.groupBy("c", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    facts = facts.join(first, ["c", "digest"], "left")
    fault = F.when(F.col("is_blank"), 1).when(F.coalesce(F.col("place") > F.col("first"), F.lit(False)), 2).when(F.col("is_cut"), 3).otherwise(0)
    before = F.lag("initial").over(Window.partitionBy("c", "seg").orderBy("place"))
    return facts.select("c", "seg", "place", "initial", before.alias("before"), fault.alias("fault"))


def _illegal(before: Column, initial: Column) -> Column:
    return F.when(before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au"), 1).otherwise(0)


def judged(rows: DataFrame) -> DataFrame:
    """c, blank, duplicate, truncated, illegal, cost, parts (seg, audit, begins) of every
    conversation of placed rows."""
    begins = rows.groupBy("c").agg(F.min("seg").alias("first_seg"))
    turns = F.sort_array(F.collect_list(F.struct("place", "initial", "fault")))
    counts = [F.sum(F.when(F.col("fault") == k, 1).otherwise(0)).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    segments = faults(rows).groupBy("c", "seg").agg(turns.alias("turns"), *counts, F.sum(_illegal(F.col("before"), F.col("initial"))).alias("illegal"))
    segments = segments.join(begins, "c")
    only = F.array(F.lit(START))
    starts = F.when(F.col("seg") == F.col("first_seg"), only).otherwise(F.array(*[F.lit(k) for k in range(4)]))
    moves = F.transform(starts, lambda p: _moves(F.col("turns"), p))
    nothing = F.array_repeat(F.array_repeat(F.lit(None).cast(MOVE), F.lit(4)), F.lit(3))
    moves = F.when(F.size(starts) == 1, F.concat(moves, nothing)).otherwise(moves)
    ends = [F.col("turns")[0]["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last")]
    found = segments.select("c", "seg", *ends, moves.alias("moves"), "blank", "duplicate", "truncated", "illegal")
    summed = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal")]
    of = found.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("seg", "first", "last", F.col("moves")))).alias("segs"), *summed)
    n = F.size("segs")
    between = F.zip_with(F.slice("segs", F.lit(1), n - 1), F.slice("segs", F.lit(2), n - 1), lambda a, b: _illegal(a["last"], b["first"]))
    of = of.withColumns({"_best": _joined(F.col("segs")), "illegal": F.col("illegal") + F.aggregate(between, F.lit(0), lambda a, x: a + x)})
    parts = F.zip_with("segs", "_best.parts", lambda s, p: F.struct(s["seg"].alias("seg"), p["audit"].alias("audit"), p["begins"].alias("begins")))
    return staged(of.select("c", "blank", "duplicate", "truncated", "illegal", F.col("_best.cost").alias("cost"), parts.alias("parts")), "turns-judged")


def repaired(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """c, seg, lines (role, text): the conversations after the edits, segment by segment."""
    parts = verdicts.select("c", F.explode("parts").alias("part")).select("c", F.col("part.seg").alias("seg"), "part")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("place", "role", "text", "initial"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["initial"].alias("initial")))
    held = rows.groupBy("c", "seg").agg(turns.alias("turns")).join(parts, ["c", "seg"])
    return held.select("c", "seg", _lines(F.col("turns"), F.col("part")).alias("lines"))


def hashes(lines: DataFrame) -> DataFrame:
    """c, repaired_sha256: the hash over a conversation's `role:text` lines, joined by newlines,
    taken segment after segment from sorted rows."""
    piece = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    sorted_ = lines.filter(F.size("lines") > 0).select("c", "seg", piece.alias("piece")).repartition("c").sortWithinPartitions("c", "seg").select("c", "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sha = None
        for batch in batches:
            done = []
            for key, piece in zip(batch["c"], batch["piece"], strict=True):
                if sha is not None and key == c:
                    sha.update(b"\n")
                else:
                    if sha is not None:
                        done.append((c, sha.hexdigest()))
                    c, sha = key, hashlib.sha256()
                sha.update(piece.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(done, columns=["c", "repaired_sha256"])
        if sha is not None:
            yield pd.DataFrame([(c, sha.hexdigest())], columns=["c", "repaired_sha256"])

    return sorted_.mapInPandas(run, "c string, repaired_sha256 string")


def repair(turns: DataFrame, ids: DataFrame | None = None, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every
    conversation in turns, or in ids (those without rows get zeros)."""
    ids = (turns if ids is None else ids).select("conv_id").distinct().withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = placed(turns, segment_bits)
    wide = lambda x: x.cast("decimal(38,0)")
    span = rows.groupBy("c").agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")).try_cast("long").alias("gaps"))
    verdicts = judged(rows)
    audit = F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit")
    found = verdicts.select("c", "blank", "duplicate", "truncated", "illegal", "cost", audit)
    out = ids.join(span, "c", "left").join(found, "c", "left").join(hashes(repaired(rows, verdicts)), "c", "left")
    zeros = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(turns), turns)


def _more(state: str, cost: str, letter: str, line: str) -> str:
    line = f"chr(10) || {line}" if line else "''"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


def _after_sql(nth: str) -> str:
    """The four states after a row, of those before it, in whole conversations."""
    stay = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
    return {
        "s0": _more("s0", "2", "D", ""),
        "s1": f"least({_more('s1', '2', 'D', '')}, CASE WHEN ini = 's' AND fault IN (0, 3) THEN {_more('s0', stay, 'K', 'own')} END)",
        "s2": f"least({_more('iu', '2', 'D', '')}, CASE WHEN ini = 'u' AND fault IN (0, 3) THEN {_more('xu', stay, 'K', 'own')} END, CASE WHEN fault IN (0, 3) THEN {_more('xu', '1 + ' + stay, 'R', chr(39) + 'user:' + chr(39) + ' || text')} END)",
        "s3": f"least({_more('ia', '2', 'D', '')}, CASE WHEN ini = 'a' AND fault IN (0, 3) THEN {_more('iu', stay, 'K', 'own')} END, CASE WHEN fault IN (0, 3) THEN {_more('iu', '1 + ' + stay, 'R', chr(39) + 'assistant:' + chr(39) + ' || text')} END)",
    }[nth]


_USER, _ASSISTANT = "'user:'", "'assistant:'"
#: The fold row by row over whole conversations, the repaired text beside cost and audit.
OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
v AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS what FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(10) || text), copy) AS n FROM d),
f AS (SELECT *, left(role, 1) AS ini, role || ':' || text AS own, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ends, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS ini_before FROM o),
r AS (SELECT *, CASE WHEN ends = '' THEN 1 WHEN seen > 1 THEN 2 WHEN ends NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
      count(*) FILTER (WHERE ini_before IS NOT NULL AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM r GROUP BY conv_id),
st AS (SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3 FROM k
  UNION ALL SELECT conv_id, n, {_after_sql("s0")}, {_after_sql("s1")}, {_after_sql("s2")}, {_after_sql("s3")}
  FROM (SELECT *, least(s0, s1, ia) AS xu FROM (SELECT *, least(s3, {_more("iu", "5", "I", _ASSISTANT)}) AS ia FROM (
    SELECT st.conv_id, r.n, s0, s1, s2, s3, r.ini, r.fault, r.own, r.text, least(s2, {_more("s0", "5", "I", _USER)}, {_more("s1", "5", "I", _USER)}, {_more("s3", "5", "I", _USER)}) AS iu
    FROM st JOIN r ON r.conv_id IS NOT DISTINCT FROM st.conv_id AND r.n = st.n + 1)))),
e AS (SELECT st.conv_id, least(s0, s3, {_more("s2", "5", "I", _ASSISTANT)}, {_more("s1", "10", "II", "'user:' || chr(10) || 'assistant:'")}) AS best FROM st JOIN k ON k.conv_id IS NOT DISTINCT FROM st.conv_id AND k.rows = st.n)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""
