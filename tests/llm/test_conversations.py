"""Conversation repair against every sequence of edits of short conversations, and a fold in Python of long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomtable.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """rows in order -> (blank, duplicate, truncated or none) of each."""
    seen, out = set(), []
    for role, text in rows:
        ends = re.sub(r"[\x20\x09-\x0D]+", "", text)[-1:]
        out.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends not in ".!?" else None)
        seen.add((role, text))
    return out


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}\n{r[2]}".encode()).hexdigest()))


def every_edit(rows):
    """(cost, audit, lines) of the cheapest of all edits, by trying them all."""
    wrong, best = faults(rows), None
    choices = []
    for (role, text), fault in zip(rows, wrong, strict=True):
        extra = 5 if fault == "truncated" else 0
        stay = [] if fault in ("blank", "duplicate") else [(extra, "K", [(role, text)]), (1 + extra, "R", [("user", text)]), (1 + extra, "R", [("assistant", text)])]
        choices.append([*stay, (2, "D", [])])
    gaps = [(5 * n, "I" * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(gaps, *itertools.chain.from_iterable((c, gaps) for c in choices)):
        lines = [x for e in edits for x in e[2]]
        if GOAL.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
            found = (sum(e[0] for e in edits), "".join(e[1] for e in edits), lines)
            best = min(best or found, found, key=lambda x: x[:2])
    return best


def summary(rows):
    """What repair returns for the rows (turn, role, text) of one conversation, but for the edits."""
    rows = ordered(rows)
    turns = [t for t, _, _ in rows if t is not None]
    marks = faults([(r, x) for _, r, x in rows])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs)]


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()


def by_id(df):
    return {r.conv_id: [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256] for r in df.collect()}


@pytest.mark.parametrize("segment_bits", [0, 1, 8])
def test_repair_equals_every_edit(spark, segment_bits):
    rng = random.Random(5)
    texts = ["Fine.", "Good!", "Why? ", "cut off", "", " \t", None, "Fine."]
    convs = {i: [(rng.choice([None, 0, 1, 2, 5]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for _ in range(rng.randrange(1, 4))] for i in [None, *range(120)]}
    rows = [(i, *r) for i, c in convs.items() for r in c]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"c": F.lit("mine"), "seg": F.lit(1), "audit": F.lit("x")})
    got = by_id(conversations.repair(turns, segment_bits=segment_bits))
    for i, c in convs.items():
        cost, audit, lines = every_edit([(r, x) for _, r, x in ordered(c)])
        assert got[i] == [*summary(c), cost, audit, digest(lines)], c


def folded(rows):
    """The same for a long conversation: the cheapest (cost, audit, lines) by state."""
    states = {"": (0, "", ())}
    to = lambda state, initial: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    def put(into, state, move):
        if state is not None:
            into[state] = min(into.get(state, move), move, key=lambda m: m[:2])

    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for state, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    put(out, to(state, role[0]), (cost + 5, audit + "I", (*lines, (role, ""))))
        return out

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        nxt, extra = {}, 5 if fault == "truncated" else 0
        for state, (cost, audit, lines) in inserts(states).items():
            put(nxt, state, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                put(nxt, to(state, role[:1]), (cost + extra, audit + "K", (*lines, (role, text))))
                for other in ("user", "assistant"):
                    put(nxt, to(state, other[0]), (cost + 1 + extra, audit + "R", (*lines, (other, text))))
        states = nxt
    ends = inserts(states)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda m: m[:2])


def test_long_conversations_in_segments(spark):
    rng = random.Random(8)
    convs = {}
    for i in range(6):
        roles = ["system", *("user", "assistant") * 300]
        convs[i] = [(t, r if rng.random() < 0.9 else rng.choice(["user", "assistant", "system", "x"]), rng.choice([f"Text {t}.", f"text {t}", "Same.", ""]) if rng.random() < 0.3 else f"Text {t}!") for t, r in enumerate(roles[: 100 * i + 3])]
    turns = spark.createDataFrame([(i, *r) for i, c in convs.items() for r in c], SCHEMA).repartition(7)
    for bits in (3, 8):
        got = by_id(conversations.repair(turns, segment_bits=bits))
        for i, c in convs.items():
            cost, audit, lines = folded([(r, x) for _, r, x in ordered(c)])
            assert got[i] == [*summary(c), cost, audit, digest(lines)]


def test_damage(spark):
    rows = [(c, t, r, x) for c in [None, *range(40)] for t, r, x in [(None, "system", "One. Two!"), (0, "user", "Three? Four"), (1, None, None), (2, "assistant", "")]]
    want = []
    for c, t, r, x in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if what == 1 else re.sub("[.!?]", "", x) if what == 2 else x
        want += [(c, t, "user" if what == 4 else r, x)] * {0: 0, 3: 2}.get(what, 1)
    got = conversations.damaged(spark.createDataFrame(rows, SCHEMA).withColumn("_what", F.lit(0))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_none_left_and_none_at_all(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(none).count() == 0
    ids = spark.createDataFrame([(None,), (3,)], "conv_id long")
    assert by_id(conversations.repair(none, ids)) == {i: [0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()] for i in (None, 3)}
    far = [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B." * 500_000)]
    assert by_id(conversations.repair(spark.createDataFrame(far, SCHEMA)))[1][1:7] == [0, 0, 0, 0, 0, "KK"]
