"""Containment of keywords, and the expansion that rests on it, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomtable.operators.containment import contained
from loomtable.operators.expansion import expand


@pytest.mark.parametrize("signs", [1_000_000, 60, 1])
def test_contained_equals_every_pair(spark, signs):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcÄ字") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = {i: None if i == 3 else "" if i == 4 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for i in range(40)}
    texts[41] = "heart two words\nSweetHearts " + "x" * 50_000 + "the end"
    keywords = [*words, *(w[:-1] for w in words[:20]), "heart", "two words", "hearts xx", "The End", " ", "", None, "words\nsweet", words[0]]
    df = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("keyword", F.lit("mine"))
    got = contained(df, "id", "text", spark.createDataFrame([(k,) for k in keywords], "keyword string"), signs)
    want = {(i, k.lower()) for i, t in texts.items() for k in keywords if t and k and k.strip() and k.lower() in t.lower()}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert contained(df, "id", "text", spark.createDataFrame([], "keyword string"), signs).count() == 0
    assert contained(df.limit(0), "id", "text", spark.createDataFrame([("a",)], "keyword string"), signs).count() == 0


def plain(entries, scan, rounds, constants_are_read):
    fired = {e[0]: 0 for e in entries if e[3]}
    base = scan.lower()
    read = ["" if e[2] is None else e[2].lower() for e in entries if e[3] and e[4]]
    holds = lambda e, texts: any(k and k.strip() and any(k.lower() in t for t in texts) for k in e[1])
    for nth in range(1, rounds + 1):
        heard = [(e[2] or "").lower() for e in entries if e[0] in fired and e[4]]
        new = [e[0] for e in entries if e[0] not in fired and holds(e, [base, *heard] if e[5] else [base, *(read if constants_are_read else [])])]
        if not new:
            break
        fired |= {i: nth for i in new}
    return fired


@pytest.mark.parametrize("constants_are_read", [False, True])
def test_expansion_equals_plain_rounds(spark, constants_are_read):
    rng = random.Random(6)
    words = [f"w{a}{b}" for a in "abcdef" for b in "xyz"]
    entries = [(i, [rng.choice([*words, f"{rng.choice(words)} {rng.choice(words)}", " ", "wa"]) for _ in range(rng.randrange(3))], rng.choice([None, " ".join(rng.choice(words) for _ in range(4))]), rng.random() < 0.1, rng.random() < 0.8, rng.random() < 0.7) for i in range(60)]
    entries.append((99, ["heart"], "x", False, True, False))
    df = spark.createDataFrame(entries, "entry_id long, keywords array<string>, content string, constant boolean, passes_on boolean, can_follow boolean")
    for rounds in (2, 10):
        got = {r.entry_id: r.round for r in expand(df, "Sweethearts WAX way", rounds, constants_are_read).collect()}
        assert got == plain(entries, "Sweethearts WAX way", rounds, constants_are_read) and got[99] == 1
