"""The operators of loomtable.llm against SQL, brute force and exact round trips."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from loomtable.llm import bag_minhash, byte_bpe, decontaminate, html_extract, license_scan, line_dedup, quality_rules, registry, token_ids, url_filter, warc

P = pytest.importorskip("public_tokenizers")
ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "Same words " * 30), (5, "Same words " * 30), (6, "long " * 40_000), (None, "no id here"), (7, "Same words " * 30), (8, "emoji 🙂 and\ttab\r\nline")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns named like results."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"n_tokens": F.lit("mine"), "license": F.lit(1), "n_lines": F.lit(2), "kept": F.lit(3), "score": F.lit(4)})


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_line_dedup_odd(odd, spark):
    out = line_dedup.dedup(odd)
    assert out.count() == len(ODD) and "kept" in out.columns
    assert line_dedup.dedup(odd.limit(0)).count() == 0
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(12))
    two = spark.createDataFrame([(1, f"aa\nbb\n{passage}\ncc"), (2, f"other start\n{passage}\nend")], "doc_id long, text string")
    gone = {r.doc_id: r.n_removed_lines for r in line_dedup.dedup(two).collect()}
    assert gone == {1: 0, 2: 12}  # chunk by chunk and line by line, though they begin at other lines


def test_line_dedup_finds_every_passage(spark):
    """Passages of over 50 words in few lines, put between other lines, leave all texts but the first."""
    rng = random.Random(21)
    line = lambda n: " ".join(f"{rng.choice('abc')}{rng.randrange(10**5)}" for _ in range(n))
    passages = [[line(-(-51 // n) + rng.randrange(3)) for _ in range(n)] for n in (2, 3, 4, 5, 6, 9) for _ in range(5)]
    rows, want = [], {}
    for i, p in enumerate(passages):
        for k in range(3):
            head, tail = [line(rng.randrange(1, 30)) for _ in range(rng.randrange(5))], [line(rng.randrange(1, 30)) for _ in range(rng.randrange(5))]
            rows.append((10 * i + k, "\n".join([*head, *p, *tail])))
            want[10 * i + k] = rows[-1][1] if k == 0 else "\n".join([*head, *tail])
    rows += [(9001, "\n".join(p[0] for p in passages)), (9002, "\n".join(passages[3][:2]) if len(passages[3]) > 2 else "a\nb")]  # lines, but no passage
    out = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: out[k] for k in want} == want and out[9001] == rows[-2][1]


def test_token_ids(docs, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in registry.queries()["op2_token_ids"](spark, SF).collect()}
    start = 0
    for doc_id, text in sorted(texts_of(docs).items()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_ids_equal_the_library(spark, monkeypatch):
    """Special strings, white space of all kinds, case, repeats and ties; many files, few ids kept."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(8)
    signs = ["hello", "<|endoftext|>", "<|startoftext|>x", " ", "\t", "\u00a0", "\u2003", "\n", "\r\n", "e\u0301", "\u0301", "\u03a3\u03a3", "\u0130", "it's", "'S", "12", "\u4e2d\u6587", "\x00", "?!", "<|", "|>", "\U0001f642", "\xad", "\xa0", "\x85", "\u2019", "\xb2", "\xaa", "\xc9", "\u0178"]
    rows = [(i, "".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(3, rows[3][1]), (5, None), (200, "hello <|endoftext|> world")]
    monkeypatch.setattr(token_ids, "FILE_BYTES", 3000)
    encoder = token_ids.WordEncoder(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(token_ids, "KEPT", 20)
    plain = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for _, x in rows]
    assert [np.frombuffer(encoder.encode(x), encoder.code).astype("<u4").tobytes() for _, x in rows] == plain and [3306, 49407, 1002] == t.encode(rows[-1][1], add_special_tokens=False).ids
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = token_ids.new_folder(spark, "token-ids")
    manifest = token_ids.write(token_ids.encoded(df, P.path("word_bpe_49k.json")), folder, 3, token_ids.id_code(P.path("word_bpe_49k.json")))
    assert manifest.count() > 5  # files rolled
    start = 0
    want = sorted((d, p + b"\x01\0\0\0") for (d, _), p in zip(rows, plain, strict=True))
    got = sorted(token_ids.read(manifest, folder).collect(), key=lambda r: r.start)
    for r, (doc_id, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, start, len(ids) // 4, ids)
        start += len(ids) // 4


def test_token_ids_odd(odd):
    out = token_ids.round_trip(odd, P.path("word_bpe_49k.json")).collect()
    assert len(out) == len(ODD) and {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert token_ids.round_trip(odd.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_pack_round_trip():
    x = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(x) + 1):
        assert (token_ids.unpack(*token_ids.pack(x[:n]), n) == x[:n]).all()


def test_byte_bpe(docs, odd):
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd.filter("doc_id <> 5")):
        known = texts_of(df)
        out = byte_bpe.encode(df, ranks, P.PATTERN)
        for r in out.collect():
            ids = np.array(enc.encode_ordinary(known[r.doc_id]), "<u4").tobytes()
            assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(known[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.text for r in byte_bpe.decode(out, ranks).collect()} == known
    assert byte_bpe.encode(odd.limit(0), ranks, P.PATTERN).count() == 0


def test_perfect_hash():
    rng = random.Random(1)
    keys = list({rng.randbytes(rng.randrange(1, 9)) for _ in range(3000)})
    h = byte_bpe.PerfectHash(keys, list(range(len(keys))))
    assert [h.get(k) for k in keys] == list(range(len(keys))) and h.get(b"not a key of it") is None
    assert byte_bpe.PerfectHash([], []).get(b"x") is None


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p", ""), ("just text", "just text"),
    ("<body><nav>Menu</nav><article><h1>T&eacute;</h1><p>One,\n two &amp; three.</p><aside>x</aside><p>Four.</p></article><footer>f</footer></body>", "Té\n\nOne, two & three.\n\nFour."),
    ("<div class=sidebar><p>Side, side, side, side.</p></div><div id=main><p>Body text, here.</p><script>var a='<p>no</p>'</script><p>More of it.</p></div><div class='comments'><p>c</p></div>", "Body text, here.\n\nMore of it."),
])
def test_html(page, text):
    assert html_extract.main_text(page) == text


def test_html_takes_the_article_whole():
    long = "<p>" + ("a, " * 5 + "word " * 57) + "</p>"
    page = f"<article><h1>T</h1><div class=wrap>{long * 10}</div><p>Short end.</p><h3>Sub</h3><ul>{'<li>item</li>' * 10}</ul></article>"
    text = html_extract.main_text(page)
    assert text.startswith("T\n\n") and "Short end.\n\nSub\n\nitem" in text and text.count("item") == 10


BODY = "".join(f"<p>Words of passage {i}, and some more, so that it is read, again.</p>" for i in range(12))
SAID = [f"Words of passage {i}, and some more, so that it is read, again." for i in range(12)]


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><div class='row header-fixed'>{BODY}</div></body>", SAID),  # a name that speaks against the text, but it is the text
    (f"<div><div class=text>{BODY}</div><p>Short end.</p><h3>Sub</h3><ul><li>one</li><li>two</li></ul>bare words</div>", [*SAID, "Short end.", "Sub", "one", "two", "bare words"]),
    (f"<main>{BODY}</main><section class='responses'>{BODY.replace('Words', 'Reader')}</section>", SAID),
    (f"<div class=comments>{BODY * 3}</div><div class=story>{BODY}</div>", SAID),
    (f"<div id=content>{BODY}</div><div><a href=x>one</a> <a href=y>two</a></div>", SAID),
    (f"<div class='story'>{BODY}<div class='cookie-notice'><p>We use cookies.</p></div><form>f<input></form></div>", SAID),
    (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{BODY}<footer>by</footer></article>", ["Title", *SAID]),
    (f"<table><tr><td><ul><li><a href=a>m</a></ul><td>{BODY}</table>", SAID),
    ("<article><p>a<p>b<li>c<li>d<br>e</article>", ["a", "b", "c", "d e"]),
    ("<article><dl><dt>t<dd>d<dt>u<dd>v</dl></div></p></article>", ["t", "d", "u", "v"]),
    ("<article><p>1 &lt; 2 &#x41;&#66;&nbsp;&eacute;&unknown;</p></article>", ["1 < 2 AB \u00e9&unknown;"]),
    ("<article><pre>a\n\n  b</pre><p> \n </p><p>x<b>y</b>z <i> i </i></p></article>", ["a b", "xyz i"]),
    ("<body>top<nav>n</nav>end", ["top", "end"]),
])
def test_html_keeps_the_whole_article(page, text):
    assert html_extract.main_text(page).split("\n\n") == text


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "deep", "<p" * 40_000, "<p>x" * 40_000, "<table><td><p>" + "<div>x" * 20_000, "<div><li>x" * 20_000, "</b>" * 40_000 + "<div>" * 20_000 + "</i>" * 40_000, "<a '" * 20_000, "<!--" * 20_000, "<div class=ad>" * 20_000 + "<p>" + "x, " * 20_000])
def test_html_is_linear(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 4


def test_html_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", f"<article>{BODY}</article>"), (3, "v", f"<article>{BODY}</article>"), (4, "w", "<div>" * 40_000 + "deep &amp; long " * 10_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("mine"), "more": F.lit(7)})
    out = sorted((r.page_id, r.text, r.n_chars, r.more) for r in html_extract.extract(pages).collect())
    whole = "\n\n".join(SAID)
    assert [x[0] for x in out] == [1, 2, 3, 3, 4] and out[2] == out[3] == (3, whole, len(whole), 7) and out[0][1:3] == out[1][1:3] == ("", 0)
    assert out[4][1] == " ".join(["deep & long"] * 10_000)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_warc_odd(spark):
    big, small = "x" * 2000, "y"
    pages = spark.createDataFrame([(1, "http://a", big), (2, "http://b", big), (3, "c", small), (4, None, small), (5, "e\nf", None), (None, "g", big), (9, "http://z", big)], "page_id long, url string, html string").withColumn("record_type", F.lit(0))
    out = {r.page_id: r for r in warc.round_trip(pages, 2).collect()}
    assert len(out) == 7 and {k for k, r in out.items() if r.record_type == "revisit"} == {1, 2, None}
    assert out[1].refers_to == 9 and out[9].refers_to is None and out[5].payload_bytes == 0
    assert out[2].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert warc.round_trip(pages.limit(0), 2).count() == 0


def test_licenses(odd, spark):
    out = license_scan.scan(odd)
    assert out.count() == len(ODD) and {r.license for r in out.collect()} == {None}
    mit = next(t.text for t in license_scan.TEMPLATES if t.license == "MIT" and len(t.text) > 200).split()
    wrapped = "Copyright (c) 2001 Someone\n\n" + "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9)).upper()
    df = spark.createDataFrame([(1, wrapped), (2, "x\nlicensed under the apache licence version 2.0\ny"), (3, "under the bridge")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_scan.scan(df).collect()} == {1: "MIT", 2: "Apache-2.0", 3: None}
    assert license_scan.scan(odd.limit(0)).count() == 0


def test_licenses_beside_copyright(spark):
    """A notice or a licence on the line of its copyright statement."""
    mit = next(t.text for t in license_scan.TEMPLATES if t.license == "MIT" and len(t.text) > 200)
    rows = {
        1: ("Copyright 2020 The Authors. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        2: (f"Copyright (c) 2021 X {mit}", "MIT"),
        3: ("/* Copyright © 2019-2021 J. Doe, Foo Inc. All rights reserved. Released under the MIT License. */", "MIT"),
        4: ("A long tale of a page with many words that says what it is for and how it came about. Copyright 2001 A. B. Copyright (c) 2002 C. Licensed under CC BY 4.0.", "CC-BY-4.0"),
        5: ("Copyright (c) 2001 Someone", None),
        6: ("Copyright (c) 2001 Someone Inc. All Rights Reserved\nReleased under the MIT License.", "MIT"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert {k: r.license for k, r in got.items()} == {k: v[1] for k, v in rows.items()}
    assert got[1].dice == got[2].dice == got[6].dice == 1


def test_licenses_amid_other_text(spark):
    """Licences in their usual paragraphs, within longer documents."""
    mit, apache, bsd2, bsd3 = (next(t.text for t in license_scan.TEMPLATES if t.license == n and len(t.text) > 200) for n in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause"))

    def parted(text, breaks):
        w = text.split()
        cuts = [0, *[int(len(w) * b) for b in breaks], len(w)]
        return "\n\n".join("\n".join(" ".join(w[i : min(i + 9, hi)]) for i in range(lo, hi, 9)) for lo, hi in zip(cuts, cuts[1:], strict=False))

    rng = random.Random(3)
    prose = "\n\n".join("\n".join(" ".join(rng.choice("of the to use code and any this page software work in is".split()) for _ in range(9)) for _ in range(4)) for _ in range(30))
    rows = {
        1: (f"{prose}\n\n{parted(mit, [0.3, 0.6])}\n\n{prose}", {"MIT": 1}),
        2: (f"{prose}\n\n{parted(apache, [0.35, 0.5])}\n\n{prose}", None),
        3: (f"{prose}\n\n{parted(bsd3, [0.1, 0.2, 0.4, 0.5])}\n\n{prose}\n\n{parted(mit, [0.4])}", {"BSD-3-Clause": 1, "MIT": 1}),
        4: (f"{prose}\n\n{parted(bsd2, [0.1, 0.2, 0.4])}\n\n{prose}\n\n{parted(bsd2.rsplit(' ', 12)[0], [0.5])}\n\n{prose}\n\n{parted(bsd2, [0.5])}", {"BSD-2-Clause": 2}),
        5: (f"{prose}\n\n{' '.join(mit.split()[:60])}\n\n{prose}", {}),
        6: (prose, {}),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for k, (_, want) in rows.items():
        if want is not None:
            assert (got[k].licenses, got[k].n_license_spans) == (",".join(sorted(want)), sum(want.values())), k
    assert got[2].license == "Apache-2.0" and got[1].dice == got[4].dice == 1 and got[2].dice == 1
    # Found by itself already: neighbours do not make it a second span.
    one = spark.createDataFrame([(1, "a b\n\nReleased under the MIT License.\n\nc under the d")], "doc_id long, text string")
    assert license_scan.scan(one).first().n_license_spans == 1


def test_licenses_told_apart(spark):
    """Notices that differ from a template by a word or a number."""
    cc = "This work is licensed under a Creative Commons {} License."
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    rows = {
        1: (cc.format("Attribution-NonCommercial 4.0 International"), "CC-BY-NC-4.0"), 2: (cc.format("Attribution-NoDerivatives 4.0 International"), "CC-BY-ND-4.0"),
        3: (cc.format("Attribution-NonCommercial-ShareAlike 3.0 Unported"), "CC-BY-NC-SA-3.0"), 4: (cc.format("Attribution 4.0 International"), "CC-BY-4.0"),
        5: (cc.format("Attribution 2.5 Generic"), "CC-BY-2.5"), 6: (gnu.format("Lesser ", "2"), None), 7: (gnu.format("Lesser ", "2.1"), "LGPL-2.1"),
        8: (gnu.format("Affero ", "1"), "AGPL-1.0"), 9: (gnu.format("", "3").replace(" is ", " is not "), None), 10: (gnu.format("", "3.0"), "GPL-3.0"),
        11: (gnu.format("Library ", "2"), "LGPL-2.0"), 12: (gnu.format("", "2"), "GPL-2.0"), 13: ("Licensed under the Apache License, Version 1.1.", None),
        14: ("1. Released under the MIT License.", "MIT"), 15: ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"), 16: ("This very software is licensed under the MIT License.", "MIT"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_scan.scan(df).collect()} == {k: v[1] for k, v in rows.items()}
    # In a row of lines as well.
    amid = spark.createDataFrame([(k, f"some words\n\n{v[0].replace('licensed ', 'licensed' + chr(10))}\n\nmore words") for k, v in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(amid).collect()}
    assert all(got[k] == rows[k][1] for k in (1, 2, 3, 4, 6, 7, 9, 12)), got


def test_many_licenses_in_one_text(spark):
    """A notices file of 40 KB, more lines than a run may have."""
    mit = next(t.text for t in license_scan.TEMPLATES if t.license == "MIT" and len(t.text) > 200).split()
    text = "\n\n".join(f"part {i}\n" + "\n".join(" ".join(mit[j : j + 5]) for j in range(0, len(mit), 5)) for i in range(40))
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.license == "MIT" and row.licenses == "MIT" and row.dice > 0.98


def split_item(text):
    """Words of the question and of the answer: the last sentence, if both have eight words."""
    words = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    q, a = words(" ".join(parts[:-1])), words(parts[-1])
    return (q, a) if len(q) >= 8 and len(a) >= 8 else (q + a, [])


def brute_leaks(texts, items):
    """Every text against every item, without an index: {(text, item): kind}."""
    words = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    found = {}
    for item, text in items.items():
        q, a = split_item(text)
        w = q + a
        for d, t in texts.items():
            shared = five(w) & five(words(t))
            covered = {i + k for i in range(len(w) - 4) for k in range(5) if tuple(w[i : i + 5]) in shared}
            in_q, in_a = sum(i < len(q) for i in covered), sum(i >= len(q) for i in covered)
            if w and len(covered) >= 0.8 * len(w):
                found[d, item] = "whole"
            elif a and in_q >= 0.8 * len(q):
                found[d, item] = "both" if in_a >= 0.5 * len(a) else "question"
    return found


def test_leaks(docs, odd, spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench).collect()}
    texts, items = texts_of(docs), {r.item_id: r.text for r in bench.collect()}
    assert got and got == brute_leaks(texts, items)
    assert got == {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench, shard_postings=100).collect()}  # many shards
    # An item with words changed here and there, deep inside another text, upper case.
    rng = random.Random(2)
    w = max(items.values(), key=len).split()
    w[5] = "changed"
    filler = [rng.choice(["alpha", "beta", "gamma", "the"]) for _ in range(500)]
    planted = spark.createDataFrame([(1, " ".join(filler[:333] + w + filler[333:]).upper()), (2, " ".join(filler))], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(planted, bench).collect()} == {1}
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(odd.limit(0), bench).count() == 0
    assert decontaminate.clean(odd, bench).count() == len(ODD)


def test_leaks_by_question_and_answer(spark):
    """Question and answer apart, repeated items, null items, a score column, stretched leaks."""
    rng = random.Random(12)
    some = lambda n: [f"{rng.choice('bcdfg')}{rng.randrange(10**4)}" for _ in range(n)]
    items = {i: f"{' '.join(some(rng.randrange(10, 60)))}? {' '.join(some(rng.randrange(8, 60)))}." for i in range(60)}
    bench = spark.createDataFrame([*items.items(), (100, items[0]), (101, None), (102, ""), (None, items[1])], "item_id long, text string").withColumn("score", F.lit("x"))
    texts = {}
    for i, text in items.items():
        q, a = text.split("? ")
        a = a.split()
        texts[i] = " ".join([*some(rng.randrange(300)), q, *a[: rng.randrange(len(a) + 1)], *some(rng.randrange(50))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("score", F.lit(1))
    rows = decontaminate.leaks(df, bench).collect()
    want = brute_leaks(texts, items)
    assert set(want.values()) == {"whole", "both", "question"}
    assert {(r.doc_id, r.item_id): r.kind for r in rows if r.item_id is not None and r.item_id < 100} == want
    assert {r.doc_id for r in rows if r.item_id == 100} == {d for d, i in want if i == 0} and {r.doc_id for r in rows if r.item_id is None} == {d for d, i in want if i == 1}
    left = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert left == set(texts) - {d for (d, _), kind in want.items() if kind != "question"}
    # Half as many words again put in between: nine of ten are found at least.
    apart = {i: " ".join([*some(rng.randrange(300)), *(x for n, w in enumerate(text.split()) for x in ([w, *some(5)] if n % 10 == 9 else [w])), *some(9)]) for i, text in items.items()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(list(apart.items()), "doc_id long, text string"), bench.filter("item_id < 100")).collect()}
    want = set(brute_leaks(apart, items))
    assert len(want) == len(items) and len(got & want) >= 0.9 * len(want) and got <= want


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(three)
    covered = {i + k for i, x in enumerate(three) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def brute_verdict(known, rows, labels):
    """Kept or not by counts in Python; the buckets are Spark's hashes of the grams."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in known.items()}
    grams = {d: [(x,) for x in w] + list(zip(w, w[1:])) for d, w in words.items()}
    every = spark.createDataFrame([(x[0], x[1] if len(x) > 1 else None) for x in sorted({g for gs in grams.values() for g in gs}, key=str)], "a string, b string")
    hashed = F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b"))
    bucket = {(r.a,) if r.b is None else (r.a, r.b): r.g for r in every.select("a", "b", F.pmod(hashed, F.lit(quality_rules.BUCKETS)).alias("g")).collect()}
    good = {x.doc_id: x.quality == 1 and not x.toxic for x in labels}
    ids = spark.createDataFrame([(d,) for d in good], "d long")
    held = {r.d for r in ids.filter(F.pmod(F.xxhash64("d", F.lit("held")), F.lit(quality_rules.HELD_OUT)) == 0).collect()}
    raw, trusted = Counter(), Counter()
    for d, gs in grams.items():
        raw.update(bucket[g] for g in gs)
        trusted.update(bucket[g] for g in gs if good.get(d) and d not in held)
    n_raw, n_trusted = raw.total() + quality_rules.BUCKETS, trusted.total() + quality_rules.BUCKETS
    score = {d: sum(math.log((trusted[bucket[g]] + 1) / n_trusted) - math.log((raw[bucket[g]] + 1) / n_raw) for g in gs) / len(gs) if gs else 0.0 for d, gs in grams.items()}
    failed = {r.doc_id for r in rows if r.base_failed}
    bad = {x.doc_id for x in labels if x.quality == 0}
    seen = [d for d in held if d in score and d not in failed]
    n_good, n_bad = sum(good[d] for d in seen), sum(d in bad for d in seen)
    at = {d: round(score[d] / quality_rules.BIN) for d in seen}
    value = {k: round(10 * sum(good[d] and at[d] >= k for d in seen) / n_good - sum(d in bad and at[d] >= k for d in seen) / max(1, n_bad), 9) for k in range(min(at.values()), max(at.values()) + 2)}
    best = [(k - 0.5) * quality_rules.BIN for k in value if value[k] == max(value.values())]
    least = (best[0] + best[-1]) / 2 if n_bad else min(score[d] for d in seen if good[d]) - 0.05
    return {(r.doc_id, r.n_words): r.doc_id not in failed and score[r.doc_id] >= least for r in rows}


def test_quality_rules(docs, odd, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = texts_of(docs)
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == len(known)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(known[r.doc_id])
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in rows if r.kept}
    good = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()} - {r.doc_id for r in rows if r.base_failed}
    assert len(good & kept) >= 0.9 * len(good)
    assert {(r.doc_id, r.n_words): r.kept for r in rows} == brute_verdict(known, rows, labels.collect())
    assert quality_rules.judge(odd, labels).count() == len(ODD)
    assert quality_rules.judge(odd, labels.limit(0)).count() == len(ODD)
    assert quality_rules.judge(odd.limit(0), labels).count() == 0


def brute_classes(texts):
    bags = {}
    for d, t in texts.items():
        w = [x for x in re.split(r"[^\w]|_", t.lower()) if x]
        bags[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = bags[a], bags[b]
            alike = texts[a] == texts[b] if x is None or y is None else sum((x & y).values()) >= 0.8 * sum((x | y).values())
            if alike:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def test_near_duplicates(docs, odd):
    want = brute_classes(texts_of(docs))
    assert {r.doc_id: r.class_id for r in bag_minhash.classes(docs).collect()} == want
    assert {r.doc_id: r.class_id for r in bag_minhash.classes(docs, small=2, block=4).collect()} == want  # large buckets, many blocks
    got = bag_minhash.classes(odd).collect()
    assert len(got) == len(ODD) and len({r.class_id for r in got if r.doc_id in (5, 7)}) == 1
    assert bag_minhash.keep_one(odd).count() == 7
    assert bag_minhash.classes(odd.limit(0)).count() == 0
    unlike = odd.sparkSession.createDataFrame([(1, "one two three four five six"), (1, "alpha beta gamma delta epsilon zeta"), (2, "p q r s t u v w x y z")], "doc_id long, text string").withColumn("class_id", F.lit("mine"))
    assert bag_minhash.keep_one(unlike).count() == 3 and len({r.class_id for r in bag_minhash.classes(unlike).collect()}) == 3


def test_near_duplicates_of_a_hot_group(spark):
    """Copies of one text that is not among them, at similarities around the threshold."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = {}
    for i in range(240):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i + 1] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_classes(texts)
    assert 1 < len(set(want.values())) < 200
    for block in (1024, 16):
        assert {r.doc_id: r.class_id for r in bag_minhash.classes(df, block=block).collect()} == want


def test_bag_minhash_estimates_weighted_jaccard():
    rng = random.Random(4)
    a = [rng.randrange(200) for _ in range(400)]
    b = a[:300] + [rng.randrange(200) for _ in range(100)]
    est = []
    for salt in range(12):
        doc = np.repeat([0, 1], 400)
        s = bag_minhash.mix(np.array(a + b, np.uint64) * np.uint64(7919) + np.uint64(salt * 1_000_003))
        h = bag_minhash.signatures(doc, s, 2)
        est.append((h[0] == h[1]).mean())
    x, y = Counter(a), Counter(b)
    assert abs(np.mean(est) - sum((x & y).values()) / sum((x | y).values())) < 0.04


def test_texts_of_one_id_are_apart(spark):
    """A null or repeated doc_id: only the texts that leak, or that copy another, go."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy(F.length("text").desc()).first().text
    rng = random.Random(5)
    a, b, c = (" ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(80)) for _ in range(3))
    rows = [(None, item), (None, a), (7, item), (7, b)]
    left = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("None", a), ("7", b)])
    rows = [(1, a), (7, a), (7, b), (7, c), (7, c), (None, item)]
    left = bag_minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.text for r in left.collect()) == sorted([a, b, c, item])


def test_url_filter_is_brute_force():
    rng = random.Random(6)
    globs = ["a*b", "**/x", "?b**", "", "**", "a?*c/**d", "*.*"] + ["".join(rng.choice("ab/?*") for _ in range(rng.randrange(9))) for _ in range(60)]
    urls = ["".join(rng.choice("abcd/?#.x") for _ in range(rng.randrange(12))) for _ in range(200)] + [""]

    def pattern(g):
        return re.compile("".join(".*" if p == "**" else "[^/?#]*" if p == "*" else "." if p == "?" else re.escape(p) for p in re.findall(r"\*\*|\*|.", g)), re.S)

    got = url_filter.ShiftAnd(globs).matches(urls)
    for j, g in enumerate(globs):
        assert [bool(pattern(g).fullmatch(u)) for u in urls] == got[:, j].tolist(), g


def test_url_filter_odd(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "nothing"), (4, "HTTP://Sub.EXAMPLE.net/en/x"), (5, "http://a.net"), (6, "http://example.org/fr/?q"), (7, "http://b.example.com/de/")], "page_id long, url string").withColumn("rule", F.lit(1))
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.HOST_RULES, url_filter.GLOB_RULES).collect()}
    assert out[1] == out[2] == out[3] == ("", "", None, "allow")
    assert out[4] == ("sub.example.net", "/en/x", "example.net/en/", "allow") and out[5] == ("a.net", "", None, "allow")
    assert out[6][2:] == ("org/fr/", "allow") and out[7][2:] == ("example.com/de/", "block")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, kept = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, SF)
        assert i == 4 or at.columns == docs.columns
        kept.append(at.count())
    assert kept == sorted(kept, reverse=True) and kept[1] == kept[0] and kept[-1] > 0
    assert corpus_pipeline.run(spark, SF).count() == kept[-1]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
