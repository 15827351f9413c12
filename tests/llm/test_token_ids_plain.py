"""Pre-tokens of plain texts: equal to the library's at every boundary, and cheaper than a pattern."""

import random
import time

import numpy as np
import pytest
import regex

from loomtable.llm import token_ids

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def ids_of(encoder, texts):
    return [np.frombuffer(x, encoder.code).tolist() for x in encoder.encode_all(texts)]


def test_every_boundary_equals_the_library(monkeypatch):
    """Contractions, apostrophes in a row, digits, letters that grow in lower case; texts of both ways in one call, chunks of few texts, one text over a chunk."""
    encoder, rng = token_ids.WordEncoder(PATH), random.Random(3)
    monkeypatch.setattr(token_ids, "CHUNK", 200)
    monkeypatch.setattr(token_ids, "KEPT", 50)
    signs = ["'", "''", "'s", "'t", "'re", "'VE", "'m", "'ll", "'D", "'l", "'r", "s", "Ab", "é", "İ", "Ⱥ", "ǅ", "\n", "\t", "\r", " ", "1", "22", "²", "½", "!?", '"', "’", "—", "ª", "<|", "|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(20))) for _ in range(3000)]
    texts += [None, "", " ", "\n\t", "'", "'s", "s'", "it's", "we'll've", "中文's", "á's", "x <|endoftext|> 's", "don't " * 500]
    plain = [chr(c) for c in range(0x2100) if not token_ids.UNPLAIN(chr(c))]
    texts += [f"a{c}1{c}!{c}'{c}s" for c in plain]
    rng.shuffle(texts)
    want = [encoder.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert encoder.kinds is not None and ids_of(encoder, texts) == want
    assert [np.frombuffer(encoder.encode(x), encoder.code).tolist() for x in texts[:50]] == want[:50]
    encoder.kinds = None  # a tokenizer of another make
    assert ids_of(encoder, texts) == want


def test_only_white_space_and_no_texts():
    encoder = token_ids.WordEncoder(PATH)
    assert encoder.encode_all([]) == [] and encoder.encode_all([" ", None, "\n"]) == [b"", b"", b""]


def test_known_words_cost_less_than_half_their_pattern():
    """A plain text whose words are known takes less than half the CPU time of finding its words by the tokenizer's pattern."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) + rng.choice(["", ",", ".", "'s"]) for _ in range(300_000))
    encoder, find = token_ids.WordEncoder(PATH), regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def least(f):
        took = []
        for _ in range(5):
            at = time.process_time()
            f(text)
            took.append(time.process_time() - at)
        return min(took)

    encoder.encode(text)
    assert 2 * least(encoder.encode) < least(find)


def test_counts_over_many_sums(spark, monkeypatch):
    """Ids are counted in groups of documents of a bounded size, and every group counts."""
    monkeypatch.setattr(token_ids, "COUNTED", 7)
    rows = [(i, np.array([i % 5, 7, 7, 400 * (i % 2)], "<u2").tobytes()) for i in range(40)] + [(40, b"")]
    df = spark.createDataFrame(rows, "doc_id long, ids binary")
    got = {r.id: r.n for r in token_ids.counts(df, "<u2").collect()}
    assert got == {0: 28, 1: 8, 2: 8, 3: 8, 4: 8, 7: 80, 400: 20}
    assert token_ids.counts(df.limit(0), "<u2").count() == 0
