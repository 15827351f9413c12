"""Text functions as Columns; Python (in Arrow batches) only for Unicode normal forms, fuzzy
matches, replacements and the compatible hash."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

CJK = "㐀-鿿"


def tokens(text: Column) -> Column:
    """Lower-cased words of a-z, 0-9 and _, and of CJK runs each sign and each pair."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([a-z0-9_]+|[{CJK}]+)"), 1)

    def of_run(run: Column) -> Column:
        signs = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(~run.rlike(rf"^[{CJK}]"), F.array(run)).when(F.length(run) == 1, signs).otherwise(F.concat(signs, pairs))

    return F.flatten(F.transform(runs, of_run))


_RUN, _CJK_RUN = re.compile(f"[a-z0-9_]+|[{CJK}]+"), re.compile(f"[{CJK}]")


def words_of(text: str) -> list[str]:
    """`tokens` of a text in lower case, inside a task."""
    runs = _RUN.findall(text)
    if not _CJK_RUN.search(text):
        return runs
    out: list[str] = []
    for run in runs:
        out += [*run, *(map("".join, zip(run, run[1:], strict=False)))] if run[0] >= CJK[0] else [run]
    return out


def sentences(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^。！？!?；;\n]+[。！？!?；;]?)"), 1)
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def in_groups(items: Column, n: int, glue: str = "") -> Column:
    """Items joined n at a time."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i + 1, n), glue))


def slices(text: Column, size: int = 10_000) -> Column:
    """Pieces of `size` characters; none of an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def tag_contents(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), 1)


def last_tag(text: Column, tag: str) -> Column:
    """What the last such element holds, else null."""
    return F.try_element_at(tag_contents(text, tag), F.lit(-1))


def has_all(text: Column, tags: list[str]) -> Column:
    return F.forall(F.array(*map(F.lit, tags)), lambda t: F.contains(F.coalesce(text, F.lit("")), t))


def without_thinking(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<thinking[^>]*>.*?</thinking>", ""), r"(?i)</?thinking[^>]*>", "")


def alnum(text: Column) -> Column:
    """Only Latin letters, digits and common CJK signs."""
    return F.regexp_replace(text, "[^一-龥a-zA-Z0-9]", "")


def gram_keywords(text: Column, k: int) -> Column:
    """The first k distinct character n-grams of alnum(text), n from 4 to 2."""
    plain = alnum(text)

    def grams(n: int) -> Column:
        return F.when(F.length(plain) >= n, F.transform(F.sequence(F.lit(1), F.length(plain) - (n - 1)), lambda i: F.substring(plain, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.slice(F.array_distinct(F.concat(grams(4), grams(3), grams(2))), 1, k)


def keyword_list(text: Column, most: int = 24) -> Column:
    """Split at commas, semicolons, bars and lines; bullets and blanks go; the first `most`."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[，,、\n;；|]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*•\d.]+", "")))
    return F.array_distinct(F.slice(F.filter(parts, lambda x: x != ""), 1, most))


def token_estimate(text: Column) -> Column:
    """A token for each 1.6 characters, one at least; 0 for blank texts."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.trim(t) == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(t) / F.lit(1.6)))).cast("long")


def between_marks(text: Column, start: str, end: str) -> Column:
    """What stands between the last `start` that an `end` follows and that end."""
    return F.regexp_extract(text, rf"(?s)^.*{re.escape(start)}(.*?){re.escape(end)}", 1)


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def digest(columns: list[str]) -> Column:
    """SHA-256 over the named columns as JSON, names sorted."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


@F.pandas_udf(StringType())
def display_key(names: pd.Series) -> pd.Series:
    """NFKC, trimmed, white space collapsed, lower case."""
    return names.map(lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x)).strip().lower())


@F.pandas_udf(StringType())
def match_key(names: pd.Series) -> pd.Series:
    """display_key less zero-width and direction marks."""
    hidden = re.compile("[​-‏‪-‮⁠﻿]")
    return names.map(lambda x: None if x is None else re.sub(r"\s+", " ", hidden.sub("", unicodedata.normalize("NFKC", x))).strip().lower())


@F.pandas_udf(StringType())
def slug(names: pd.Series) -> pd.Series:
    """ASCII letters, digits and _ of at most 48 characters; other signs by their number."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x.strip().lower()) if not unicodedata.combining(c))
        named = "".join(c if c.isascii() else f"_u{ord(c):x}_" for c in plain)
        made = re.sub(r"[^a-z0-9]+", "_", named).strip("_")[:48] or "table"
        return f"t_{made}" if made[0].isdigit() else made

    return names.map(one)


def fuzzy_score(target: Column, text: Column) -> Column:
    """How well a text holds a target (`_span`), 0 to 1; 0 for null and empty ones."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([_span(x, y)[0] for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(target, text)


SIGNS = "一-龥a-zA-Z0-9"
NO_SPAN = (0.0, -1, -1)


def _span(target: str | None, text: str | None) -> tuple[float, int, int]:
    """Score, start and end of the best match; 0 and -1 where there is none.

    1 where the text contains the target. Otherwise letters and digits alone count: a span that
    begins and ends as the target does (a quarter of it, 3 to 10 signs), of half to one and a
    half times its length, scores the share of the target's first five keywords (runs of four
    signs, then of three, of two) that it has. Below 0.4, and for targets of under ten letters
    and digits, there is none; of equal scores the first counts."""
    if not target or not text:
        return NO_SPAN
    if (at := text.find(target)) >= 0:
        return 1.0, at, at + len(target)
    want = re.sub(f"[^{SIGNS}]", "", target)
    if len(want) < 10:
        return NO_SPAN
    places = [m.start() for m in re.finditer(f"[{SIGNS}]", text)]
    plain = "".join(text[i] for i in places)
    runs = dict.fromkeys(want[i : i + n] for n in (4, 3, 2) for i in range(len(want) - n + 1))
    keys = list(runs)[:5]
    n = max(3, min(10, len(want) // 4))
    head, tail, least, most = want[:n], want[-n:], len(want) // 2, len(want) * 3 // 2
    best, start = NO_SPAN, plain.find(head)
    while start >= 0 and best[0] < 1:
        end = plain.find(tail, start + least - n, start + most)
        while end >= 0:
            score = sum(k in plain[start : end + n] for k in keys) / len(keys)
            if score >= 0.4 and score > best[0]:
                best = score, places[start], places[end + n - 1] + 1
                break
            end = plain.find(tail, end + 1, start + most)
        start = plain.find(head, start + 1)
    return best


def punctuation_trimmed(text: Column) -> Column:
    """prefix, core and suffix: what stands before and after the outermost letters and digits."""
    t = F.coalesce(text, F.lit(""))
    prefix = F.regexp_extract(t, rf"^[^{SIGNS}]+", 0)
    rest = F.substr(t, F.length(prefix) + 1)
    suffix = F.regexp_extract(rest, rf"[^{SIGNS}]+$", 0)
    return F.struct(prefix.alias("prefix"), F.substr(rest, F.lit(1), F.length(rest) - F.length(suffix)).alias("core"), suffix.alias("suffix"))


def double_quoted(text: Column) -> Column:
    """Single quotes as curly double ones; a closing one that no letter or digit follows goes."""
    mark = "\ue000"  # closes for now
    for pair in ("‘([^’]*)’", "'([^']*)'"):
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, pair, f"“$1{mark}"), rf"{mark}(?=[^{SIGNS}]*$)", ""), mark, "”")
    return text


def tag_map(text: Column) -> Column:
    """Tag to the contents of its elements, in order; elements inside others are not looked at."""
    found = F.lit(r"(?s)<(\w+)>(.*?)</\1>")
    t = F.coalesce(text, F.lit(""))
    each = F.arrays_zip(F.regexp_extract_all(t, found, 1).alias("tag"), F.regexp_extract_all(t, found, 2).alias("body"))
    names = F.array_distinct(F.transform(each, lambda e: e["tag"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(each, lambda e: e["tag"] == n), lambda e: e["body"])))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("n_applied", IntegerType())]))
def replaced(texts: pd.Series, edits: pd.Series) -> pd.DataFrame:
    """Texts after their edits (original, optimized), one after the other: the best match of the
    original takes the core of the other between its own outer punctuation."""
    core = re.compile(rf"^([^{SIGNS}]*)(.*?)([^{SIGNS}]*)$", re.S)

    def quoted(x: str) -> str:
        for pair in (r"‘([^’]*)’", r"'([^']*)'"):
            x = re.sub(pair, lambda m: f"“{m[1]}" + ("”" if re.search(f"[{SIGNS}]", m.string[m.end() :]) else ""), x)
        return x

    def one(text: str | None, ops: list | None) -> tuple[str | None, int]:
        n = 0
        for op in ops if text and ops is not None else ():
            if op["original"] and op["optimized"]:
                _, lo, hi = _span(op["original"], text)
                if lo >= 0:
                    own, new = core.match(text[lo:hi]), core.match(op["optimized"])
                    text, n = text[:lo] + quoted(own[1] + new[2] + own[3]) + text[hi:], n + 1
        return text, n

    return pd.DataFrame([one(t, o) for t, o in zip(texts, edits, strict=True)], columns=["text", "n_applied"])


@F.pandas_udf(StringType())
def input_hash(texts: pd.Series) -> pd.Series:
    """The compatible hash of an input: shifts wrap at 32 bits, the sum of a step does not; in
    base 36 with its sign. Trimmed, line ends as \\n; empty for null and empty texts."""

    def wrapped(x: int) -> int:
        return (x + 2**31) % 2**32 - 2**31

    def one(text: str | None) -> str:
        if not text:
            return ""
        units = text.strip().replace("\r\n", "\n").replace("\r", "\n").encode("utf-16-le")
        h = 2166136261
        for lo, hi in zip(units[::2], units[1::2], strict=True):
            h = wrapped(h) ^ (lo | hi << 8)
            h += sum(wrapped(h << k) for k in (1, 4, 7, 8, 24))
        out, n = "", abs(h)
        while n:
            n, d = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return ("-" if h < 0 else "") + (out or "0")

    return texts.map(one)


def code_index(text: Column) -> Column:
    """A code as it is stored: NFKC, trimmed, upper case."""
    return F.upper(F.trim(display_form(text)))


@F.pandas_udf(StringType())
def display_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))
