"""Predicates as Columns: keywords in a text, loose comparisons, cells of a row."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
NARROW = str.maketrans({"＞": ">", "＜": "<", "＝": "=", "≥": ">=", "≤": "<=", "≦": "<=", "≧": ">=", "≠": "!=", "！": "!", "（": "(", "）": ")", "，": ",", "；": ";"})


def narrow(text: str) -> str:
    """Full-width operators as ASCII."""
    return text.translate(NARROW)


def keywords(text: Column, condition: str) -> Column:
    """`a&b,c,!d,(e,f)&g`: comma is OR, & is AND and binds tighter, ! is NOT; a keyword holds
    if the text contains it, case aside. An empty condition holds."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    tokens = re.findall(r"[(),&!]|[^(),&!]+", narrow(condition))
    tokens = [t.strip() for t in tokens if t.strip()]
    if not tokens:
        return F.lit(True)

    def either() -> Column:
        terms = [both()]
        while tokens and tokens[0] == ",":
            tokens.pop(0)
            terms.append(both())
        return reduce(operator.or_, terms)

    def both() -> Column:
        terms = [one()]
        while tokens and tokens[0] == "&":
            tokens.pop(0)
            terms.append(one())
        return reduce(operator.and_, terms)

    def one() -> Column:
        if not tokens:
            raise ValueError(f"{condition!r} ends early")
        t = tokens.pop(0)
        if t == "!":
            return ~one()
        if t == "(":
            inner = either()
            if not tokens or tokens.pop(0) != ")":
                raise ValueError(f"{condition!r} lacks a )")
            return inner
        if t in "),&":
            raise ValueError(f"{t!r} is out of place in {condition!r}")
        return F.contains(lowered, F.lit(t.lower()))

    found = either()
    if tokens:
        raise ValueError(f"{tokens[0]!r} is out of place in {condition!r}")
    return found


def compare(cell: Column, op: str, value: str | float) -> Column:
    """Numeric if both sides are numbers, else as strings."""
    f = OPERATORS[narrow(op)]
    as_text = f(cell.cast("string"), F.lit(str(value)))
    try:
        number = float(value)
    except ValueError:
        return as_text
    cast = cell.cast("string").try_cast("double")
    return F.when(cast.isNotNull(), f(cast, F.lit(number))).otherwise(as_text)


def truthy(value: Column) -> Column:
    """Neither null, '', 0 nor false."""
    return F.coalesce(~F.lower(value.cast("string")).isin("", "0", "0.0", "false", "null"), F.lit(False))


def any_cell(columns: list[str], key: str) -> Column:
    """A cell of the row equals key, outer space aside."""
    return F.exists(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), lambda c: c == key)


def glob(text: Column, pattern: str) -> Column:
    """`*`, `?` and `[...]` of a glob; case counts."""
    made = re.sub(r"\\\*", ".*", re.escape(pattern)).replace(r"\?", ".")
    made = re.sub(r"\\\[(.*?)\\\]", lambda m: "[" + m[1].replace("\\-", "-").replace("\\^", "^") + "]", made)
    return text.rlike(f"(?s)^{made}$")
