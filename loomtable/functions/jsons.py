"""JSON: fields of a column, comments, and repair of what people and models write."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType


def field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def parsed(text: Column, schema: str) -> Column:
    """Comments are allowed, what can't be read is null."""
    return F.from_json(text, schema, {"allowComments": "true", "mode": "PERMISSIVE"})


def repair(text: str | None) -> str | None:
    """Curly quotes, bare control characters, trailing commas, numeric and bare keys."""
    if text is None:
        return None
    fixes = (
        lambda t: t,
        lambda t: re.sub("[“”「」]", '"', t),
        lambda t: re.sub(r"[\x00-\x1f]", " ", t),
        lambda t: re.sub(r",\s*([}\]])", r"\1", t),
        lambda t: re.sub(r"([{,]\s*)(\w+)\s*:", r'\1"\2":', t),
        lambda t: re.sub(r"'([^']*)'", r'"\1"', t),
    )
    for fix in fixes:
        text = fix(text)
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """Canonical JSON of each text, null where it can't be repaired."""
    return texts.map(repair)


def _top_level(text: str, delimiter: str) -> list[int]:
    """Places of the delimiter outside quotes and brackets of all kinds."""
    found, quoted, skip = [], False, False
    depth = {"{": 0, "[": 0, "(": 0}
    closers = {"}": "{", "]": "[", ")": "("}
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            if c in depth:
                depth[c] += 1
            elif c in closers:
                depth[closers[c]] = max(0, depth[closers[c]] - 1)
            elif c == delimiter and not any(depth.values()):
                found.append(i)
    return found


def segments(text: str | None, delimiter: str = ",") -> list[str]:
    cuts = [-1, *_top_level(text or "", delimiter), len(text or "")]
    return [part for a, b in zip(cuts, cuts[1:], strict=False) if (part := (text or "")[a + 1 : b].strip())]


def loose_object(text: str | None) -> dict[str, str] | None:
    """Cells of an object with missing or bare keys: a value without one gets the next number.
    Null where it is no object, or a part of it is no value."""
    body = (text or "").strip()
    if not (body.startswith("{") and body.endswith("}")) or len(body) < 2:
        return None
    out: dict[str, str] = {}
    nth = 0
    for part in segments(body[1:-1]):
        at = _top_level(part, ":")
        value = repair(part[at[0] + 1 :].strip() if at else part)
        key = part[: at[0]].strip().strip("\"'") if at else ""
        if value is None or (at and not key):
            return None
        if not at:
            while str(nth) in out:
                nth += 1
            key, nth = str(nth), nth + 1
        elif key.isdigit() and str(int(key)) == key:
            nth = max(nth, int(key) + 1)
        out[key] = json.loads(value) if value.startswith('"') else value
    return out


@F.pandas_udf(ArrayType(StringType()))
def split_top_level(texts: pd.Series, delimiters: pd.Series) -> pd.Series:
    """Parts of texts between delimiters that stand outside quotes and brackets, trimmed."""
    return pd.Series([segments(t, d) for t, d in zip(texts, delimiters, strict=True)], dtype=object)


@F.pandas_udf(MapType(StringType(), StringType()))
def loose_objects(texts: pd.Series) -> pd.Series:
    return texts.map(loose_object)
