"""Vectors as base 64 of little-endian 32-bit floats, and back."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


@F.pandas_udf(StringType())
def packed(vectors: pd.Series) -> pd.Series:
    """Null for a null or empty vector and one with a value that is not finite."""

    def one(x) -> str | None:
        if x is None or not len(x) or not np.isfinite(v := np.asarray(x, "<f4")).all():
            return None
        return base64.b64encode(v.tobytes()).decode()

    return vectors.map(one)


@F.pandas_udf(ArrayType(FloatType()))
def unpacked(texts: pd.Series) -> pd.Series:
    """Null for what is no base 64 of whole finite numbers."""

    def one(x: str | None):
        try:
            v = np.frombuffer(base64.b64decode(x or "", validate=True), "<f4")
        except ValueError:
            return None
        return v if len(v) and np.isfinite(v).all() else None

    return texts.map(one)
