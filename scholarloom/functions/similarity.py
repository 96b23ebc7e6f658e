"""Ratcliff-Obershelp title similarity; the one measure Spark has no expression for."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def matching_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """2 * matched characters / total length, 0 for NULL; the argument order matters."""
    return pd.Series(
        [0.0 if a is None or b is None else SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in zip(first, second, strict=True)],
        dtype="float64",
    )
