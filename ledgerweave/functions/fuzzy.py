"""The one Python function of the engine: similarity of two strings by matching blocks.

Its value depends on the order of its arguments and has no built-in equal, so it
runs as a pandas UDF on rows that cheaper conditions have thinned out.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of (a, b); null when either is null."""
    known: dict = {}

    def one(x, y):
        if x is None or y is None:
            return None
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x, y).ratio()
        return known[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio_plain(a: pd.Series, b: pd.Series) -> pd.Series:
    """As ratio, without the shortcut for characters that are frequent in long strings; equal strings need no comparison."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y, False).ratio() for x, y in zip(a, b)], dtype="float64")


def alike(a: str | None, b: str | None, least: float) -> bool:
    """Whether two keys are equal or their plain ratio reaches ``least``; for stateful operators, which meet them one by one."""
    return bool(a) and bool(b) and (a == b or SequenceMatcher(None, a, b, False).ratio() >= least)
