"""Distances between sequences of ids, as pandas UDFs over pairs of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def edit_distance(a, b) -> int:
    """Insertions, deletions and changes from one sequence to the other, a row of the table at a time."""
    a, b = np.asarray(a), np.asarray(b)
    if not len(a) or not len(b):
        return max(len(a), len(b))
    step, row = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        up = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        # leftward steps cost one each: a running minimum of value less place
        row = np.minimum.accumulate(np.concatenate([[i], up]) - step) + step
    return int(row[-1])


def common_length(a, b) -> int:
    """The length of the longest common subsequence."""
    a, b = np.asarray(a), np.asarray(b)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1]) if len(b) else 0


def common_places(a, b) -> list[int]:
    """The places in ``a`` of a longest common subsequence, the earliest that the table allows from its end."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i, x in enumerate(a):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (np.asarray(b) == x)))
    i, j, out = len(a), len(b), []
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


@F.pandas_udf(IntegerType())
def levenshtein_ids(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def lcs_distance(a, b):
    """|a| + |b| - 2 LCS."""
    return F.size(a) + F.size(b) - 2 * lcs_length(a, b)
