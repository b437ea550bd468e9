"""Equi-joins that match missing keys to missing keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Key = str | tuple[str, str]


def join_na(left: DataFrame, right: DataFrame, on: Sequence[Key], how: str = "left") -> DataFrame:
    """Join on ``on`` with NULL equal to NULL; right-hand keys are not repeated.

    A key is a shared column name or a (left, right) pair of names. No side is
    hinted: the optimizer and AQE broadcast a side only if its size allows.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    hidden = {r: f"_key_{i}" for i, (_, r) in enumerate(pairs)}
    right = right.withColumnsRenamed(hidden)
    condition = reduce(
        lambda a, b: a & b, [left[l].eqNullSafe(right[hidden[r]]) for l, r in pairs]
    )
    return left.join(right, condition, how).drop(*hidden.values())


def without_words(df: DataFrame, column: str, words: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose value is not in ``words``; a missing value is never a member."""
    if isinstance(words, DataFrame):
        listed = words.select(F.col(words.columns[0]).alias("_word")).distinct()
        return df.join(listed, df[column] == listed["_word"], "left_anti")
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*words))
