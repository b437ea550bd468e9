"""Top-k per group, ties kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scimetrics.operators.joins import join_na


def top_k_ties(df: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """Rows among the ``k`` largest of their group, with all ties of the last place.

    Only a histogram of the ranked value is windowed, one row per group and
    distinct value, and of it the ``k`` largest values, which each map task can
    cut before the shuffle. The rows themselves are never gathered per group, so
    a group with most of the rows, or a tie of any length, stays distributed.
    """
    histogram = df.groupBy(*by, value).agg(F.count("*").alias("_rows"))
    downwards = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())
    ahead = F.sum("_rows").over(downwards.rowsBetween(Window.unboundedPreceding, -1))
    kept = (
        histogram.withColumn("_place", F.rank().over(downwards))
        .where(F.col("_place") <= k)
        .withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
        .where(F.col("_ahead") < k)
        .select(*by, value)
    )
    return join_na(df, kept, [*by, value], "left_semi")
