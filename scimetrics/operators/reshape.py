"""Pairs within groups, filled combinations, repeated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.operators.dedupe import ORDER

BLOCK_ROWS = 512


def ordered_pairs(
    rows: DataFrame,
    key: str,
    value: str,
    size: str,
    names: tuple[str, str],
    order: str = ORDER,
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All row pairs i < j (by ``order``) of each ``key`` group.

    ``size`` is a column with the number of rows of the group. A group larger
    than ``block_rows`` is cut into blocks and every pair of blocks becomes its
    own join key, so no task holds a whole large group; the copies this needs
    are 1/``block_rows`` of the pairs the group yields anyway.
    """
    blocks = F.ceil(F.col(size) / block_rows).cast("int")
    placed = rows.withColumn("_blocks", F.greatest(blocks, F.lit(1))).withColumn(
        "_block", F.pmod(F.xxhash64(order), F.col("_blocks")).cast("int")
    )
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = placed.select(
        F.col(key),
        F.col("_block").alias("_i"),
        others.alias("_j"),
        F.col(value).alias(names[0]),
        F.col(order).alias("_first"),
        *carry,
    )
    right = placed.select(
        F.col(key).alias("_key"),
        others.alias("_ri"),
        F.col("_block").alias("_rj"),
        F.col(value).alias(names[1]),
        F.col(order).alias("_second"),
    )
    paired = left.join(
        right,
        (left[key] == right["_key"])
        & (left["_i"] == right["_ri"])
        & (left["_j"] == right["_rj"])
        & (left["_first"] < right["_second"]),
    )
    return paired.select(key, *names, *carry)


def crossing(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Every distinct row of ``df`` with every label of a fixed list."""
    return df.distinct().select("*", F.explode(F.lit(sorted(set(labels)))).alias(column))


def complete(
    wide: DataFrame,
    ids: Sequence[str],
    labels: Sequence[str],
    names_to: str,
    values_to: str,
    observed: DataFrame | None = None,
) -> DataFrame:
    """Counts of ``wide`` (one row per key, one column per label) as rows, 0 where missing.

    As in a fill over observed combinations, a key without any label is left out
    and so is a label that no key has. ``observed`` may give the rows whose
    ``names_to`` column was counted, when they are cheaper to look at than ``wide``.
    """
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in labels}
    filled = wide.select(*ids, *counts.values()).where(sum(F.col(c) for c in labels) > 0)
    if observed is None:
        flags = filled.agg(*[(F.max(c) > 0).alias(c) for c in labels])
    else:
        flags = observed.agg(*[F.bool_or(F.col(names_to) == c).alias(c) for c in labels])
    seen = flags.select(F.array_compact(F.array(*[F.when(F.col(c), c) for c in labels]))).scalar()
    long = filled.unpivot(list(ids), list(labels), names_to, values_to)
    return long.where(F.array_contains(seen, F.col(names_to)))


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times; rows with 0 or a missing count disappear."""
    kept = df.where(F.col(times) > 0)
    copies = kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return copies.drop("_copy", times)
