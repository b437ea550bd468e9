"""Keep-first distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = "_seq"
#: Types whose values a hash aggregation updates in place.
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def keep_first(
    df: DataFrame, keys: Sequence[str], order: str = ORDER, keep_order: bool = False
) -> DataFrame:
    """First row per key in ``order``; missing keys form one group.

    Aggregates combine on the map side, so a key that holds a large share of the
    rows reaches its reducer as one row per map task. A row-number window would
    send all of its rows to a single task. Rows of equal order go by their values.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    if not rest and not keep_order:
        return df.select(*keys).distinct()
    if all(isinstance(df.schema[c].dataType, FIXED) for c in [*rest, order]):
        # numbers alone stay in a hash table, without a sort; of equal orders all columns take the same row
        first = df.groupBy(*keys).agg(
            *[F.min_by(c, order).alias(c) for c in rest], *([F.min(order).alias(order)] if keep_order else [])
        )
        return first.select(*[c for c in df.columns if c != order], *([order] if keep_order else []))
    # one value that begins with the order, which travels once
    first = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_row"))
    columns = [F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns if c != order]
    return first.select(*columns, *([F.col(f"_row.{order}").alias(order)] if keep_order else []))
