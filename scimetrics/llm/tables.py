"""Work tables, joins by checked size, connected components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimetrics.session import materialize

BROADCAST_BYTES = 16 << 20


def checked(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows fit ``limit``, else as it is.

    ``small`` should be a work table, so that counting reads only its footers.
    Without the hint the join shuffles both sides and AQE splits hot keys.
    """
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def id_columns(id_col: str, name: str = "doc_id") -> list[Column]:
    """The id as two columns without nulls: pandas would turn a nullable long into a double."""
    wanted = F.col(id_col).cast("long")
    return [F.coalesce(wanted, F.lit(0)).alias(name), wanted.isNull().alias("no_id")]


def known_ids(frame: pd.DataFrame, name: str = "doc_id") -> pd.Series:
    """The nullable ids of a batch that holds ``id_columns``."""
    return frame[name].astype("Int64").mask(frame["no_id"].astype(bool))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of ``edges(a, b)``; the root is the smallest node reachable.

    Alternating large-star and small-star steps. The smallest neighbour is
    written before it is joined back, so both sides of that join come straight
    from a shuffle and a hub with most of the edges is split at run time.
    """
    now = materialize(
        edges.where("a <> b").select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).distinct(),
        "links",
    )
    mark = None
    while True:
        turned = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        around = now.unionByName(turned)
        lowest = materialize(
            around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")),
            "lowest",
        )
        large = around.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "links")
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.col("v").alias("u"), "m")
        small = small.unionByName(lowest.select("u", "m")).where("u <> m")
        now = materialize(small.select("u", F.col("m").alias("v")).distinct(), "links")
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    leaf = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaf.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
