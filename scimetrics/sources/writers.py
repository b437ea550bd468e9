"""Outputs: plain and partitioned Parquet, resumable cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimetrics.operators.joins import join_na

CELL = ("field", "quin")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_ordered(df: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """One table in total order: its files, read by name, are sorted by ``order``.

    The remaining columns break ties, so that the ranges also cut the rows of
    one frequent value; only rows equal in all columns stay together.
    """
    _ranged(df, order).write.mode("overwrite").parquet(path)


def _ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    named = {c for c in order if isinstance(c, str)}
    return df.orderBy(*order, *[F.col(f"`{c}`") for c in df.columns if c not in named])


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder per value of ``by``.

    The rebalance hint gathers small partitions and splits large ones, so a
    value with most of the rows is written by several tasks.
    """
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_cells(
    df: DataFrame, path: str, by: Sequence[str] = CELL, sort: Sequence[str | Column] = ()
) -> None:
    """Write the cells present in ``df`` and leave the other cells of the folder alone.

    With ``sort`` each cell is in total order over its files, read by name; a
    cell with most of the rows is cut into several ranges.
    """
    laid_out = _ranged(df, [*by, *sort]) if sort else df.hint("rebalance", *by).sortWithinPartitions(*by)
    (
        laid_out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def missing_cells(grid: DataFrame, path: str, by: Sequence[str] = CELL) -> DataFrame:
    """Cells of ``grid`` that have no folder yet; all of them before the first run."""
    spark = grid.sparkSession
    try:
        written = spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return grid
    return join_na(grid, written.select(*by).distinct(), list(by), "left_anti")
