"""PCA whitening of vectors through distributed block matrices.

Vectors become fixed-point integers, so that sums and centring are exact. The
centred rows get consecutive numbers and form a block matrix; its transpose
times itself is the scatter, whose eigenvectors are found locally, and the
block matrix times the whitening matrix projects all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scimetrics.llm.tables import checked
from scimetrics.session import materialize

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Entries beyond this would not leave room for exact 64-bit sums over billions of rows.
LARGEST = float(1 << 24)
BLOCK_ROWS = 1024
MOST_BLOCKS = 1 << 16
BLOCK_COLUMNS = 1024
#: Block rows whose products one task adds up.
GROUP_BLOCKS = 16


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows with a vector of the commonest length (ties: the greater one) without null, non-finite or huge entries."""
    entries = F.col(vector_col).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    kept = df.where(F.col(vector_col).isNotNull()).where(fine)
    sizes = kept.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n"))
    commonest = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return kept.where(F.size(vector_col) == (commonest["d"] if commonest else 0))


def numbered(df: DataFrame) -> DataFrame:
    """``df``, written, with a column ``index`` from 0 without gaps.

    Rows are counted within their partition of the written table; the offsets
    have a row for each partition, not for each row of ``df``.
    """
    place = F.monotonically_increasing_id()
    placed = df.withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND((1 << 33) - 1)})
    placed = materialize(placed, "numbered")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    parts = parts.select("_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    parts = checked(materialize(parts, "offsets"), 16)
    index = (F.col("_at") + F.col("_ahead")).alias("index")
    return placed.join(parts, "_part").select(index, *df.columns)


def column_sums(df: DataFrame, vector_col: str) -> list:
    """Sum of every entry, in order; a row for each dimension reaches the driver."""
    entries = df.select(F.posexplode(vector_col).alias("d", "x"))
    return [r["s"] for r in entries.groupBy("d").agg(F.sum("x").alias("s")).orderBy("d").collect()]


def block_matrix(df: DataFrame, vector_col: str, n: int, dimensions: int) -> BlockMatrix:
    """Rows (index, ``vector_col``) as blocks; their height grows so that the driver lists at most MOST_BLOCKS."""
    rows = df.select("index", array_to_vector(F.col(vector_col)).alias("vector"))
    rows = MLUtils.convertVectorColumnsFromML(rows, "vector")
    height = max(BLOCK_ROWS, -(-n // MOST_BLOCKS))
    return IndexedRowMatrix(rows, n, dimensions).toBlockMatrix(height, BLOCK_COLUMNS)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, a square of the number of columns.

    The rows are summed in groups of blocks (the middle splits of the product),
    because without them all blocks would meet in the task of the one result block.
    """
    groups = max(1, -(-matrix.numRowBlocks // GROUP_BLOCKS))
    wrapper = matrix._java_matrix_wrapper
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", wrapper._java_model, groups)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _unpacked(batches: Iterator[pd.DataFrame], height: int, width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row, values in zip(batch["row"].tolist(), batch["values"]):
            block = np.frombuffer(values, np.float64).reshape(width, -1).T
            first = row * height
            yield pd.DataFrame({"index": np.arange(first, first + len(block)), "projected": list(block)})


def projected_rows(spark: SparkSession, matrix: BlockMatrix, whitening: np.ndarray) -> DataFrame:
    """(index, projected): the rows times a matrix of at most BLOCK_COLUMNS columns."""
    down, across = whitening.shape
    blocks = []
    for i in range(0, down, BLOCK_COLUMNS):
        part = whitening[i : i + BLOCK_COLUMNS]
        blocks.append(((i // BLOCK_COLUMNS, 0), DenseMatrix(len(part), across, part.ravel(order="F").tolist())))
    right = BlockMatrix(spark.sparkContext.parallelize(blocks, 1), BLOCK_COLUMNS, BLOCK_COLUMNS, down, across)
    product = matrix.multiply(right)
    # one column of blocks: each block holds whole rows and travels as bytes
    packed = product.blocks.map(lambda b: (int(b[0][0]), bytearray(b[1].values.tobytes())))
    table = spark.createDataFrame(packed, "row long, values binary")
    return table.mapInPandas(
        partial(_unpacked, height=matrix.rowsPerBlock, width=across), "index long, projected array<double>"
    )


@dataclass
class Whitened:
    """Fitted components and the projected rows.

    rows           the input columns, deviation decimal(38,0), whitened array<double>
    n, mean        of the rows, mean in the units of the fixed-point entries
    eigenvalues    of their covariance, falling; eigenvectors as columns
    explained      share of the trace of each component
    identity_error largest entry of the covariance of ``whitened`` minus the identity
    """

    rows: DataFrame
    n: int
    mean: np.ndarray
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitened:
    """Whiten the vectors of ``df`` on their leading principal components.

    Every entry c is used as x = floor(64 c) + 1000000. ``deviation`` is the
    exact sum over the dimensions of (n x - sum of x)^2. All rows are fitted
    and projected. Left out are rows whose vector is null or holds a null,
    non-finite or huge (over 2^24) entry, and rows of another length than the
    commonest; the other columns come back as they are. Components without
    variance have no scale and are left out, so equal rows, one row or an
    empty table have none: ``rows`` then hold empty ``whitened``.
    """
    spark = df.sparkSession
    if not 1 <= components <= BLOCK_COLUMNS:
        raise ValueError(f"from 1 to {BLOCK_COLUMNS} components can be asked for")
    # the input travels as one column, so that its names cannot clash with those added here
    whole = df.select(F.struct("*").alias("row"), F.col(vector_col).alias("v"))
    x = F.transform(F.col("v").cast("array<double>"), lambda c: F.floor(SCALE * c) + F.lit(SHIFT))
    rows = numbered(usable(whole, "v").select("row", x.alias("x")))
    n, sums = rows.count(), column_sums(rows, "x")
    d = len(sums)
    empty = np.empty(0)
    if not n or not d:
        none = F.array().cast("array<double>").alias("whitened")
        bare = rows.select("row.*", F.lit(0).cast("decimal(38,0)").alias("deviation"), none)
        return Whitened(bare, n, empty, empty, empty.reshape(0, 0), empty, 0.0)

    total = F.lit(sums)
    apart = F.zip_with("x", total, lambda a, s: n * a - s)
    square = lambda t: t.cast("decimal(19,0)") * t.cast("decimal(19,0)")
    deviation = F.aggregate(
        apart,
        F.lit(0).cast("decimal(38,0)"),
        lambda so_far, t: (so_far + square(t)).cast("decimal(38,0)"),
    )
    centred = F.transform(apart, lambda t: t.cast("double") / F.lit(float(n)))
    ready = materialize(
        rows.select("index", "row", deviation.alias("deviation"), centred.alias("centred")), "centred"
    )

    matrix = block_matrix(ready, "centred", n, d)
    covariance = scatter(matrix) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    rank = int((values > max(trace, 1e-300) * d * np.finfo(float).eps).sum())
    k = min(components, rank)
    values, vectors = values[:k], vectors[:, :k]
    mean = np.array(sums, float) / n
    if not k:
        bare = ready.select("row.*", "deviation", F.array().cast("array<double>").alias("whitened"))
        return Whitened(bare, n, mean, empty, empty.reshape(d, 0), empty, 0.0)

    projected = materialize(projected_rows(spark, matrix, vectors / np.sqrt(values)), "projected")
    middle = [s / n for s in column_sums(projected, "projected")]
    level = F.zip_with("projected", F.lit(middle), lambda a, m: a - m)
    again = block_matrix(projected.select("index", level.alias("level")), "level", n, k)
    error = float(np.abs(scatter(again) / n - np.eye(k)).max())
    result = ready.join(projected, "index").select("row.*", "deviation", F.col("projected").alias("whitened"))
    return Whitened(result, n, mean, values, vectors, values / trace, error)


def component_rows(found: Whitened, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is a long here; a table for which it is too great raises.
    """
    shares = F.lit([float(s) for s in found.explained]) if found.n and len(found.explained) else F.array(F.lit(0.0))
    exploded = found.rows.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return exploded.select(
        id_col,
        (F.col("at") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
