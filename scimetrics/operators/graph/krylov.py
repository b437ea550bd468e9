"""Krylov bases of many graphs at once, over packed blocks of vertices and edges.

The vertices of a cell lie in blocks of at most BLOCK; a vector is a row of
packed numbers per block, and the edges between two blocks are rows of packed
codes. A step multiplies every cell's newest vector by its matrix: edge rows
join the vector of their source block, what they send is added up per receiving
block. As the matrix is symmetric, a step needs the two newest vectors only
(Lanczos); each step's vectors stay in a table of their own, and all tables are
read once, when the coefficients of the answer are known. The sums that a step
needs over a whole cell, five numbers, are all that reaches the driver, where
each cell's small projected problem is solved. Cells whose residual is small
enough take no more steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.operators.graph.network import VERTEX, Network
from scimetrics.session import WorkTables, materialize

BLOCK = 2048
#: Receiving vertices of one row of edges, which bounds its codes to BLOCK x STRIPE.
STRIPE = 128
SPENT = 1e-14
#: Leading values of components that differ by less, relative to their size, count as one.
EQUAL = 1e-12
#: Packed entries of the matrix in one partition.
TASK_EDGES = 250_000
BLOCK_KEY = ["cell", "block"]
STATE = "cell long, block long, size int, last binary, before binary, moved binary"


@dataclass
class Blocks:
    """numbers(cell, id, block, spot) of the vertices and edges(cell, block, to, codes, weights)."""

    numbers: DataFrame
    edges: DataFrame


#: Entry of the matrix from m and the degrees of both ends, of columns or of arrays.
Weight = Callable[[Any, Any, Any], Any]
#: Start of a vertex from its degree.
Start = Callable[[Any], Any]


def pack(network: Network, weight: Weight) -> Blocks:
    """Vertices in blocks by order, edges between blocks in stripes."""
    ordered = network.vertices.select(*VERTEX, "degree").repartitionByRange(*VERTEX).sortWithinPartitions(*VERTEX)
    at = F.monotonically_increasing_id()
    numbers = materialize(
        ordered.select(*VERTEX, "degree", F.floor(at / BLOCK).alias("block"), (at % BLOCK).cast("int").alias("spot")),
        "numbers",
    )
    here = numbers.withColumnsRenamed({"id": "src"})
    there = numbers.withColumnsRenamed({"id": "dst", "block": "to", "spot": "spot_to", "degree": "degree_to"})
    flow = network.flow.join(here, ["cell", "src"]).join(there, ["cell", "dst"])
    # code and weight travel in one struct, so that they stay together
    value = weight(F.col("m"), F.col("degree"), F.col("degree_to")).cast("double")
    entry = F.struct((F.col("spot") * BLOCK + F.col("spot_to")).alias("code"), value.alias("weight"))
    packed = (
        flow.withColumn("stripe", F.floor(F.col("spot_to") / STRIPE))
        .groupBy("cell", "block", "to", "stripe")
        .agg(F.collect_list(entry).alias("e"))
        .select("cell", "block", "to", F.col("e.code").alias("codes"), F.col("e.weight").alias("weights"))
    )
    return Blocks(numbers, materialize(packed, "block-edges"))


def _vectors(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """First basis vector of every block, from rows (cell, block, spots, values)."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            x = np.zeros(width)
            x[np.asarray(row.spots, np.int64)] = np.asarray(row.values, float)
            rows.append((row.cell, row.block, width, x.tobytes(), b"", b""))
        yield pd.DataFrame(rows, columns=["cell", "block", "size", "last", "before", "moved"])


def _grown(batches: Iterator[pd.DataFrame], combine: dict[int, tuple[np.ndarray, float]]) -> Iterator[pd.DataFrame]:
    """The next vector of every block, (moved - newest vectors x coefficients) / norm."""
    for batch in batches:
        grown = []
        for row in batch.itertuples(index=False):
            newest = np.frombuffer(row.before + row.last).reshape(-1, row.size)
            coefficients, norm = combine[row.cell]
            grown.append(((np.frombuffer(row.moved) - coefficients @ newest) / norm).tobytes())
        yield batch.assign(before=batch["last"], last=grown)


def _sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the blocks of edges send: spots and values for each receiving block."""
    for batch in batches:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for row in batch.itertuples(index=False):
            x, code = np.frombuffer(row.last), np.asarray(row.codes)
            width = len(x)
            add = np.bincount(code % width, np.asarray(row.weights) * x[code // width], width)
            key = row.cell, row.to
            sums[key] = sums[key] + add if key in sums else add
        rows = []
        for (cell, block), total in sums.items():
            spots = np.flatnonzero(total)
            rows.append((cell, block, spots.astype(np.int32).tobytes(), total[spots].tobytes()))
        yield pd.DataFrame(rows, columns=["cell", "block", "spots", "added"])


def _received(sent: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """The newest vector of a block times the matrix, and the block's part of the sums over the cell."""
    row = own.iloc[0]
    moved = np.zeros(row["size"])
    for spots, added in zip(sent["spots"], sent["added"]):
        moved[np.frombuffer(spots, np.int32)] += np.frombuffer(added)
    last = np.frombuffer(row["last"])
    before = np.frombuffer(row["before"]) if row["before"] else np.zeros(row["size"])
    sums = [before @ moved, last @ moved, before @ last, last @ last, moved @ moved]
    return pd.DataFrame(
        {
            "cell": [row["cell"]],
            "block": [row["block"]],
            "size": [row["size"]],
            "last": [row["last"]],
            "before": [row["before"]],
            "moved": [moved.tobytes()],
            "sums": [sums],
        }
    )


def _step(state: DataFrame, edges: DataFrame) -> DataFrame:
    last = state.select(*BLOCK_KEY, "last")
    sent = edges.join(last, BLOCK_KEY).select("cell", "to", "codes", "weights", "last")
    sent = sent.mapInPandas(_sent, "cell long, block long, spots binary, added binary")
    return (
        sent.groupBy(*BLOCK_KEY)
        .cogroup(state.groupBy(*BLOCK_KEY))
        .applyInPandas(_received, f"{STATE}, sums array<double>")
    )


@dataclass
class Projected:
    """Small problem of one cell: products of the basis vectors with each other and through the matrix.

    gram[i, j] = q_i . q_j, through[i, j] = q_i . A q_j, rest = length of the part of A q_last outside the basis.
    Both are measured for neighbouring vectors; the products of others are zero, up to the rounding that
    comes up when an answer has settled. ``coefficients`` belong to the two newest vectors.
    """

    gram: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    through: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    rest: float = 0.0
    spent: bool = False
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def grow(self, sums: np.ndarray) -> None:
        k = len(self.gram) + 1
        newest = min(k, 2)
        moved, own, length = sums[:2][-newest:], sums[2:4][-newest:], sums[4]
        for name, column in (("gram", own), ("through", moved)):
            larger = np.zeros((k, k))
            larger[:-1, :-1] = getattr(self, name)
            larger[-newest:, -1] = larger[-1, -newest:] = column
            setattr(self, name, larger)
        self.coefficients = np.linalg.solve(self.gram[-newest:, -newest:], moved)
        outside = max(length - self.coefficients @ moved, 0.0)
        self.rest = float(np.sqrt(outside))
        # a difference of this size is rounding: the space has no further dimension
        self.spent = bool(outside <= SPENT * length)

    def ritz(self) -> tuple[np.ndarray, np.ndarray]:
        """Values, falling, and coefficient vectors of unit length of the projected matrix."""
        root = np.linalg.inv(np.linalg.cholesky(self.gram))
        values, vectors = np.linalg.eigh(root @ self.through @ root.T)
        return values[::-1], (root.T @ vectors)[:, ::-1]


#: From a projected problem: coefficients of the answer in the basis, and its residual per unit of its length.
Solve = Callable[[Projected], tuple[np.ndarray, float]]


def _shares(batches: Iterator[pd.DataFrame], answer: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Every vector times its coefficient in the answer, added up per block of a batch."""
    for batch in batches:
        total: dict[tuple[int, int], np.ndarray] = {}
        for row in batch.itertuples(index=False):
            share = answer[row.cell][row.step] * np.frombuffer(row.last)
            key = row.cell, row.block
            total[key] = total[key] + share if key in total else share
        rows = [(cell, block, x.tobytes()) for (cell, block), x in total.items()]
        yield pd.DataFrame(rows, columns=["cell", "block", "share"])


def _answers(shares: pd.DataFrame) -> pd.DataFrame:
    x = np.sum([np.frombuffer(share) for share in shares["share"]], axis=0)
    return pd.DataFrame({"cell": shares["cell"].iloc[0], "block": shares["block"].iloc[0], "spot": np.arange(len(x)), "x": x})


def _lanczos(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray, small: Solve, tolerance: float, most: int) -> np.ndarray | None:
    """The answer of ``small`` in the Krylov space of ``start``; None if it has not settled after ``most`` steps."""
    problem, taken = Projected(), []
    before, last = np.zeros_like(start), start
    while True:
        moved = times(last)
        problem.grow(np.array([before @ moved, last @ moved, before @ last, last @ last, moved @ moved]))
        coefficients, residual = small(problem)
        if residual <= tolerance or problem.spent:
            break
        if len(taken) + 1 == most:
            return None
        taken.append((problem.coefficients, problem.rest))
        before, last = last, _next(before, last, moved, *taken[-1])
    # the same vectors once more, as all of them together may be too large to keep
    before, last, total = np.zeros_like(start), start, coefficients[0] * start
    for share, step in zip(coefficients[1:], taken):
        before, last = last, _next(before, last, times(last), *step)
        total += share * last
    return total


def _next(before: np.ndarray, last: np.ndarray, moved: np.ndarray, combine: np.ndarray, norm: float) -> np.ndarray:
    rest = moved - combine[-1] * last
    if len(combine) > 1:
        rest -= combine[0] * before
    return rest / norm


def _components(first: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest vertex of the component of every vertex, links lying by sending vertex."""
    root = np.arange(len(first))
    while True:
        low = np.minimum(root, np.minimum.reduceat(root[dst], first))
        hooked = low.copy()
        np.minimum.at(hooked, root, low)
        hooked = hooked[hooked]
        if np.array_equal(hooked, root):
            return root
        root = hooked


def _leading(first: np.ndarray, dst: np.ndarray, w: np.ndarray, start: np.ndarray, solved: Callable) -> np.ndarray | None:
    """The part of ``start`` in the space of the leading value, component by component.

    Each component settles by itself, whatever the values of others are. Those
    that the products of their ends' sums keep below the largest value found are passed over.
    """
    root = _components(first, dst)
    order = np.argsort(root, kind="stable")
    bounds = np.flatnonzero(np.diff(root[order], prepend=-1, append=len(root)))
    spot = np.empty(len(root), np.int64)
    spot[order] = np.arange(len(root))
    count = np.diff(first, append=len(dst))[order]
    begin = np.cumsum(count) - count
    link = np.arange(len(dst)) + np.repeat(first[order] - begin, count)
    to, w = spot[dst[link]], w[link]
    sums = np.add.reduceat(w, begin)
    most = np.sqrt(np.maximum.reduceat(np.repeat(sums, count) * sums[to], begin[bounds[:-1]]))
    found, best = [], 0.0
    for part in np.argsort(-most, kind="stable").tolist():
        if most[part] < best * (1 - EQUAL):
            break
        low, high = bounds[part], bounds[part + 1]
        i, j = begin[low], begin[high] if high < len(begin) else len(to)
        near, weights, ahead, own = to[i:j] - low, w[i:j], begin[low:high] - i, start[order[low:high]]
        times = lambda x: np.add.reduceat(weights * x[near], ahead)
        x = solved(times, own)
        if x is None:
            return None
        value = np.linalg.norm(times(x)) / np.linalg.norm(x)
        best = max(best, value)
        found.append((value, order[low:high], x * (x @ own) / (x @ x)))
    answer = np.zeros(len(root))
    for value, members, x in found:
        if value >= best * (1 - EQUAL):
            answer[members] = x
    return answer


def _cells(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[pd.DataFrame]]]:
    """The rows of one cell after the other."""
    cell, parts = None, []
    for frame in frames:
        for key, part in frame.groupby("cell", sort=False):
            if key != cell and parts:
                yield cell, parts
                parts = []
            cell = key
            parts.append(part.drop(columns="cell"))
    if parts:
        yield cell, parts


def _solved(
    frames: Iterator[pd.DataFrame], weight: Weight, start: Start, small: Solve, tolerance: float, most: int, leading: bool
) -> Iterator[pd.DataFrame]:
    """(cell, id, x) of whole cells; one row without x for a cell that has not settled."""
    for cell, parts in _cells(frames):
        src, dst, m = (np.concatenate([part[c].to_numpy() for part in parts]) for c in ("src", "dst", "m"))
        parts.clear()
        begin = np.flatnonzero(np.diff(src, prepend=src[0] - 1))
        ids = src[begin]
        dst = np.searchsorted(ids, dst).astype(np.int32)
        count = np.diff(begin, append=len(src))
        degree = np.add.reduceat(m, begin).astype(float)
        w = weight(m, np.repeat(degree, count), degree[dst]).astype(float)
        own = start(degree)
        solved = partial(_lanczos, small=small, tolerance=tolerance, most=most)
        if leading:
            x = _leading(begin, dst, w, own, solved)
        else:
            x = solved(lambda x: np.add.reduceat(w * x[dst], begin), own)
        yield pd.DataFrame({"cell": cell, "id": ids[:1], "x": [None]} if x is None else {"cell": cell, "id": ids, "x": x})


def solve(
    network: Network, weight: Weight, start: Start, small: Solve, tolerance: float, most: int, leading: bool = False
) -> DataFrame:
    """(cell, id, x): the answer of ``small`` in the Krylov space of ``start`` under a symmetric matrix.

    ``weight`` gives the entry of an edge and ``start`` that of a vertex. Steps
    go on until the residual of every cell is below ``tolerance`` or its space
    has no further dimension; after ``most`` steps the job raises. ``leading``
    says that the answer is the part of the start in the space of the largest
    value, which the components of a cell may settle apart. Cells of up to
    BLOCK x BLOCK vertices and links are solved by a task each.
    """
    size = F.sum(1 + F.col("neighbours")).alias("size")
    # a row for each cell reaches the driver
    large = [r["cell"] for r in network.vertices.groupBy("cell").agg(size).where(F.col("size") > BLOCK * BLOCK).collect()]
    inside = F.col("cell").isin(large)
    flow = network.flow.where(~inside & F.col("src").isNotNull() & F.col("dst").isNotNull())
    # a stated number of partitions is kept, else few cells of much work would end in one task
    partitions = max(4 * flow.sparkSession.sparkContext.defaultParallelism, int(flow.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = flow.repartition(partitions, "cell").sortWithinPartitions("cell", "src", "dst")
    settle = partial(_solved, weight=weight, start=start, small=small, tolerance=tolerance, most=most, leading=leading)
    whole = materialize(cells.mapInPandas(settle, "cell long, id long, x double"), "answers-of-cells")
    if not whole.where("x is null").isEmpty():
        raise RuntimeError(f"residuals are still above {tolerance} after {most} steps")
    if not large:
        return whole
    rest = Network(network.cells, network.flow.where(inside), network.vertices.where(inside))
    return whole.unionByName(_by_steps(rest, weight, start, small, tolerance, most))


def _by_steps(network: Network, weight: Weight, start: Start, small: Solve, tolerance: float, most: int) -> DataFrame:
    """The answers of large cells, a job for each step.

    A step writes three vectors, which are kept to the end, as the answer is
    summed up from the tables of all steps.
    """
    spark = network.vertices.sparkSession
    blocks = pack(network, weight)
    first = (
        blocks.numbers.select("cell", "block", "spot", start(F.col("degree")).cast("double").alias("x"))
        .groupBy(*BLOCK_KEY)
        .agg(F.collect_list(F.struct("spot", "x")).alias("e"))
        .select("cell", "block", F.col("e.spot").alias("spots"), F.col("e.x").alias("values"))
    )
    # a stated number of partitions is kept, else few large rows would end in one task
    entries = blocks.edges.agg(F.sum(F.size("codes")).alias("n")).first()["n"] or 0
    partitions = max(spark.sparkContext.defaultParallelism, -(-entries // TASK_EDGES))
    edges = blocks.edges.repartition(partitions, *BLOCK_KEY).persist(StorageLevel.MEMORY_AND_DISK)
    # the basis begins with the start as it is; a cell's first vectors are brought to length one by its norm
    state = first.mapInPandas(partial(_vectors, width=BLOCK), STATE)
    problems: dict[int, Projected] = {}
    answer: dict[int, np.ndarray] = {}
    with WorkTables(spark) as work:
        steps: list[DataFrame] = []
        try:
            while True:
                taken = work.keep(_step(state, edges), "krylov")
                steps.append(taken.select(*BLOCK_KEY, F.lit(len(steps)).alias("step"), "last"))
                # a few numbers per cell and step reach the driver
                sums = taken.groupBy("cell").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(5)])
                combine = {}
                for cell, *numbers in sums.collect():
                    problem = problems.setdefault(cell, Projected())
                    problem.grow(np.array(numbers))
                    coefficients, residual = small(problem)
                    if residual <= tolerance or problem.spent:
                        answer[cell] = coefficients
                    else:
                        combine[cell] = problem.coefficients, problem.rest
                if not combine:
                    break
                if len(steps) == most:
                    raise RuntimeError(f"residuals are still above {tolerance} after {most} steps")
                going = taken.drop("sums").where(F.col("cell").isin(list(combine)))
                state = going.mapInPandas(partial(_grown, combine=combine), STATE)
        finally:
            edges.unpersist()
        shares = reduce(DataFrame.unionByName, steps).mapInPandas(
            partial(_shares, answer=answer), "cell long, block long, share binary"
        )
        found = shares.groupBy(*BLOCK_KEY).applyInPandas(_answers, "cell long, block long, spot int, x double")
        values = materialize(found, "answers")
    return blocks.numbers.join(values, ["cell", "block", "spot"]).select(*VERTEX, "x")
