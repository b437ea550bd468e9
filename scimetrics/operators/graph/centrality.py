"""PageRank, eigenvector centrality, hub scores, from Krylov spaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.operators.graph.krylov import Projected, solve
from scimetrics.operators.graph.network import VERTEX, Network

MOST_STEPS = 500
RESIDUAL = 1e-13


def pagerank(network: Network, damping: float = 0.85, tolerance: float = RESIDUAL) -> DataFrame:
    """PageRank per cell over unweighted, possibly parallel edges.

    Solves (I - d D^-1/2 A D^-1/2) y = (1 - d) / n D^-1/2 1, whose answer times
    D^1/2 are the ranks, by projecting on the Krylov space of the right side;
    this needs far fewer steps than passing ranks on does. ``tolerance`` bounds
    the residual relative to the right side. Every vertex is an edge end, so no
    rank is lost.
    """

    def small(problem: Projected) -> tuple[np.ndarray, float]:
        right = problem.gram[:, 0]
        c = np.linalg.solve(problem.gram - damping * problem.through, right)
        return c, damping * problem.rest * abs(c[-1]) / np.sqrt(problem.gram[0, 0])

    def weight(m, degree, degree_to):
        return m / (degree * degree_to) ** 0.5

    spread = solve(network, weight, lambda degree: 1 / degree**0.5, small, tolerance, MOST_STEPS)
    ranked = network.vertices.join(spread, VERTEX)
    value = F.col("x") * F.sqrt("degree") * (1 - damping) / F.col("n")
    return ranked.select(*VERTEX, value.alias("pagerank"))


def _parallel(m, degree, degree_to):
    """Number of parallel edges."""
    return m


def _one(degree):
    """The same value for all vertices."""
    return degree * 0.0 + 1.0


def _scaled(scores: DataFrame) -> DataFrame:
    """Largest value of each cell set to 1; values that are nothing but rounding become 0."""
    peaks = scores.groupBy("cell").agg(F.max(F.abs("x")).alias("peak"))
    share = F.col("x") / F.col("peak")
    return scores.join(peaks, "cell").select(*VERTEX, F.when(F.abs(share) < 1e-13, 0.0).otherwise(share).alias("x"))


def eigenvector(network: Network, tolerance: float = RESIDUAL) -> DataFrame:
    """Principal eigenvector per cell, largest value 1.

    The leading Ritz vector of the Krylov space of equal values, at a residual
    below ``tolerance`` times the eigenvalue. If several components share the
    leading value it is the part of equal values in their common space.
    """

    def small(problem: Projected) -> tuple[np.ndarray, float]:
        values, vectors = problem.ritz()
        c = vectors[:, 0] * np.sign(problem.gram[0] @ vectors[:, 0])
        return c, problem.rest * abs(c[-1]) / max(values[0], 1e-300)

    scores = solve(network, _parallel, _one, small, tolerance, MOST_STEPS, leading=True)
    return _scaled(scores).withColumnRenamed("x", "eigen")


def hub_scores(network: Network, tolerance: float = RESIDUAL) -> DataFrame:
    """Hub and authority scores per cell, the leading vector of A A with largest value 1.

    Both coincide on an undirected graph. A bipartite leading component also has
    the negative of the leading value, and equal values are then projected on
    both vectors; this is what powers of A A tend to.
    """

    def small(problem: Projected) -> tuple[np.ndarray, float]:
        values, vectors = problem.ritz()
        size = np.abs(values).max()
        leading = np.flatnonzero(np.abs(values) >= size * (1 - 1e-9))
        weights = problem.gram[0] @ vectors[:, leading]
        rest = problem.rest * np.abs(vectors[-1, leading]).max() / max(size, 1e-300)
        return vectors[:, leading] @ weights, rest

    scores = _scaled(solve(network, _parallel, _one, small, tolerance, MOST_STEPS, leading=True))
    return scores.select(*VERTEX, F.col("x").alias("hub"), F.col("x").alias("authority"))
