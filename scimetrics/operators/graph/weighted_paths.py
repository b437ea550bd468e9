"""Betweenness over weighted edges, the distance of an edge being 1 / weight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimetrics.operators.graph.network import CELL, VERTEX, Network, incidences
from scimetrics.operators.graph.paths import LIVE_ROWS, positions
from scimetrics.operators.joins import join_na
from scimetrics.session import WorkTables, materialize

TOLERANCE = 1e-10
#: sources side by side in a row, a column for each
LANES = 16
ROW = ["cell", "id", "block"]


def _lanes(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(LANES)]


def _bit(mask: str, lane: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << lane)) != 0


def _mask(conditions: list[Column]) -> Column:
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)]
    return reduce(lambda a, b: a + b, bits)


def _some(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns])


def _summed(parts: list[DataFrame], name: str) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(*ROW).agg(*[F.sum(c).alias(c) for c in _lanes(name)])


def _roads(network: Network, edges: DataFrame, weight: str) -> DataFrame:
    """Shortest length between neighbours and how many parallel edges have it.

    A pair has at most two edges, one per orientation. An edge without a
    positive weight is no road. ``width`` is the mean length in the cell.
    """
    weighted = edges.where(F.col(weight) > 0)
    lengths = incidences(weighted.select(*CELL, "from", "to", (1.0 / F.col(weight)).alias("length")))
    roads = (
        join_na(lengths, network.cells, CELL)
        .where(F.col("id") != F.col("other"))
        .groupBy("cell", F.col("id").alias("src"), F.col("other").alias("dst"))
        .agg(F.min("length").alias("length"), F.max("length").alias("longest"), F.count("*").alias("k"))
    )
    equal = F.col("longest") <= F.col("length") * (1 + TOLERANCE)
    width = roads.groupBy("cell").agg(F.avg("length").alias("width"))
    return roads.join(width, "cell").select(
        "cell", "src", "dst", "length", F.when(equal, F.col("k")).otherwise(1).alias("m"), "width"
    )


def _distances(sources: DataFrame, roads: DataFrame, widths: DataFrame, work: WorkTables) -> DataFrame:
    """(cell, id, block, d0, d1, …): distance of every vertex from the sources of every block.

    Delta-stepping (Meyer and Sanders 2003) for all sources of the group at
    once: only entries that came closer and lie in the lowest open bucket of
    their block's tentative distances, which begins at the nearest, pass theirs on; ``open`` holds as bits
    which entries still have to. A bucket is as wide as the cell's mean road.
    """
    far = F.lit(float("inf"))
    d, offered = _lanes("d"), _lanes("o")
    state = work.keep(
        sources.join(widths, "cell").select(
            *ROW,
            "width",
            *[F.when(F.col("lane") == i, 0.0).otherwise(far).alias(c) for i, c in enumerate(d)],
            F.expr("shiftleft(1, cast(lane as int))").alias("open"),
        ),
        "distances",
    )
    nearest = F.least(*[F.when(_bit("open", i), F.col(c)).otherwise(far) for i, c in enumerate(d)])
    limit = F.coalesce("limit", F.lit(0.0))
    goes = [_bit("open", i) & (F.col(c) < limit) for i, c in enumerate(d)]
    sends = reduce(lambda a, b: a | b, goes)
    going = [F.when(g, F.col(c)).otherwise(far).alias(c) for g, c in zip(goes, d)]
    waits = F.col("open").bitwiseAND(F.bitwise_not(_mask(goes))).alias("open")
    unknown, unoffered = [far.alias(c) for c in d], [far.alias(o) for o in offered]
    longer = [(F.col(c) + F.col("length")).alias(o) for c, o in zip(d, offered)]
    best = [F.max("width").alias("width"), F.max("open").alias("open"), *[F.min(c).alias(c) for c in d + offered]]
    closer = [F.col(o) < F.col(c) * (1 - TOLERANCE) for c, o in zip(d, offered)]
    settled = [F.when(w, F.col(o)).otherwise(F.col(c)).alias(c) for w, c, o in zip(closer, d, offered)]
    opened = F.col("open").bitwiseOR(_mask(closer)).alias("open")
    while True:
        waiting = state.where(F.col("open") != 0)
        if waiting.isEmpty():
            return state.select(*ROW, *d)
        lowest = waiting.groupBy("cell", "block", "width").agg(F.min(nearest).alias("near"))
        limits = lowest.select("cell", "block", (F.col("near") + F.col("width")).alias("limit"))
        limited = state.join(limits, ["cell", "block"], "left")
        front = limited.where(sends).select("cell", F.col("id").alias("src"), "block", *going)
        offers = front.join(roads, ["cell", "src"]).select(
            "cell", F.col("dst").alias("id"), "block", "width", F.lit(0).alias("open"), *unknown, *longer
        )
        known = limited.select(*ROW, "width", waits, *d, *unoffered)
        met = known.unionByName(offers).groupBy(*ROW).agg(*best)
        state = work.keep(met.select(*ROW, "width", *settled, opened), "distances")


def _tight(distances: DataFrame, roads: DataFrame) -> DataFrame:
    """Roads that lie on a shortest path away from a source; ``on`` tells as bits from which of the block."""
    d = _lanes("d")
    here = distances.withColumnRenamed("id", "src")
    there = distances.select("cell", F.col("id").alias("dst"), "block", *[F.col(c).alias(f"t{c}") for c in d])
    on = _mask(
        [
            (F.col(f"t{c}") < float("inf"))
            & (F.abs(F.col(c) + F.col("length") - F.col(f"t{c}")) <= TOLERANCE * F.col(f"t{c}"))
            for c in d
        ]
    )
    return (
        here.join(roads, ["cell", "src"])
        .join(there, ["cell", "dst", "block"])
        .select("cell", "src", "dst", "block", "m", on.alias("on"))
        .where(F.col("on") != 0)
    )


def _walks(start: DataFrame, tight: DataFrame, name: str, work: WorkTables) -> list[DataFrame]:
    """``start``, then what it sums up to over tight roads step by step until nothing is left.

    ``tight(cell, from, id, block, m, on)`` is directed, without cycles, so the
    steps end by themselves; entries that have no further road send nothing.
    """
    x = _lanes(name)
    passed = [F.when(_bit("on", i), F.col(c) * F.col("m")).otherwise(0.0).alias(c) for i, c in enumerate(x)]
    some = _some(x)
    steps = [start]
    while True:
        sent = steps[-1].withColumnRenamed("id", "from").join(tight, ["cell", "from", "block"]).select(*ROW, *passed)
        step = work.keep(_summed([sent], name).where(some), f"walks-{name}")
        if step.isEmpty():
            return steps
        steps.append(step)


def _group_dependencies(sources: DataFrame, roads: DataFrame, widths: DataFrame, work: WorkTables) -> DataFrame:
    """(cell, id, dependency): what the sources of a group add to every vertex.

    With p the number of shortest paths and g = (1 + dependency) / p, Brandes'
    recursion is g(u) = 1 / p(u) + the sum of m g(v) over tight roads (u, v). So
    both ways are sums over the walks of one directed graph without cycles.
    """
    distances = _distances(sources, roads, widths, work)
    tight = work.keep(_tight(distances, roads), "tight")
    p, g = _lanes("p"), _lanes("g")
    start = sources.select(*ROW, *[F.when(F.col("lane") == i, 1.0).otherwise(0.0).alias(c) for i, c in enumerate(p)])
    out = tight.withColumnsRenamed({"src": "from", "dst": "id"})
    counts = work.keep(_summed(_walks(start, out, "p", work), "p"), "counts")
    ends = counts.select(*ROW, *[F.when(F.col(c) > 0, 1.0 / F.nullif(F.col(c), F.lit(0.0))).otherwise(0.0).alias(h) for c, h in zip(p, g)])
    back = tight.withColumnsRenamed({"dst": "from", "src": "id"})
    later = _walks(ends, back, "g", work)[1:]
    if not later:
        return sources.select(*VERTEX, F.lit(0.0).alias("dependency"))
    # a source is no inner vertex of its own paths
    own = sources.select(*ROW, "lane")
    both = _summed(later, "g").join(counts, ROW).join(own, ROW, "left")
    terms = [
        F.when(F.col("lane").eqNullSafe(F.lit(i)), 0.0).otherwise(F.col(a) * F.col(b))
        for i, (a, b) in enumerate(zip(g, p))
    ]
    return (
        both.select(*VERTEX, reduce(lambda a, b: a + b, terms).alias("dependency"))
        .groupBy(*VERTEX)
        .agg(F.sum("dependency").alias("dependency"))
    )


def weighted_betweenness(
    network: Network, edges: DataFrame, weight: str, live_rows: int = LIVE_ROWS
) -> DataFrame:
    """Exact betweenness with ``1 / weight`` as length, near-equal paths counting as equal.

    All vertices are sources. Sixteen lie side by side in a row of the search;
    groups of them follow one another, each leaving one row per vertex, so that
    the (source, vertex) entries that live at a time follow ``live_rows``.
    Vertices without a road have 0.
    """
    roads = materialize(_roads(network, edges, weight), "roads")
    widths = roads.select("cell", "width").distinct()
    entries = network.vertices.agg(F.sum("n").alias("entries")).first()["entries"] or 0
    groups = max(1, -(-entries // live_rows))
    placed = positions(network, LANES).withColumnRenamed("bit", "lane")
    total = None
    for group in range(groups):
        own = placed.where(F.pmod("block", F.lit(groups)) == group)
        with WorkTables(network.vertices.sparkSession) as work:
            added = _group_dependencies(own, roads, widths, work)
            if total is not None:
                added = added.unionByName(total).groupBy(*VERTEX).agg(F.sum("dependency").alias("dependency"))
            total = materialize(added, "weighted-betweenness")
    value = F.coalesce("dependency", F.lit(0.0)) / 2
    return network.vertices.select(*VERTEX).join(total, VERTEX, "left").select(
        *VERTEX, value.alias("betweenness")
    )
