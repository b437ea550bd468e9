"""Co-author networks per field and period."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.functions.expressions import pair_share
from scimetrics.functions.periods import PERIOD_MODES
from scimetrics.operators.graph import centrality, paths, structure, weighted_paths
from scimetrics.operators.graph.communities import communities
from scimetrics.operators.graph.network import CELL, VERTEX, Network, build_network, incidences
from scimetrics.operators.joins import join_na
from scimetrics.session import materialize
from scimetrics.sources.writers import missing_cells, write_cells


def network_edges(
    papers_summary: DataFrame,
    papers_fields: DataFrame,
    collab_authors: DataFrame,
    fields: Sequence[str] | None = None,
    period_mode: str = "first_year",
) -> DataFrame:
    """Author pairs per cell with fractional weight and number of papers.

    ``first_year`` takes the papers of a period's first year only, ``full`` those
    of all its years. Without ``fields`` every top field is a network of its own.
    """
    period = PERIOD_MODES[period_mode](F.col("year"))
    dated = papers_summary.select("paper_id", "year", "author_count", period.alias("quin")).where(
        F.col("quin").isNotNull()
    )
    if fields is None:
        named = papers_fields.where(F.col("field_type") == "Top")
    else:
        named = papers_fields.where(F.col("field_name").isin(*fields))
    labels = named.select("paper_id", F.col("field_name").alias("field")).distinct()
    # the period also prunes the pair side, before any pair is formed
    pairs = collab_authors.where(PERIOD_MODES[period_mode](F.col("year")).isNotNull())
    cells = dated.join(labels, "paper_id").select(
        *CELL, "paper_id", "year", pair_share(F.col("author_count")).alias("weight")
    )
    return (
        pairs.join(cells, ["paper_id", "year"])
        .groupBy(*CELL, F.col("author_1").alias("from"), F.col("author_2").alias("to"))
        .agg(F.sum("weight").alias("fractional_weight"), F.count("*").alias("pair_count"))
    )


def strength(edges: DataFrame) -> DataFrame:
    """Summed weights and plain degree; one scan of the edge table, no iteration."""
    degree = F.count("*")
    return (
        incidences(edges)
        .groupBy(*CELL, "id")
        .agg(
            F.sum("fractional_weight").alias("weighted_degree"),
            F.sum("pair_count").alias("degree"),
            degree.alias("degree2"),
            degree.alias("in_degree"),
            degree.alias("out_degree"),
        )
    )


def vertex_metrics(network: Network) -> DataFrame:
    """All graph metrics of every vertex except the edge-weighted ones.

    Power iterations run until they have settled.
    """
    reached = paths.reach(network)
    tables = [
        paths.betweenness(network),
        paths.closeness_of(reached),
        reached.select(
            *VERTEX,
            "eccentricity",
            F.col("within_1").alias("neighborhood_1"),
            F.col("within_2").alias("neighborhood_2"),
        ),
        centrality.eigenvector(network),
        centrality.pagerank(network),
        centrality.hub_scores(network),
        structure.clustering(network),
        communities(network),
    ]
    return reduce(lambda a, b: a.join(b, VERTEX), tables)


def network_vertices(edges: DataFrame, network: Network | None = None) -> DataFrame:
    """Vertex table with every metric, per field and period."""
    network = network or build_network(edges)
    metrics = network.named(vertex_metrics(network))
    return strength(edges).join(metrics, [*CELL, "id"])


def weighted_betweenness(edges: DataFrame, network: Network | None = None) -> DataFrame:
    """Betweenness with both edge weightings and whether the two agree; not exported."""
    network = network or build_network(edges)
    by_share = weighted_paths.weighted_betweenness(network, edges, "fractional_weight")
    by_count = weighted_paths.weighted_betweenness(network, edges, "pair_count")
    both = by_share.withColumnRenamed("betweenness", "weighted_betweenness").join(
        by_count.withColumnRenamed("betweenness", "normal_betweenness"), VERTEX
    )
    same = F.abs(F.col("weighted_betweenness") - F.col("normal_betweenness")) < 1e-9
    return network.named(both.withColumn("equal", same))


def publish_networks(edges: DataFrame, folder: str) -> None:
    """Write edges, summary and vertices of the cells that ``folder`` does not hold yet.

    Vertices come last: a cell counts as done when its vertices are there, so an
    interrupted run repeats the cells it did not finish.
    """
    todo = missing_cells(edges.select(*CELL).distinct(), f"{folder}/vertices")
    pending = materialize(join_na(edges, todo, CELL, "left_semi"), "pending")
    if pending.isEmpty():
        return
    network = build_network(pending)
    write_cells(pending, f"{folder}/edges", sort=[F.desc("pair_count")])
    write_cells(network.named(structure.summary(network)), f"{folder}/summary")
    vertices = network_vertices(pending, network)
    write_cells(vertices, f"{folder}/vertices", sort=["id"])
