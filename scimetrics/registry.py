"""Registered queries: each dataset over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scimetrics.functions import periods
from scimetrics.operators.graph import centrality, paths, structure
from scimetrics.operators.graph.communities import communities
from scimetrics.operators.graph.network import VERTEX, Network, build_network
from scimetrics.operators.reshape import complete, repeat_rows
from scimetrics.plans import (
    base_tables,
    collaboration,
    cooccurrence,
    disciplines,
    network,
    nouns,
    papers,
    people,
)
from scimetrics.session import materialize
from scimetrics.sources.testdata import STEM, STEM_LABEL, Inputs

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


def _authors_extra(d: Inputs) -> DataFrame:
    return people.authors_extra(
        d.authors,
        d.author_main_field,
        d.papers_fields,
        d.author_gender,
        d.author_main_aff,
        d.affiliations,
    )


def _papers_summary(d: Inputs) -> DataFrame:
    return papers.papers_summary(
        d.papers, d.papers_auth_aff, d.field_names, d.affiliation_countries
    )


def _papers_gender(d: Inputs) -> DataFrame:
    return people.papers_gender(d.papers_auth_aff, _authors_extra(d))


def _papers_auth_fields(d: Inputs) -> DataFrame:
    return disciplines.papers_auth_fields(d.paper_years, d.field_names, d.collab_author_fields)


def _top_cooccurrence(d: Inputs) -> DataFrame:
    return cooccurrence.top_cooccurrence(d.field_nouns, STEM, STEM_LABEL)


def _quin_bins(d: Inputs) -> DataFrame:
    year = F.col("year")
    return (
        d.papers.groupBy("year")
        .agg(F.count("*").alias("papers"))
        .select(
            "year",
            periods.period_by_breaks(year).alias("by_breaks"),
            periods.period_by_label(year).alias("by_label"),
            periods.period_by_first_year(year).alias("by_first_year"),
            "papers",
        )
    )


def _complete_grid(d: Inputs) -> DataFrame:
    kinds = ["Top", "Sub"]
    counts = [F.count_if(F.col("field_type") == k).alias(k) for k in kinds]
    wide = d.papers_fields.groupBy("paper_id").agg(*counts)
    return complete(wide, ["paper_id"], kinds, "field_type", "n")


def _edges(d: Inputs, period_mode: str = "first_year") -> DataFrame:
    """Edges from the papers of the periods alone; their rows are written once for the four steps that read them."""
    period = periods.PERIOD_MODES[period_mode](F.col("year"))
    dated = materialize(d.paper_years.where(period.isNotNull()), "edge-papers")
    rows = materialize(
        d.papers_auth_aff.join(dated.select("paper_id"), "paper_id", "left_semi"), "edge-rows"
    )
    summary = papers.papers_summary(dated, rows, d.field_names, d.affiliation_countries)
    pairs = collaboration.collab_authors(rows, dated)
    return network.network_edges(summary, d.field_names, pairs, period_mode=period_mode)


def _graph(
    metric: Callable[[Network], DataFrame], *columns: str, places: int = 9
) -> Callable[[Inputs], DataFrame]:
    def dataset(d: Inputs) -> DataFrame:
        net = build_network(_edges(d))
        return rounded(net.named(metric(net)), *columns, places=places)

    return dataset


def _ego(net: Network) -> DataFrame:
    return paths.reach(net, max_hops=2).select(
        *VERTEX,
        F.col("within_1").alias("neighborhood_1"),
        F.col("within_2").alias("neighborhood_2"),
    )


DATASETS: dict[str, Callable[[Inputs], DataFrame]] = {
    "authors": lambda d: rounded(d.authors, "average_log_c10_auth"),
    "affiliations_regions": lambda d: rounded(d.affiliations, "average_log_c10_aff"),
    "author_main_aff": lambda d: d.author_main_aff,
    "author_gender": lambda d: d.author_gender,
    "author_main_field": lambda d: d.author_main_field,
    "papers": lambda d: dated(d.papers),
    "papers_auth_aff": lambda d: base_tables.papers_auth_aff(d.raw),
    "papers_titles": lambda d: base_tables.papers_titles(d.raw),
    "papers_fields": lambda d: base_tables.papers_fields(d.raw),
    "papers_abstracts": lambda d: d.abstracts,
    "authors_extra": lambda d: rounded(_authors_extra(d), "average_log_c10_auth"),
    "papers_summary": lambda d: dated(_papers_summary(d)),
    "venue_counts": lambda d: papers.venue_counts(_papers_summary(d)),
    "papers_gender": _papers_gender,
    "gender_totals": lambda d: people.gender_totals(_papers_gender(d)),
    "collab_authors": lambda d: collaboration.collab_authors(d.papers_auth_aff, d.paper_years),
    "collab_authors_canonical": lambda d: collaboration.collab_authors(
        d.papers_auth_aff, d.paper_years, distinct_authors=True, canonical=True
    ),
    "collab_institutions": lambda d: collaboration.collab_institutions(
        d.papers_auth_aff, d.paper_years
    ),
    "multidiscipline_index": lambda d: rounded(
        disciplines.multidiscipline_index(d.collab_author_fields), "multidisciplinarity_messure"
    ),
    "papers_auth_fields": _papers_auth_fields,
    "field_edges": lambda d: disciplines.field_edges(_papers_auth_fields(d)),
    "field_grid": lambda d: disciplines.field_grid(_papers_auth_fields(d)),
    "lang_detect": lambda d: nouns.detect_language(d.abstracts).select("paper_id", "year", "lang"),
    "abstract_nouns": lambda d: d.nouns,
    "field_nouns": lambda d: d.field_nouns,
    "field_nouns_strict": lambda d: nouns.field_nouns(
        d.nouns, d.field_names, d.paper_years, field_scope="strict"
    ),
    "top_nouns": lambda d: rounded(nouns.top_nouns(d.field_nouns), "rel_freq"),
    "top_cooccurrence": _top_cooccurrence,
    "cooccurrence_edges": lambda d: cooccurrence.cooccurrence_edges(_top_cooccurrence(d)),
    "cooccurrence_nodes": lambda d: rounded(
        cooccurrence.cooccurrence_nodes(_top_cooccurrence(d)), "value_log"
    ),
    "net_edges": lambda d: rounded(_edges(d), "fractional_weight"),
    "net_edges_full": lambda d: rounded(_edges(d, "full"), "fractional_weight"),
    "net_strength": lambda d: rounded(
        network.strength(_edges(d)).select("field", "quin", "id", "weighted_degree", "degree"),
        "weighted_degree",
    ),
    "net_degree": lambda d: network.strength(_edges(d)).select(
        "field", "quin", "id", "degree2", "in_degree", "out_degree"
    ),
    "net_ego": _graph(_ego),
    "net_clustering": _graph(structure.clustering, "clustering"),
    "net_pagerank": _graph(centrality.pagerank, "pagerank"),
    "net_eigen": _graph(centrality.eigenvector, "eigen", places=6),
    "net_hits": _graph(centrality.hub_scores, "hub", "authority", places=6),
    "net_community": _graph(communities),
    "net_closeness": _graph(
        lambda net: paths.closeness_of(paths.reach(net)), "closeness", "closeness_norm"
    ),
    "net_eccentricity": _graph(
        lambda net: paths.reach(net).select(*VERTEX, "eccentricity")
    ),
    "net_betweenness": _graph(paths.betweenness, "betweenness", "betweenness_norm"),
    "net_summary": _graph(structure.summary, "density", "mean_degree"),
    "quin_bins": _quin_bins,
    "uncount": lambda d: repeat_rows(d.nouns, "n"),
    "complete_grid": _complete_grid,
}


def _query(dataset: Callable[[Inputs], DataFrame]) -> Query:
    return lambda spark, folder: dataset(Inputs(spark, folder))


QUERIES: dict[str, Query] = {name: _query(dataset) for name, dataset in DATASETS.items()}
