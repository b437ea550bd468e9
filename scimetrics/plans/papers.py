"""Paper summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimetrics.functions.expressions import n_distinct
from scimetrics.operators.joins import join_na


def _named_fields(kind: str) -> Column:
    """Distinct field names of one type in a paper, NULL when it has no such row."""
    of_kind = F.col("field_type") == kind
    name = F.col("field_name")
    unnamed = F.max((of_kind & name.isNull()).cast("long"))
    found = F.count_distinct(F.when(of_kind, name)) + F.coalesce(unnamed, F.lit(0))
    return F.when(F.count(F.when(of_kind, 1)) > 0, found)


def papers_summary(
    papers: DataFrame, papers_auth_aff: DataFrame, papers_fields: DataFrame, affiliations: DataFrame
) -> DataFrame:
    """Papers with author, institution, field and country counts.

    A missing institution or country counts as one more value. Counts of a paper
    without rows in the source table stay missing.
    """
    located = join_na(
        papers_auth_aff.select("paper_id", "author_id", "affiliation_id"),
        affiliations.select("affiliation_id", "country_iso"),
        ["affiliation_id"],
    )
    people = located.groupBy("paper_id").agg(
        n_distinct(F.col("author_id")).alias("author_count"),
        n_distinct(F.col("affiliation_id")).alias("affiliation_count"),
        n_distinct(F.col("country_iso")).alias("countries_count"),
    )
    fields = papers_fields.groupBy("paper_id").agg(
        _named_fields("Top").alias("top_field_count"),
        _named_fields("Sub").alias("sub_field_count"),
    )
    joined = reduce(lambda a, b: a.join(b, "paper_id", "left"), [papers, people, fields])
    return joined.select(
        *papers.columns,
        "author_count",
        "affiliation_count",
        "top_field_count",
        "sub_field_count",
        "countries_count",
        (F.col("countries_count") > 1).alias("is_int_collab"),
    )


def venue_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("original_venue").agg(F.count("*").alias("n"))
