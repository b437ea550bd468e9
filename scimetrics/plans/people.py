"""Author dimension and author gender per paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.functions.expressions import GENDERS, as_gender
from scimetrics.operators.joins import join_na
from scimetrics.operators.reshape import complete


def authors_extra(
    authors: DataFrame,
    author_main_field: DataFrame,
    papers_fields: DataFrame,
    author_gender: DataFrame,
    author_main_aff: DataFrame,
    affiliations: DataFrame,
) -> DataFrame:
    """Authors with main field, gender and main institution; repeated matches fan out."""
    steps = [
        (author_main_field.select("author_id", "author_main_field"), ["author_id"]),
        (
            papers_fields.select("field_id", "field_name").distinct(),
            [("author_main_field", "field_id")],
        ),
        (author_gender, ["author_id"]),
        (author_main_aff, ["author_id"]),
        (
            affiliations.select(
                "affiliation_id", "affiliation_name", "country_name", "subregion_un", "region"
            ),
            [("main_affiliation_id", "affiliation_id")],
        ),
    ]
    for table, on in steps:
        authors = join_na(authors, table, on)
    return authors


def papers_gender(papers_auth_aff: DataFrame, authors_extra: DataFrame) -> DataFrame:
    """Author count per paper and gender, every observed gender for every paper.

    ``n_authors`` is the highest sequence number. Rows that tie on it, and
    several first authors, multiply the rows of their paper.
    """
    positions = papers_auth_aff.select("paper_id", "author_id", "author_sequence_number").distinct()
    gendered = join_na(positions, authors_extra.select("author_id", "name_gender"), ["author_id"])

    def matching(condition) -> F.Column:
        return F.sum(condition.cast("long"))

    # per (paper, position) first, so that a huge paper is combined before the last shuffle
    per_position = gendered.groupBy("paper_id", "author_sequence_number").agg(
        F.count("*").alias("rows"),
        *[matching(F.col("name_gender") == g).alias(g) for g in GENDERS],
        matching(as_gender(F.col("name_gender")).isNull()).alias("unlabelled"),
    )
    first = F.col("author_sequence_number") == 1
    leads = {g: F.sum(F.when(first, F.col(g))).alias(f"first_{g}") for g in (*GENDERS, "unlabelled")}
    per_paper = per_position.groupBy("paper_id").agg(
        F.max(F.struct("author_sequence_number", "rows")).alias("last"),
        *[F.sum(g).alias(g) for g in GENDERS],
        *leads.values(),
    )
    first_authors = F.flatten(
        F.array(
            *[
                F.array_repeat(
                    F.lit(g if g in GENDERS else None).cast("string"),
                    F.coalesce(F.col(f"first_{g}"), F.lit(0)).cast("int"),
                )
                for g in leads
            ]
        )
    )
    described = per_paper.select(
        "paper_id",
        F.col("last.author_sequence_number").alias("n_authors"),
        F.array_repeat(F.lit(1), F.col("last.rows").cast("int")).alias("_copies"),
        first_authors.alias("_firsts"),
        *GENDERS,
    )
    ids = ["paper_id", "n_authors", "_copies", "_firsts"]
    rows = complete(described, ids, GENDERS, "name_gender", "n", observed=gendered)
    return (
        rows.withColumn("_copy", F.explode("_copies"))
        .withColumn("gender_first_auth", F.explode_outer("_firsts"))
        .select(
            "paper_id",
            "name_gender",
            "n",
            "n_authors",
            (F.col("n_authors") > 1).alias("is_collab"),
            "gender_first_auth",
        )
    )


def gender_totals(papers_gender: DataFrame) -> DataFrame:
    return papers_gender.groupBy("name_gender").agg(F.sum("n").alias("author_gender"))
