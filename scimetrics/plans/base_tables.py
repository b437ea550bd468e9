"""Relational tables of the flat frame (one row per paper, author, affiliation, field)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.functions.expressions import gender_of
from scimetrics.functions.names import clean_names
from scimetrics.operators.dedupe import ORDER, keep_first
from scimetrics.operators.joins import join_na

AUTHOR_COLUMNS = (
    "author_id author_name h_index_auth productivity_auth average_c10_auth average_log_c10_auth"
).split()
PAPER_COLUMNS = (
    "paper_id doi year date journal_id original_venue reference_count citation_count"
).split()
AFFILIATION_COLUMNS = (
    "affiliation_id affiliation_name grid_id official_page iso3166_code latitude_aff longitude_aff "
    "productivity_aff average_c10_aff average_log_c10_aff name"
).split()
PAPER_FIELD_COLUMNS = (
    "paper_id field_id field_name field_type hit_1pct hit_5pct hit_10pct c_f"
).split()


def authors(raw: DataFrame) -> DataFrame:
    return keep_first(raw.select(*AUTHOR_COLUMNS, ORDER), ["author_id"])


def affiliations(
    raw: DataFrame, countries: DataFrame, columns: Sequence[str] = AFFILIATION_COLUMNS
) -> DataFrame:
    """Institutions with two region names; ``columns`` of the flat frame, code included.

    ``countries(iso2c, subregion_un, region)`` is the country lookup, one row per
    code; Taiwan is absent from the UN scheme and counted to Eastern Asia.
    """
    first = keep_first(
        raw.where(F.col("affiliation_id").isNotNull())
        .select(*columns, ORDER)
        .withColumnsRenamed({"iso3166_code": "country_iso", "name": "country_name"}),
        ["affiliation_id"],
    )
    lookup = countries.where(F.col("iso2c").isNotNull()).select("iso2c", "subregion_un", "region")
    located = join_na(first, lookup, [("country_iso", "iso2c")])
    regions = {
        c: F.when(F.col("country_iso").isNull(), None)
        .when(F.col("country_iso") == "TW", "Eastern Asia")
        .otherwise(F.col(c))
        for c in ("subregion_un", "region")
    }
    return located.withColumns(regions)


def author_main_aff(tsv: DataFrame) -> DataFrame:
    return tsv.select(
        F.col("AuthorID").try_cast("long").alias("author_id"),
        F.col("AffiliationID").try_cast("long").alias("main_affiliation_id"),
    )


def author_gender(tsv: DataFrame) -> DataFrame:
    named = clean_names(tsv.select("AuthorID", "`P(gf)`"))
    return named.select(
        F.col("author_id").try_cast("long").alias("author_id"),
        "p_gf",
        gender_of(F.col("p_gf")).alias("name_gender"),
    )


def author_main_field(tsv: DataFrame, keep_order: bool = False) -> DataFrame:
    """``keep_order`` keeps the row order, which decides between rows of one author."""
    return tsv.select(
        F.col("AuthorID").try_cast("long").alias("author_id"),
        F.col("field_predominant_all").try_cast("long").alias("author_main_field"),
        F.col("type_predominant_all").alias("field_type"),
        *([ORDER] if keep_order else []),
    )


def papers(raw: DataFrame, columns: Sequence[str] = PAPER_COLUMNS) -> DataFrame:
    """``columns`` of the papers; the first row of a paper is kept as one value, which no later plan can narrow."""
    return keep_first(raw.select(*columns, ORDER), ["paper_id"])


def papers_auth_aff(raw: DataFrame, keep_order: bool = False) -> DataFrame:
    return keep_first(
        raw.select("paper_id", "author_id", "affiliation_id", "author_sequence_number", ORDER),
        ["paper_id", "author_id", "affiliation_id"],
        keep_order=keep_order,
    )


def papers_titles(raw: DataFrame) -> DataFrame:
    return keep_first(raw.select("paper_id", "paper_title", "year", ORDER), ["paper_id"])


def papers_fields(
    raw: DataFrame, keep_order: bool = False, columns: Sequence[str] = PAPER_FIELD_COLUMNS
) -> DataFrame:
    return keep_first(raw.select(*columns, ORDER), ["paper_id", "field_id"], keep_order=keep_order)


def papers_abstracts(raw: DataFrame) -> DataFrame:
    """Non-empty abstracts; the first row of a paper decides, also when it is empty."""
    first = keep_first(
        raw.select("paper_id", F.col("ab").alias("paper_abstract"), "year", ORDER), ["paper_id"]
    )
    return first.where(F.col("paper_abstract") != "")
