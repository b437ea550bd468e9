"""Multidisciplinarity of papers and flows between fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.functions.expressions import shannon
from scimetrics.functions.periods import PERIODS, period_by_breaks
from scimetrics.operators.dedupe import ORDER, keep_first
from scimetrics.operators.joins import join_na
from scimetrics.operators.reshape import crossing
from scimetrics.plans.collaboration import collaborative_papers


def author_fields(
    author_main_field: DataFrame, papers_fields: DataFrame, top_of_sub: DataFrame
) -> DataFrame:
    """One main sub field and top field per author.

    The first match counts: by the row order of the authors' fields, then by
    the first appearance of a sub field's name among the papers' fields, then
    by the ``ordinal`` of the lookup. Tables without ``_seq`` have no order of
    their own and go by value.
    """
    sub = papers_fields.where(F.col("field_type") == "Sub")
    name = F.col("field_name")
    appeared = F.min(ORDER if ORDER in papers_fields.columns else name)
    names = sub.groupBy(F.col("field_id").alias("author_subfield"), name.alias("subfield_name")).agg(
        appeared.alias("_name_seq")
    )
    subfield = F.col("author_main_field")
    row = F.col(ORDER) if ORDER in author_main_field.columns else subfield
    subs = author_main_field.select("author_id", subfield.alias("author_subfield"), row.alias("_row_seq"))
    matched = join_na(join_na(subs, names, ["author_subfield"]), top_of_sub, ["subfield_name"])
    order = F.struct("_row_seq", "_name_seq", "subfield_name", "ordinal", "topfield_name")
    return keep_first(
        matched.select("author_id", "author_subfield", "topfield_name", order.alias(ORDER)),
        ["author_id"],
    )


def collab_author_fields(papers_auth_aff: DataFrame, author_fields: DataFrame) -> DataFrame:
    """Each author of each collaborative paper once, with the author's fields."""
    people = papers_auth_aff.select("paper_id", "author_id")
    collaborative = collaborative_papers(people).select("paper_id")
    kept = people.distinct().join(collaborative, "paper_id", "left_semi")
    return join_na(kept, author_fields, ["author_id"])


def multidiscipline_index(collab_author_fields: DataFrame) -> DataFrame:
    """Shannon index over the main sub fields of a paper's authors; unknown is a class."""
    classes = collab_author_fields.groupBy("paper_id", "author_subfield").agg(
        F.count("*").alias("n")
    )
    return classes.groupBy("paper_id").agg(shannon(F.col("n")).alias("multidisciplinarity_messure"))


def papers_auth_fields(
    papers: DataFrame, papers_fields: DataFrame, collab_author_fields: DataFrame
) -> DataFrame:
    """First top field of a paper against the top field of each of its authors.

    ``papers_fields`` must carry its row order. Every author row of a paper meets
    the same first top field, so the fields are reduced to one per paper before
    the join instead of after it.
    """
    tops = papers_fields.where(F.col("field_type") == "Top")
    first_top = keep_first(
        tops.select("paper_id", F.col("field_name").alias("paper_field"), ORDER), ["paper_id"]
    ).where(F.col("paper_field").isNotNull())
    dated = papers.select("paper_id", "year", period_by_breaks(F.col("year")).alias("quin"))
    people = collab_author_fields.select(
        "paper_id", "author_id", F.col("topfield_name").alias("author_field")
    )
    return people.join(dated.join(first_top, "paper_id"), "paper_id").select(
        "paper_id", "year", "quin", "paper_field", "author_id", "author_field"
    )


def field_edges(papers_auth_fields: DataFrame) -> DataFrame:
    """Author rows per paper field, period and author field."""
    known = papers_auth_fields.where(F.col("author_field").isNotNull() & F.col("quin").isNotNull())
    return (
        known.groupBy("paper_field", "quin", "author_field")
        .agg(F.count("*").alias("weight"))
        .select(
            F.col("paper_field").alias("field"),
            "quin",
            F.col("paper_field").alias("from"),
            F.col("author_field").alias("to"),
            "weight",
        )
    )


def field_grid(papers_auth_fields: DataFrame) -> DataFrame:
    """All field and period cells, the empty ones too."""
    return crossing(papers_auth_fields.select(F.col("paper_field").alias("field")), "quin", PERIODS)
