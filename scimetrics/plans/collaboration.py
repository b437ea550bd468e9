"""Author pairs and institution pairs per paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.functions.expressions import n_distinct
from scimetrics.operators.dedupe import ORDER
from scimetrics.operators.reshape import ordered_pairs


def collaborative_papers(papers_auth_aff: DataFrame) -> DataFrame:
    """Papers with more than one different author, and their row count."""
    per_paper = papers_auth_aff.groupBy("paper_id").agg(
        n_distinct(F.col("author_id")).alias("authors_total"), F.count("*").alias("rows")
    )
    return per_paper.where(F.col("authors_total") > 1)


def _pairs(
    rows: DataFrame, gate: DataFrame, papers: DataFrame, value: str, names: tuple[str, str]
) -> DataFrame:
    """Pairs within the papers of ``gate``; the year rides on the left row of a pair."""
    dated = gate.select("paper_id", "rows").join(papers.select("paper_id", "year"), "paper_id", "left")
    pairs = ordered_pairs(
        rows.join(dated, "paper_id"), "paper_id", value, "rows", names, carry=["year"]
    )
    return pairs.select("paper_id", *names, "year")


def collab_authors(
    papers_auth_aff: DataFrame,
    papers: DataFrame,
    distinct_authors: bool = False,
    canonical: bool = False,
) -> DataFrame:
    """Author pairs in row order of the paper.

    ``papers_auth_aff`` must carry its row order. By default an author with two
    institutions has two rows, hence a self pair; ``distinct_authors`` keeps the
    first row only and ``canonical`` puts the smaller id first.
    """
    rows = papers_auth_aff.select("paper_id", "author_id", ORDER)
    gate = collaborative_papers(rows)
    if distinct_authors:
        rows = rows.groupBy("paper_id", "author_id").agg(F.min(ORDER).alias(ORDER))
        gate = gate.withColumn("rows", F.col("authors_total"))
    pairs = _pairs(rows, gate, papers, "author_id", ("author_1", "author_2"))
    if canonical:
        low = F.least("author_1", "author_2")
        high = F.greatest("author_1", "author_2")
        pairs = pairs.withColumns({"author_1": low, "author_2": high})
    return pairs


def collab_institutions(papers_auth_aff: DataFrame, papers: DataFrame) -> DataFrame:
    """Pairs of the different known institutions of a paper, in order of appearance."""
    rows = (
        papers_auth_aff.where(F.col("affiliation_id").isNotNull())
        .groupBy("paper_id", "affiliation_id")
        .agg(F.min(ORDER).alias(ORDER))
    )
    gate = rows.groupBy("paper_id").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    return _pairs(rows, gate, papers, "affiliation_id", ("institution_1", "institution_2"))
