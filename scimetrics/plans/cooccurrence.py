"""Nouns that occur together with a target stem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.functions.periods import PERIODS, bounds, period_by_breaks
from scimetrics.functions.wordlists import STOPWORDS
from scimetrics.operators.joins import join_na, without_words
from scimetrics.operators.ranking import top_k_ties
from scimetrics.session import materialize


def top_cooccurrence(
    field_nouns: DataFrame, stem: str = "sustaina", label: str = "sustainability", k: int = 30
) -> DataFrame:
    """Lemmas that share papers with lemmas starting with ``stem``, per field and period.

    Repeating each lemma ``n`` times and pairing it with every occurrence of a
    different target lemma yields n_l * (T - n_l if l is a target, else T) pairs
    per paper, T being the paper's target occurrences. Summed over papers this is
    sum(n * T) minus the squares of the target counts, so no pair is ever formed
    and the noun rows shuffle only as partial sums per lemma. The noun rows and
    the sums are written once, as several steps read each.
    """
    cell = ["file_field", "quin"]
    lowered = field_nouns.select(
        "file_field", "paper_id", "year", F.lower("lemma").alias("lemma"), "n"
    )
    kept = without_words(lowered, "lemma", STOPWORDS).where(~F.col("lemma").startswith("."))
    first, last = bounds(PERIODS[0])[0], bounds(PERIODS[-1])[1]
    dated = kept.where(F.col("year").between(first, last)).select(
        "file_field",
        period_by_breaks(F.col("year")).alias("quin"),
        "paper_id",
        "lemma",
        F.col("n").cast("long").alias("n"),
    )
    dated = materialize(dated, "cooccurring-nouns")
    # papers that only contain the stem inside a word have no target and no pair
    targets = (
        dated.where(F.col("lemma").startswith(stem))
        .groupBy(*cell, "paper_id", "lemma")
        .agg(F.sum("n").alias("n"))
    )
    totals = targets.groupBy("file_field", "paper_id").agg(F.sum("n").alias("targets"))
    with_targets = dated.join(totals, ["file_field", "paper_id"]).select(
        *cell, "lemma", (F.col("n") * F.col("targets")).alias("pairs")
    )
    with_itself = targets.select(*cell, "lemma", (-F.col("n") * F.col("n")).alias("pairs"))
    pairs = (
        with_targets.unionByName(with_itself)
        .groupBy(*cell, "lemma")
        .agg(F.sum("pairs").alias("freq"))
        .where(F.col("freq") > 0)
    )
    pairs = materialize(pairs, "cooccurrences")
    return top_k_ties(pairs, ["file_field", "quin"], "freq", k).select(
        "quin",
        F.lit(label).alias("lemma_1"),
        F.col("lemma").alias("lemma_2"),
        "freq",
        F.col("file_field").alias("top_field"),
    )


def cooccurrence_edges(top: DataFrame) -> DataFrame:
    return top.select(
        F.col("top_field").alias("field"),
        "quin",
        F.col("lemma_1").alias("from"),
        F.col("lemma_2").alias("to"),
        F.col("freq").alias("value"),
        F.concat(F.lit("Frequency: "), F.col("freq").cast("string")).alias("title"),
    )


def cooccurrence_nodes(top: DataFrame) -> DataFrame:
    """Lemmas of the edges with their summed frequency."""
    ends = top.unpivot(["top_field", "quin", "freq"], ["lemma_1", "lemma_2"], "type", "lemma")
    return (
        ends.groupBy("top_field", "quin", "lemma")
        .agg(F.sum("freq").alias("value"))
        .select(
            F.col("top_field").alias("field"),
            "quin",
            F.col("lemma").alias("id"),
            F.col("lemma").alias("label"),
            "value",
            F.log1p("value").alias("value_log"),
        )
    )
