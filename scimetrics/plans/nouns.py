"""Nouns of abstracts, per field and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.functions.names import column_range
from scimetrics.functions.periods import period_by_label
from scimetrics.functions.text import ends_with_any, language, singular, words
from scimetrics.functions.wordlists import NOUN_SUFFIXES, STOPWORDS
from scimetrics.operators.joins import join_na, without_words
from scimetrics.operators.ranking import top_k_ties
from scimetrics.session import materialize


def _spoken(abstracts: DataFrame) -> DataFrame:
    """Abstracts with their words and language.

    The language comes out of a one-element explode: a later filter on it then
    stays above this step and the text is split into words once per abstract.
    """
    split = abstracts.withColumn("_words", words(F.col("paper_abstract")))
    return split.select("*", F.explode(F.array(language(F.col("_words")))).alias("lang"))


def detect_language(abstracts: DataFrame) -> DataFrame:
    return _spoken(abstracts).drop("_words")


def abstract_nouns(
    abstracts: DataFrame,
    lexicon: DataFrame | None = None,
    suffixes: Sequence[str] = NOUN_SUFFIXES,
) -> DataFrame:
    """Noun counts per English abstract.

    ``lexicon(form, lemma, upos)`` tags the forms it lists; other forms are
    nouns when their singular ends in one of ``suffixes``. Forms are counted
    per paper before the lexicon is joined, so a frequent word meets it once
    per paper.
    """
    english = _spoken(abstracts).where(F.col("lang") == "en")
    forms = (
        english.select("paper_id", F.explode_outer("_words").alias("form"))
        .where(F.col("form").isNotNull())
        .groupBy("paper_id", "form")
        .agg(F.count("*").alias("n"))
    )
    by_rule = singular(F.col("form"))
    rule_holds = ends_with_any(by_rule, suffixes)
    if lexicon is None:
        tagged = forms.where(rule_holds).withColumn("lemma", by_rule)
    else:
        noun = F.col("upos") == "NOUN"
        known = F.col("upos").isNotNull()
        tagged = (
            join_na(forms, lexicon.select("form", "lemma", "upos"), ["form"])
            .where(F.when(known, noun).otherwise(rule_holds))
            .withColumn("lemma", F.when(known, F.col("lemma")).otherwise(by_rule))
        )
    return tagged.groupBy("paper_id", "lemma").agg(F.sum("n").alias("n"))


def count_annotations(annotations: DataFrame) -> DataFrame:
    """Noun counts from an external tagger's table ``(paper_id, lemma, upos)``."""
    nouns = annotations.where(F.col("upos") == "NOUN")
    return nouns.groupBy("paper_id", "lemma").agg(F.count("*").alias("n"))


def field_nouns(
    nouns: DataFrame, papers_fields: DataFrame, papers: DataFrame, field_scope: str = "fanout"
) -> DataFrame:
    """Nouns of the papers of each top field (``file_field``).

    With ``fanout`` a noun row carries every top field of its paper in turn, also
    inside another field's table; ``strict`` keeps the table's own field only.
    """
    if field_scope not in ("fanout", "strict"):
        raise ValueError(f"unknown field_scope {field_scope!r}")
    tops = papers_fields.where(F.col("field_type") == "Top")
    tops = tops.select(*column_range(tops, "paper_id", "field_name")).join(
        papers.select("paper_id", "year"), "paper_id", "left"
    )
    if field_scope == "strict":
        cells = tops.where(F.col("field_name").isNotNull()).withColumn("file_field", F.col("field_name"))
    else:
        # a paper's few fields become one row, so that they are read once and meet the nouns in one join
        row = F.struct("field_id", "field_name", "year").alias("row")
        rows = tops.groupBy("paper_id").agg(F.collect_list(row).alias("rows"))
        names = F.filter(F.col("rows.field_name"), lambda name: name.isNotNull())
        cells = rows.withColumn("names", names).where(F.size("names") > 0)
    joined = nouns.join(cells, "paper_id")
    if field_scope == "fanout":
        joined = joined.withColumn("file_field", F.explode("names")).select("*", F.inline("rows"))
    return joined.select("file_field", "paper_id", "lemma", "n", "field_id", "field_name", "year")


def top_nouns(field_nouns: DataFrame, k: int = 100) -> DataFrame:
    """Most frequent nouns per field table and period, with their share of the cell."""
    cell = ["file_field", "quin"]
    rows = field_nouns.select(
        "file_field", period_by_label(F.col("year")).alias("quin"), "field_name", "lemma", "n"
    ).where(F.col("quin").isNotNull() & (F.length("lemma") > 2))
    counted = (
        without_words(rows, "lemma", STOPWORDS)
        .groupBy(*cell, "field_name", "lemma")
        .agg(F.sum("n").alias("n"))
    )
    # read for the places, the rows and the totals
    counted = materialize(counted, "noun-counts")
    totals = counted.groupBy(*cell).agg(F.sum("n").alias("total"))
    return join_na(top_k_ties(counted, cell, "n", k), totals, cell).select(
        F.col("file_field").alias("field"),
        "quin",
        "lemma",
        "n",
        (F.col("n") / F.col("total")).alias("rel_freq"),
    )
