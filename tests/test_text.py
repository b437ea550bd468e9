"""Nouns and co-occurrence against hand-made rows."""

import itertools

from pyspark.sql import functions as F

from scimetrics.functions.text import singular
from scimetrics.operators.reshape import repeat_rows
from scimetrics.plans import cooccurrence, nouns
from tests.test_verbs import rows


def test_language_and_ties(spark):
    df = spark.createDataFrame(
        [(1, "the cat is on the mat"), (2, "le chat est dans la maison"), (3, "xyz"), (4, None), (5, "un")],
        "paper_id long, paper_abstract string",
    )
    found = nouns.detect_language(df).select("paper_id", "lang")
    assert rows(found) == [(1, "en"), (2, "fr"), (3, None), (4, None), (5, "fr")]


def test_one_shared_word_makes_no_language(spark):
    df = spark.createDataFrame(
        [
            (1, "o gato do vizinho não dorme para um bom dia com a casa"),
            (2, "het huis van de man is niet groot en dat is goed"),
            (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu of"),
            (4, "la casa della donna non è grande e il cane dorme"),
        ],
        "paper_id long, paper_abstract string",
    )
    found = nouns.detect_language(df).select("paper_id", "lang")
    assert rows(found) == [(1, "pt"), (2, "nl"), (3, None), (4, "it")]


def test_short_nouns_are_kept(spark):
    df = spark.createDataFrame([(1, "the ox is in the field of the fox")], "paper_id long, paper_abstract string")
    assert rows(nouns.abstract_nouns(df, suffixes=("ox",))) == [(1, "fox", 1), (1, "ox", 1)]


def test_singular(spark):
    forms = {"cities": "city", "glasses": "glass", "boxes": "box", "cells": "cell", "basis": "basis", "gas": "gas"}
    df = spark.createDataFrame([(f,) for f in forms], "f string")
    assert dict(rows(df.select("f", singular(F.col("f"))))) == forms


def test_lexicon_decides_before_the_rule(spark):
    text = "The foundations of the running water and the nation in motion"
    df = spark.createDataFrame([(1, text)], "paper_id long, paper_abstract string")
    by_rule = nouns.abstract_nouns(df)
    assert [r[1] for r in rows(by_rule)] == ["foundation", "motion", "nation", "water"]
    lexicon = spark.createDataFrame(
        [("water", "water", "NOUN"), ("running", "run", "NOUN"), ("motion", "motion", "VERB")],
        "form string, lemma string, upos string",
    )
    found = nouns.abstract_nouns(df, lexicon=lexicon)
    assert [r[1] for r in rows(found)] == ["foundation", "nation", "run", "water"]


def test_external_annotations(spark):
    tagged = spark.createDataFrame(
        [(1, "cell", "NOUN"), (1, "cell", "NOUN"), (1, "be", "VERB")], "paper_id long, lemma string, upos string"
    )
    assert rows(nouns.count_annotations(tagged)) == [(1, "cell", 2)]


def test_field_nouns_fan_out(spark):
    counted = spark.createDataFrame([(1, "cell", 2)], "paper_id long, lemma string, n long")
    fields = spark.createDataFrame(
        [(1, 10, "Art", "Top"), (1, 11, "Law", "Top"), (1, 12, "x", "Sub")],
        "paper_id long, field_id long, field_name string, field_type string",
    )
    papers = spark.createDataFrame([(1, 1991)], "paper_id long, year int")
    full = nouns.field_nouns(counted, fields, papers)
    assert [(r.file_field, r.field_name) for r in full.orderBy("file_field", "field_name").collect()] == [
        ("Art", "Art"),
        ("Art", "Law"),
        ("Law", "Art"),
        ("Law", "Law"),
    ]
    strict = nouns.field_nouns(counted, fields, papers, field_scope="strict")
    assert sorted(r.file_field for r in strict.collect()) == ["Art", "Law"]


def _field_rows(spark, data):
    made = [("F", p, 1990, lemma, n) for p, words in data.items() for lemma, n in words]
    return spark.createDataFrame(made, "file_field string, paper_id long, year int, lemma string, n long")


PAPERS = {
    1: [("sustainability", 2), ("water", 3), ("sustainable", 1)],
    2: [("sustainability", 1), ("Water", 1)],
    3: [("unsustainability", 4), ("water", 1)],
    4: [("Sustainability", 1), ("water", 2), ("water", 2), ("data", 9), (".x", 3)],
}


def _by_expansion(field_nouns, stem):
    """The pairs themselves, formed in plain Python."""
    repeated = [tuple(r) for r in repeat_rows(field_nouns, "n").select("paper_id", "lemma").collect()]
    counts = {}
    for _, group in itertools.groupby(sorted(repeated), key=lambda r: r[0]):
        lemmas = [w.lower() for _, w in group]
        lemmas = [w for w in lemmas if w != "data" and not w.startswith(".")]
        for a, b in itertools.product([w for w in lemmas if w.startswith(stem)], lemmas):
            if a != b:
                counts[b] = counts.get(b, 0) + 1
    return counts


def test_cooccurrence_closed_form(spark):
    first_three = _field_rows(spark, {p: PAPERS[p] for p in (1, 2, 3)})
    top = cooccurrence.top_cooccurrence(first_three)
    assert {r.lemma_2: r.freq for r in top.collect()} == {"water": 10, "sustainability": 2, "sustainable": 2}
    everything = _field_rows(spark, PAPERS)
    top = cooccurrence.top_cooccurrence(everything)
    assert {r.lemma_2: r.freq for r in top.collect()} == _by_expansion(everything, "sustaina")


def test_cooccurrence_nodes_and_edges(spark):
    top = cooccurrence.top_cooccurrence(_field_rows(spark, {1: PAPERS[1]}), k=1)
    assert [(r["from"], r["to"], r["value"], r["title"]) for r in cooccurrence.cooccurrence_edges(top).collect()] == [
        ("sustainability", "water", 9, "Frequency: 9")
    ]
    nodes = cooccurrence.cooccurrence_nodes(top)
    assert sorted((r.id, r.value) for r in nodes.collect()) == [("sustainability", 9), ("water", 9)]


def test_top_nouns_share_and_period(spark):
    made = [
        ("F", "F", 2021, "cell", 3),
        ("F", "G", 2021, "cell", 1),
        ("F", "F", 2022, "late", 5),
        ("F", "F", 2021, "data", 9),
        ("F", "F", 2021, "ab", 9),
    ]
    df = spark.createDataFrame(made, "file_field string, field_name string, year int, lemma string, n long")
    assert rows(nouns.top_nouns(df, k=1)) == [("F", "2020-2021", "cell", 3, 0.75)]
