"""Datasets on hand-made rows where input order, ties and gaps matter."""

from pyspark.sql import functions as F

from scimetrics.plans import base_tables, collaboration, disciplines, papers, people
from tests.test_verbs import rows

PAA = "paper_id long, author_id long, affiliation_id long, author_sequence_number int, _seq int"


def test_summary_counts_missing_values_and_keeps_gaps(spark):
    paper = spark.createDataFrame([(1, "v"), (2, "v")], "paper_id long, original_venue string")
    paa = spark.createDataFrame([(1, 7, 70, 1, 1), (1, 8, None, 2, 2)], PAA)
    fields = spark.createDataFrame(
        [(1, "Art", "Top"), (1, None, "Top")], "paper_id long, field_name string, field_type string"
    )
    affiliations = spark.createDataFrame([(70, "AR")], "affiliation_id long, country_iso string")
    found = papers.papers_summary(paper, paa, fields, affiliations)
    assert rows(found.drop("original_venue")) == [
        (1, 2, 2, 2, None, 2, True),
        (2, None, None, None, None, None, None),
    ]
    assert rows(papers.venue_counts(found)) == [("v", 2)]


def test_gender_ties_multiply_rows(spark):
    paa = spark.createDataFrame(
        [(1, 1, 5, 1, 1), (1, 2, 5, 2, 2), (1, 3, 5, 2, 3), (1, 1, 6, 1, 4), (2, 9, 5, 1, 5)], PAA
    )
    extra = spark.createDataFrame(
        [(1, "female"), (2, "male"), (3, "male")], "author_id long, name_gender string"
    )
    # two rows tie on the last position, paper 2 has no labelled author
    assert rows(people.papers_gender(paa, extra)) == [
        (1, "female", 1, 2, True, "female"),
        (1, "female", 1, 2, True, "female"),
        (1, "male", 2, 2, True, "female"),
        (1, "male", 2, 2, True, "female"),
    ]
    assert rows(people.gender_totals(people.papers_gender(paa, extra))) == [("female", 2), ("male", 4)]


def test_author_pairs_options(spark):
    paa = spark.createDataFrame(
        [(1, 4, 70, 1, 1), (1, 4, 71, 1, 2), (1, 2, 70, 2, 3), (2, 4, 70, 1, 4), (2, 4, 71, 1, 5)], PAA
    )
    paper = spark.createDataFrame([(1, 1990), (2, 1991)], "paper_id long, year int")
    # paper 2 has one author only, although with two institutions
    assert rows(collaboration.collab_authors(paa, paper)) == [
        (1, 4, 2, 1990),
        (1, 4, 2, 1990),
        (1, 4, 4, 1990),
    ]
    options = {"distinct_authors": True, "canonical": True}
    assert rows(collaboration.collab_authors(paa, paper, **options)) == [(1, 2, 4, 1990)]
    assert rows(collaboration.collab_institutions(paa, paper)) == [(1, 70, 71, 1990), (2, 70, 71, 1991)]


def test_first_top_field_and_first_lookup_match_win(spark):
    paa = spark.createDataFrame([(1, 1, 5, 1, 1), (1, 2, 5, 2, 2)], PAA)
    paper = spark.createDataFrame([(1, 2022)], "paper_id long, year int")
    fields = spark.createDataFrame(
        [(1, 1001, "Law", "Top", 2), (1, 1002, "Art", "Top", 1), (1, 101, "sub", "Sub", 3)],
        "paper_id long, field_id long, field_name string, field_type string, _seq int",
    )
    main = spark.createDataFrame([(1, 101)], "author_id long, author_main_field long")
    lookup = spark.createDataFrame(
        [("sub", "B", 1), ("sub", "A", 2)], "subfield_name string, topfield_name string, ordinal int"
    )
    people_fields = disciplines.author_fields(main, fields, lookup)
    collab = disciplines.collab_author_fields(paa, people_fields)
    table = disciplines.papers_auth_fields(paper, fields, collab)
    assert rows(table) == [
        (1, 2022, "2020-2021", "Art", 1, "B"),
        (1, 2022, "2020-2021", "Art", 2, None),
    ]
    assert rows(disciplines.field_edges(table)) == [("Art", "2020-2021", "Art", "B", 1)]
    assert disciplines.field_grid(table).count() == 7


def test_regions_override(spark):
    raw = spark.createDataFrame(
        [(1, "TW", 1), (2, "AR", 2), (3, None, 3), (None, "AR", 4)],
        "affiliation_id long, iso3166_code string, _seq int",
    )
    other = "affiliation_name grid_id official_page latitude_aff longitude_aff productivity_aff"
    other += " average_c10_aff average_log_c10_aff name"
    raw = raw.withColumns({c: F.lit("x") for c in other.split()})
    countries = spark.createDataFrame(
        [("AR", "Latin America and the Caribbean", "South America")],
        "iso2c string, subregion_un string, region string",
    )
    found = base_tables.affiliations(raw, countries).select("affiliation_id", "subregion_un", "region")
    assert rows(found) == [
        (1, "Eastern Asia", "Eastern Asia"),
        (2, "Latin America and the Caribbean", "South America"),
        (3, None, None),
    ]


def test_first_author_field_follows_the_input_order(spark):
    fields = spark.createDataFrame(
        [(1, 103, "C", "Sub", 1), (1, 105, "Z", "Sub", 2), (2, 105, "A", "Sub", 3), (1, 104, "D", "Sub", 4)],
        "paper_id long, field_id long, field_name string, field_type string, _seq long",
    )
    lookup = spark.createDataFrame(
        [("C", "TC", 1), ("Z", "TZ", 1), ("A", "TA", 1), ("D", "TD", 1)],
        "subfield_name string, topfield_name string, ordinal int",
    )
    main = spark.createDataFrame(
        [(1, 105, 1), (1, 103, 2), (2, None, 3), (2, 104, 4)],
        "author_id long, author_main_field long, _seq long",
    )
    found = disciplines.author_fields(main, fields, lookup)
    assert rows(found) == [(1, 105, "TZ"), (2, None, None)]
