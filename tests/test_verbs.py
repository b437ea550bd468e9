"""Row rules of the small operators: missing keys, ties, order, fills."""

import math

import pytest
from pyspark.sql import functions as F

from scimetrics.functions import expressions, periods
from scimetrics.functions.names import clean_names, column_range, safe_label, snake_case
from scimetrics.operators.dedupe import keep_first
from scimetrics.operators.joins import join_na, without_words
from scimetrics.operators.ranking import top_k_ties
from scimetrics.operators.reshape import complete, crossing, ordered_pairs, repeat_rows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keep_first_takes_the_earliest_row_and_groups_missing_keys(spark):
    df = spark.createDataFrame(
        [(1, "a", 2), (1, "b", 1), (None, "d", 4), (None, "c", 3)], "k int, v string, _seq int"
    )
    assert rows(keep_first(df, ["k"])) == [(1, "b"), (None, "c")]
    assert rows(keep_first(df, ["k"], keep_order=True)) == [(1, "b", 1), (None, "c", 3)]


def test_keep_first_orders_by_a_struct(spark):
    df = spark.createDataFrame([(1, "a", "f2", 0), (1, "b", "f1", 9)], "k int, v string, f string, i int")
    df = df.select("k", "v", F.struct("f", "i").alias("_seq"))
    assert rows(keep_first(df, ["k"])) == [(1, "b")]


def test_distinct_count_counts_missing_once(spark):
    df = spark.createDataFrame(
        [("x", "a"), ("x", None), ("y", "a"), ("y", "b"), ("z", None), ("z", None)], "g string, v string"
    )
    found = df.groupBy("g").agg(expressions.n_distinct(F.col("v")).alias("n"))
    assert rows(found) == [("x", 2), ("y", 2), ("z", 1)]


def test_join_matches_missing_to_missing(spark):
    left = spark.createDataFrame([(1,), (None,)], "k int")
    right = spark.createDataFrame([(None, "x")], "j int, v string")
    assert rows(join_na(left, right, [("k", "j")])) == [(1, None), (None, "x")]


def test_without_words_keeps_missing(spark):
    df = spark.createDataFrame([("data",), ("water",), (None,)], "w string")
    assert rows(without_words(df, "w", ["data"])) == [("water",), (None,)]
    listed = spark.createDataFrame([("data",), ("data",)], "s string")
    assert rows(without_words(df, "w", listed)) == [("water",), (None,)]


def test_top_k_keeps_ties_and_puts_missing_last(spark):
    df = spark.createDataFrame(
        [("g", "a", 5), ("g", "b", 5), ("g", "c", 4), ("h", "d", None), ("h", "e", 1)],
        "g string, w string, n int",
    )
    assert [r[1] for r in rows(top_k_ties(df, ["g"], "n", 1))] == ["a", "b", "e"]
    assert [r[1] for r in rows(top_k_ties(df, ["g"], "n", 2))] == ["a", "b", "d", "e"]
    assert [r[1] for r in rows(top_k_ties(df, ["g"], "n", 3))] == ["a", "b", "c", "d", "e"]


def test_pairs_follow_row_order_and_keep_self_pairs(spark):
    df = spark.createDataFrame(
        [(1, "B", 3, 3), (1, "A", 1, 3), (1, "A", 2, 3), (2, "C", 1, 1)],
        "p int, a string, _seq int, size int",
    )
    assert rows(ordered_pairs(df, "p", "a", "size", ("x", "y"))) == [
        (1, "A", "A"),
        (1, "A", "B"),
        (1, "A", "B"),
    ]


def test_pairs_of_a_large_group_do_not_depend_on_its_blocks(spark):
    df = spark.range(61).select(
        F.lit(1).alias("p"), F.col("id").alias("a"), (100 - F.col("id")).alias("_seq"), F.lit(61).alias("size")
    )
    whole = rows(ordered_pairs(df, "p", "a", "size", ("x", "y")))
    cut = rows(ordered_pairs(df, "p", "a", "size", ("x", "y"), block_rows=7))
    assert len(whole) == 61 * 60 // 2
    assert cut == whole


def test_complete_fills_observed_labels_only(spark):
    wide = spark.createDataFrame(
        [(1, 2, None, 0), (2, 0, 1, 0), (3, 0, None, 0)], "p int, female int, male int, other int"
    )
    found = complete(wide, ["p"], ["female", "male", "other"], "g", "n")
    assert rows(found) == [(1, "female", 2), (1, "male", 0), (2, "female", 0), (2, "male", 1)]


def test_crossing_and_repeat(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "f string")
    assert rows(crossing(df, "q", ["y", "x", "x"])) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    counted = spark.createDataFrame([("a", 2), ("b", 0), ("c", None)], "w string, n int")
    assert rows(repeat_rows(counted, "n")) == [("a",), ("a",)]


def test_periods(spark):
    years = [1989, 1990, 1994, 1995, 2021, 2022, 2023, None]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    y = F.col("y")
    found = [
        tuple(r)
        for r in df.select(
            periods.period_by_breaks(y), periods.period_by_label(y), periods.period_by_first_year(y)
        ).collect()
    ]
    p90, p95, p20 = "1990-1994", "1995-1999", "2020-2021"
    assert found == [
        (None, None, None),
        (p90, p90, p90),
        (p90, p90, None),
        (p95, p95, p95),
        (p20, p20, None),
        (p20, None, None),
        (None, None, None),
        (None, None, None),
    ]


def test_entropy_and_pair_share(spark):
    df = spark.createDataFrame(
        [("one", "x", 2), ("two", "x", 1), ("two", "y", 1), ("gap", "x", 1), ("gap", None, 1)],
        "p string, c string, n int",
    )
    found = dict(rows(df.groupBy("p").agg(expressions.shannon(F.col("n")))))
    assert found["one"] == 0.0
    assert found["two"] == pytest.approx(math.log(2)) == found["gap"]
    sizes = spark.createDataFrame([(2,), (3,), (1,)], "k int")
    assert [r[0] for r in sizes.select(expressions.pair_share(F.col("k"))).collect()] == [1.0, 1 / 3, None]


def test_gender_labels(spark):
    df = spark.createDataFrame([(0.75,), (0.25,), (0.5,), (None,)], "p double")
    label = expressions.gender_of(F.col("p"))
    found = df.select(label, expressions.gender_order(label)).collect()
    assert [tuple(r) for r in found] == [
        ("female", 1),
        ("male", 2),
        ("indeterminate", 3),
        ("indeterminate", 3),
    ]
    other = spark.createDataFrame([("x",)], "g string").select(
        expressions.as_gender(F.col("g")), expressions.gender_order(F.col("g"))
    )
    assert rows(other) == [(None, None)]


def test_names(spark):
    given = ["P(gf)", "H.index_auth", "PaperID", "Hit_1pct", "Average_LogC10_auth", "ISO3166Code", "DOI"]
    expect = ["p_gf", "h_index_auth", "paper_id", "hit_1pct", "average_log_c10_auth", "iso3166_code", "doi"]
    assert [snake_case(n) for n in given] == expect
    df = clean_names(spark.createDataFrame([(1, 2, 3)], "PaperID int, paper_id int, _seq int"))
    assert df.columns == ["paper_id", "paper_id_2", "_seq"]
    assert column_range(df, "paper_id", "paper_id_2") == ["paper_id", "paper_id_2"]
    label = spark.createDataFrame([("Art & Design (new)",)], "f string").select(safe_label(F.col("f")))
    assert rows(label) == [("art_design_new",)]
