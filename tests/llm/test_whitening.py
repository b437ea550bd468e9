"""Whitening against numpy, and its border cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scimetrics.llm import whitening
from scimetrics.llm.queries import op11_whitening

FOLDER = "/root/testdata/sf0.001"


def expected(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    apart = n * x - total
    centred = apart / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return (apart**2).sum(1), values[::-1], centred @ axes[:, ::-1], centred.var(0).sum()


def fits(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def test_query_equals_numpy(spark):
    rows = [r for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect() if fits(r["embedding"])]
    deviation, values, axes, trace = expected([r["embedding"] for r in rows])
    got = op11_whitening(spark, FOLDER).toPandas()
    assert got.columns.tolist() == "vec_id component n deviation whitened explained identity_error".split()
    assert len(got) == 32 * len(rows) and set(got["n"]) == {len(rows)}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    for k in range(1, 33):
        mine = wide[k].loc[[r["vec_id"] for r in rows]].to_numpy()
        want = axes[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert np.allclose(got[got["component"] == k]["explained"], values[k - 1] / trace, rtol=1e-9)
    assert got.groupby("vec_id")["deviation"].first().loc[[r["vec_id"] for r in rows]].tolist() == deviation.tolist()


def test_blocks_of_any_height_give_the_same_scatter(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(333, 7)) @ rng.normal(size=(7, 7))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 10)
    monkeypatch.setattr(whitening, "GROUP_BLOCKS", 3)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    found = whitening.whiten(df, components=4)
    _, values, _, trace = expected(vectors)
    assert np.allclose(found.eigenvalues, values[:4], rtol=1e-10)
    assert np.allclose(found.explained, values[:4] / trace)
    assert found.identity_error < 1e-9
    assert found.rows.count() == 333


def test_unusable_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0, 2.0], "a"),
        (2, [0.25, -1.0, 0.0], "b"),
        (2, [0.25, -1.0, 0.0], "b"),
        (None, [3.0, 0.1, -7.0], None),
        (3, None, "c"),
        (4, [1.0, None, 2.0], "d"),
        (5, [nan, 1.0, 2.0], "e"),
        (6, [inf, 1.0, 2.0], "f"),
        (7, [1.0, 2.0], "g"),
        (8, [], "h"),
        (9, [1e300, 0.0, 0.0], "i"),
        (10, [1.0, 0.0, 5.0], "j"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, index string")
    found = whitening.whiten(df.withColumn("x", F.lit(1)).withColumn("row", F.lit(2)), components=3)
    assert found.n == 5
    assert sorted((r["vec_id"] or 0, r["index"], r["row"]) for r in found.rows.collect()) == [
        (0, None, 2), (1, "a", 2), (2, "b", 2), (2, "b", 2), (10, "j", 2)
    ]
    got = whitening.component_rows(found).collect()
    assert len(got) == 15 and sorted({r["component"] for r in got}) == [1, 2, 3]


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]], [None]])
def test_no_variance_no_components(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = whitening.whiten(df)
    assert whitening.component_rows(found).collect() == []
    assert len(found.eigenvalues) == 0


def test_constant_dimension_is_left_out(spark):
    rows = [(i, [float(i), 1.0, float(i * i)]) for i in range(20)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(found.eigenvalues) == 2 and found.identity_error < 1e-9


def test_deviation_is_exact_beyond_64_bits(spark):
    rows = [(i, [float(i) * 1000003.0]) for i in range(16)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [64 * 1000003 * i + 1_000_000 for i in range(16)]
    got = {r["vec_id"]: int(r["deviation"]) for r in found.rows.collect()}
    assert got == {i: (16 * x[i] - sum(x)) ** 2 for i in range(16)}
