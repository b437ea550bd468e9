import numpy as np
import pandas as pd

from scimetrics.llm import projections


def brute(rows, cosine):
    n = len(rows)
    ok = [
        v and l is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for i, v, l in rows
    ]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    best = {}
    for i in range(n):
        if rows[i][0] is not None:
            best[find(i)] = min(rows[i][0], best.get(find(i), rows[i][0]))
    return sorted(((r[0], links[i], best.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 16))
    rows = []
    for i in range(400):
        v = centres[rng.integers(20)] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(500 + i, rows[0][1], rows[0][2]) for i in range(30)]
    one = [float(i + 1) for i in range(16)]
    rows += [
        (600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [float("nan")] + one[1:], 1), (604, [None] + one[1:], 1),
        (605, one, None), (606, one, 2), (607, [2 * x for x in one], 2), (608, one[:3], 2), (609, [float("inf")] + one[1:], 2),
        (None, one, 2), (606, one, 2),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, class int")
    got = projections.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(projections, "COUNT_BLOCK", 7)
    monkeypatch.setattr(projections, "BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.ones(8) + rng.standard_normal(8) * 0.2], 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = projections.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 0.93)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert projections.near_vectors(df).collect() == []


def test_recall_near_the_limit_in_one_large_label(spark, tmp_path):
    rng = np.random.default_rng(6)
    n, pairs, cosine = 100_000, 1000, 0.932
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, 64))
    side -= (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * side])
    pd.DataFrame({"vec_id": np.arange(n + pairs), "embedding": list(x), "label": 0}).to_parquet(tmp_path / "v.parquet")
    got = projections.near_vectors(spark.read.parquet(str(tmp_path / "v.parquet"))).where("n_links > 0")
    met = {r.vec_id for r in got.where(f"vec_id >= {n} and component_id = vec_id - {n}").collect()}
    # three standard deviations of a thousand pairs under the stated bound
    assert len(met) >= (1 - projections.MISS) * pairs - 3 * np.sqrt(pairs * projections.MISS)
