"""Near-duplicate vectors by sorted projection passes.

Every pass hashes the vectors with random hyperplanes of its own and orders
them lexicographically by the bits. A vector is compared with a bounded window
of its neighbours in that order; pairs that pass the exact cosine test are
united over all passes. Link counts are then exact within every component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimetrics.llm.tables import components
from scimetrics.session import materialize

#: Fewest passes; large labels take more, see ``passes_for``.
PASSES, WINDOW, BLOCK, BITS = 12, 32, 2048, 62
COUNT_BLOCK = 512
#: Largest expected share of the pairs at the cosine limit that meet in no pass.
MISS = 0.01


def passes_for(n: int, cosine: float, window: int) -> int:
    """Passes over a label of ``n`` vectors for an expected miss of MISS at ``cosine``.

    Two vectors meet once they share so many leading bits that about ``window``
    vectors of the label share them too; a bit differs with probability angle
    / pi. This takes the label to be spread evenly over the bits.
    """
    differs = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    meet = (1 - differs) ** max(0.0, math.log2(max(n, 1) / window))
    if meet == 1:
        return PASSES
    return max(PASSES, math.ceil(math.log(MISS) / math.log(1 - meet)))


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _keys(batches: Iterator[pd.DataFrame], passes: int) -> Iterator[pd.DataFrame]:
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        for dim, part in batch.groupby(batch["vector"].map(len)):
            x = np.stack(part["vector"].to_numpy()).astype(np.float64)
            packed = [v.tobytes() for v in x / np.linalg.norm(x, axis=1, keepdims=True)]
            for p in range(passes):
                planes = np.random.default_rng([5, p, dim]).standard_normal((dim, BITS))
                yield pd.DataFrame(
                    {
                        "pass": p,
                        "label": part["label"],
                        "dim": dim,
                        "key": (x @ planes > 0) @ weights,
                        "class": part["class"],
                        "unit": packed,
                    }
                )


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the pairs that join two trees."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    used = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = find(i), find(j)
        if i != j:
            root[i] = j
            used.append(k)
    return used


def _windowed(frame: pd.DataFrame, cosine: float, window: int) -> pd.DataFrame:
    """A spanning forest of the links between rows at most ``window`` apart."""
    frame = frame.sort_values("rank", kind="stable")
    group = frame[["pass", "label", "dim"]].to_numpy()
    ids = frame["class"].to_numpy()
    left, right = [], []
    for dim, rows in frame.reset_index(drop=True).groupby("dim").groups.items():
        rows = np.asarray(rows)
        x = np.frombuffer(b"".join(frame["unit"].iloc[rows]), np.float64).reshape(len(rows), dim)
        for step in range(1, min(window, len(rows) - 1) + 1):
            a, b = rows[:-step], rows[step:]
            same = (group[a] == group[b]).all(axis=1)
            near = np.einsum("ij,ij->i", x[:-step], x[step:]) >= cosine
            hit = np.flatnonzero(same & near)
            left.append(a[hit])
            right.append(b[hit])
    if not left:
        return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
    a, b = np.concatenate(left), np.concatenate(right)
    used = _forest(len(ids), a, b)
    return pd.DataFrame({"a": ids[a[used]], "b": ids[b[used]]})


def _counted(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of every member to the other block of its component, copies included."""
    out = []
    first = frame["block"].eq(frame["low"])
    left = frame[first]
    right = left if frame["low"].iloc[0] == frame["high"].iloc[0] else frame[~first]
    for side, other in ((left, right),) if left is right else ((left, right), (right, left)):
        if len(side) and len(other):
            x = np.stack([np.frombuffer(u, np.float64) for u in side["unit"]])
            y = np.stack([np.frombuffer(u, np.float64) for u in other["unit"]])
            links = (x @ y.T >= cosine) @ other["copies"].to_numpy()
            out.append(pd.DataFrame({"class": side["class"], "links": links}))
    return pd.concat(out) if out else pd.DataFrame({"class": [], "links": []})


def near_vectors(
    df: DataFrame,
    cosine: float = 0.93,
    passes: int | None = None,
    window: int = WINDOW,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors link when their labels are equal and not null and their cosine, in
    double precision, is at least ``cosine``. Equal vectors form one class
    first. The passes find components; the links inside a component are then
    counted exactly, block against block. Without ``passes`` their number
    follows the largest label (``passes_for``).

    Vectors that are null, empty, zero, or hold null or non-finite values link
    with nothing, nor do vectors of different length or rows without vec_id
    (whose component_id is null). Rows that repeat a vec_id are vectors of
    their own. Other columns are ignored; an empty table gives an empty result.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).alias("label"),
    )
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector"))
    rows = rows.withColumn("class", F.when(usable, F.xxhash64("label", "vector")))
    valid = rows.where("class is not null")
    classes = valid.groupBy("class").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first")
    )
    bodies = valid.select("class", "label", "vector").dropDuplicates(["class"])
    classes = materialize(classes.join(bodies, "class"), "vectors")

    if passes is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        passes = passes_for(largest, cosine, window)
    label = dict(df.dtypes)[label_col]
    schema = f"pass int, label {label}, dim int, key long, class long, unit binary"
    keyed = classes.select("class", "label", "vector").mapInPandas(partial(_keys, passes=passes), schema)
    order = ["pass", "label", "dim", "key", "class"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "passes")
    part = F.shiftright("at", 33)
    # one row per partition, not per vector
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["n"]
    starts = df.sparkSession.createDataFrame(starts, "part long, begin long")
    ranked = placed.join(F.broadcast(starts), part == F.col("part")).withColumn(
        "rank", F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)
    )
    block = F.floor(F.col("rank") / BLOCK)
    lead = F.col("rank") % BLOCK >= BLOCK - window
    blocks = F.when(lead, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = ranked.select("pass", "label", "dim", "class", "unit", "rank", F.explode(blocks).alias("block"))
    links = dealt.groupBy("block").applyInPandas(
        lambda frame: _windowed(frame, cosine, window), "a long, b long"
    )
    roots = materialize(components(links), "roots").toDF("class", "root")

    members = classes.select("class", "copies", "first", "vector").join(roots, "class", "left")
    members = members.withColumn("root", F.coalesce("root", "class"))
    group = members.groupBy("root").agg(
        F.count("*").alias("n"), F.sum("copies").alias("all"), F.min("first").alias("component_id")
    )
    group = materialize(group, "groups")
    members = materialize(members.join(group, "root"), "members")
    several = members.where("n > 1")
    blocks = F.ceil(F.col("n") / COUNT_BLOCK)
    own = F.pmod(F.xxhash64("class"), blocks)
    unit = several.select("root", "class", "copies", own.alias("block"), F.col("vector"), blocks.alias("blocks"))
    paired = unit.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    paired = paired.select(
        "root", "class", "copies", "block", F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"), "vector",
    )
    paired = paired.mapInPandas(_units, "root long, class long, copies long, block long, low long, high long, unit binary")
    counted = paired.groupBy("root", "low", "high").applyInPandas(
        lambda frame: _counted(frame, cosine), "class long, links long"
    )
    counted = counted.groupBy("class").agg(F.sum("links").alias("links"))
    result = members.join(counted, "class", "left").select(
        "class", "component_id", (F.coalesce("links", "copies") - 1).alias("links")
    )
    result = materialize(result, "linked")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "class").join(result, "class", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        units = []
        for v in batch["vector"]:
            x = np.asarray(v, np.float64)
            units.append((x / np.linalg.norm(x)).tobytes())
        yield batch.drop(columns="vector").assign(unit=units)
