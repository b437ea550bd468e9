"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact check.

Signatures are compared batch by batch. After n compared values with m equal
ones the posterior of the similarity (uniform prior) decides: a pair is given
up once P(similarity >= threshold) falls below ``miss``. Survivors are
confirmed on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.llm.tables import checked, components, id_columns, known_ids
from scimetrics.llm.words import Words, read_words, runs, text_slices
from scimetrics.session import materialize

BANDS, ROWS = 32, 4
VALUES, BATCH = 256, 64
#: Larger buckets are compared in blocks of signatures instead of rows of pairs.
SMALL_BUCKET, LEFT_BLOCK, RIGHT_BLOCK = 12, 512, 4096
#: Shingles in a block of full sets; a member counts SIGNED more.
LEFT_SHINGLES, RIGHT_SHINGLES, SIGNED = 200_000, 1_000_000, 64

_rng = np.random.default_rng(6)
_A = _rng.integers(1, 2**63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES, np.uint64)
_FOLD = _rng.integers(1, 2**63, ROWS, np.uint64)

SKETCH = "doc_id long, n_shingles long, set_id long, signature binary, bands array<long>"


def least_matches(percent: int, miss: float) -> list[int]:
    """Fewest equal values that keep a pair alive after each batch.

    With a uniform prior P(similarity >= x | m of n) = P(Binomial(n + 1, x) <= m).
    Only the low byte of a value is kept, which makes chance equalities a little
    more likely and so prunes a little less.
    """
    x, least = percent / 100, []
    for n in range(BATCH, VALUES + 1, BATCH):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
            if below >= miss:
                break
        least.append(m)
    return least


def shingle_set(words: Words, i: int, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of text i; a shorter text is one shingle."""
    own = words.hashes[words.of(i)]
    return np.unique(runs(own, min(size, len(own)))) if len(own) else own


def _set_id(values: np.ndarray) -> int:
    return int.from_bytes(blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signature(values: np.ndarray) -> np.ndarray:
    lowest = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(lowest, (values[at : at + 2048, None] * _A + _B).min(axis=0), out=lowest)
    return lowest >> np.uint64(32)


def _sketches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in text_slices(batch["text"].tolist()):
            rows, words = [], read_words(batch["text"].tolist()[part], lower=True)
            for i in range(len(words.first) - 1):
                values = shingle_set(words, i, size)
                if not len(values):
                    rows.append((0, None, None, None))
                    continue
                signature = _signature(values)
                banded = signature[: BANDS * ROWS].reshape(BANDS, ROWS)
                keys = (banded * _FOLD).sum(axis=1, dtype=np.uint64)
                keys = (keys ^ (keys >> np.uint64(29))) * _A[:BANDS] + _B[:BANDS]
                low = signature.astype(np.uint8).tobytes()
                rows.append((len(values), _set_id(values), low, keys.view(np.int64)))
            sizes, sets, low, bands = zip(*rows)
            yield pd.DataFrame(
                {
                    "doc_id": known_ids(batch.iloc[part]).array,
                    "n_shingles": sizes,
                    "set_id": pd.array(sets, "Int64"),
                    "signature": low,
                    "bands": bands,
                }
            )


def _sets(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in text_slices(batch["text"].tolist()):
            words = read_words(batch["text"].tolist()[part], lower=True)
            sets = [shingle_set(words, i, size) for i in range(len(words.first) - 1)]
            sets = [s for s in sets if len(s)]
            if sets:
                yield pd.DataFrame(
                    {"set_id": [_set_id(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]}
                )


def _promising(batches: Iterator[pd.DataFrame], least: list[int]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        alive = np.arange(len(batch))
        a = np.frombuffer(b"".join(batch["sig_a"]), np.uint8).reshape(-1, VALUES)
        b = np.frombuffer(b"".join(batch["sig_b"]), np.uint8).reshape(-1, VALUES)
        equal = np.zeros(len(batch), int)
        for k, needed in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            equal[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
            alive = alive[equal[alive] >= needed]
        yield batch[["a", "b"]].iloc[alive]


def _reached(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted sets ``others`` reach the threshold with the sorted set ``own``."""
    size = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    at[at == len(own)] = 0
    shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size) - size)
    return 100 * shared >= percent * (len(own) + size - shared)


def _block(frame: pd.DataFrame, least: list[int], percent: int) -> pd.DataFrame:
    """One block of a group, its left rows against its right rows.

    Without full sets: the (group, set_id) that have a promising pair. With
    them: pairs (a, b) that reach the threshold, one for every left row and
    component on the right, as any one unites the two components.
    """
    frame = frame.reset_index(drop=True)
    left, right = frame[frame["left"]], frame[~frame["left"]]
    exact = "shingles" in frame
    seen, found = [np.empty(0, np.int64)], [pd.DataFrame({"a": [], "b": []}, dtype=np.int64)]
    if len(right):
        body = np.frombuffer(b"".join(right["signature"]), np.uint8).reshape(-1, VALUES)
        ids, roots, parts = (right[c].to_numpy() for c in ("set_id", "root", "part"))
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in right["shingles"]] if exact else []
        for row in left.itertuples(index=False):
            own = np.frombuffer(row.signature, np.uint8)
            alive = np.flatnonzero((roots != row.root) & ((parts != row.part) | (ids > row.set_id)))
            equal = np.zeros(len(alive), int)
            for k, needed in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal += (body[alive, part] == own[part]).sum(axis=1)
                keep = equal >= needed
                alive, equal = alive[keep], equal[keep]
            if not len(alive):
                continue
            if exact:
                whole = np.asarray(row.shingles, np.int64).view(np.uint64)
                near = alive[_reached(whole, [sets[i] for i in alive], percent)]
                near = near[np.unique(roots[near], return_index=True)[1]]
                found.append(pd.DataFrame({"a": row.set_id, "b": ids[near]}))
            else:
                seen += [[row.set_id], ids[alive]]
    if exact:
        return pd.concat(found)
    return pd.DataFrame({"set_id": np.unique(np.concatenate(seen))}).assign(group=frame["group"].iloc[0])


def _promising_pairs(pairs: DataFrame, classes: DataFrame, least: list[int]) -> DataFrame:
    signed = classes.select("set_id", "signature")
    both = pairs.join(signed.toDF("a", "sig_a"), "a").join(signed.toDF("b", "sig_b"), "b")
    return both.mapInPandas(partial(_promising, least=least), "a long, b long")


def _blocks(rows: DataFrame, least: list[int], percent: int) -> DataFrame:
    """``_block`` over ``rows(group, set_id, root, signature, left, right[, shingles])`` within their groups.

    Rows with ``left`` form bounded blocks that meet bounded blocks of the rows
    with ``right``: a task gets a block of each, and pairs exist in its memory
    only. Rows on both sides meet once. Full sets make blocks by their size.
    The number of partitions is stated, so that blocks with few bytes and much
    work are not merged into few tasks.
    """
    exact = "shingles" in rows.columns
    weight = F.size("shingles") + SIGNED if exact else F.lit(1)
    left, right = (LEFT_SHINGLES, RIGHT_SHINGLES) if exact else (LEFT_BLOCK, RIGHT_BLOCK)
    blocks = lambda side, size: F.ceil(F.sum(F.when(F.col(side), weight).otherwise(0)) / size)
    sizes = rows.groupBy("group").agg(blocks("left", left).alias("parts"), blocks("right", right).alias("pages"))
    sizes = materialize(sizes.where("parts > 0 and pages > 0"), "sizes")
    rows = rows.join(sizes, "group")
    rows = rows.withColumn("part", F.when(F.col("left"), F.pmod(F.xxhash64("set_id"), "parts")))
    rows = materialize(rows.withColumn("page", F.pmod(F.xxhash64("set_id", F.lit(1)), "pages")), "rows")
    columns = ["group", "set_id", "root", "signature", F.coalesce("part", F.lit(-1)).alias("part")]
    columns += ["shingles"] if exact else []
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n)
    lefts = rows.where("left").select(
        *columns, F.lit(True).alias("left"), F.col("part").alias("p"), F.explode(upto(F.col("pages") - 1)).alias("q")
    )
    rights = rows.where("right").select(
        *columns, F.lit(False).alias("left"), F.explode(upto(F.coalesce("part", F.col("parts") - 1))).alias("p"), F.col("page").alias("q")
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lefts.unionByName(rights).repartition(tasks, "group", "p", "q").groupBy("group", "p", "q").applyInPandas(
        partial(_block, least=least, percent=percent), "a long, b long" if exact else "group long, set_id long"
    )


def _across(
    placed: DataFrame, classes: DataFrame, docs: DataFrame, least: list[int], size: int, percent: int
) -> DataFrame:
    """Links between different components that share a bucket, enough to unite all that are linked.

    The members outside a bucket's largest component, its guests, are compared
    with that whole component, once for all buckets, and with the guests of
    the same bucket that are in other components. Signatures say which members
    have promising pairs; these meet again with their full sets. So what a
    group hands on grows with its members, not with its pairs.
    """
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("home"), F.sum("n").alias("n"))
    sizes = materialize(sizes.where("n > home.n").select("bucket", F.col("home.root").alias("home"), F.expr("n - home.n").alias("guests")), "mixed")
    guests = materialize(placed.join(sizes, "bucket").where("root <> home"), "guests")
    signed = classes.select("set_id", "signature")

    visits = guests.select(F.col("home").alias("group"), "set_id", "root").distinct()
    homes = guests.select(F.col("home").alias("group")).distinct()
    nodes = placed.select("set_id", "root").distinct()
    hosts = nodes.join(homes, nodes["root"] == homes["group"]).select("group", "set_id", "root")
    rows = visits.withColumn("left", F.lit(True)).unionByName(hosts.withColumn("left", F.lit(False)))
    rows = materialize(rows.withColumn("right", ~F.col("left")).join(signed, "set_id"), "visits")
    large = guests.where(f"guests > {SMALL_BUCKET}").select(
        F.col("bucket").alias("group"), "set_id", "root", F.lit(True).alias("left"), F.lit(True).alias("right")
    )
    large = materialize(large.join(signed, "set_id"), "large")
    met = [(x, materialize(_blocks(x, least, percent).distinct(), "met")) for x in (rows, large)]

    small = materialize(guests.where(f"guests between 2 and {SMALL_BUCKET}"), "small").select("bucket", "set_id", "root")
    left, right = small.toDF("bucket", "a", "ra"), small.toDF("bucket", "b", "rb")
    pairs = left.join(right, "bucket").where("ra < rb").select("a", "b").distinct()
    few = materialize(_promising_pairs(pairs, classes, least), "few")

    wanted = few.select(F.explode(F.array("a", "b")).alias("set_id"))
    for _, some in met:
        wanted = wanted.unionByName(some.select("set_id"))
    sets = _full_sets(wanted.distinct(), classes, docs, size)
    found = _confirmed(few, sets, percent)
    for x, some in met:
        own = x.join(some, ["group", "set_id"], "left_semi").join(sets, "set_id")
        found = found.unionByName(materialize(_blocks(materialize(own, "own"), least, percent), "near"))
    return found


def _full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(set_id, shingles) of the classes ``wanted(set_id)``, each read from one document."""
    wanted = materialize(wanted.join(classes.select("set_id", "doc_id"), "set_id"), "wanted")
    texts = docs.join(checked(materialize(wanted.select("doc_id").distinct(), "wanted"), 24), "doc_id")
    sets = texts.mapInPandas(partial(_sets, size=size), "set_id long, shingles array<long>")
    # a repeated doc_id may bring other texts along
    return materialize(sets.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")


def _confirmed(alive: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the promising pairs whose shingle sets reach the threshold."""
    both = alive.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return materialize(both.where(100 * shared >= percent * union).select("a", "b"), "near")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    miss: float = 1e-4,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Words are lower-cased in A-Z only. Documents with 100 * intersection >=
    ``percent`` * union of their sets of ``size``-word shingles are linked.
    Equal sets form one class before anything is compared. Every bucket first
    compares its members with one leader; members still in different
    components of a common bucket are compared with each other after that, so
    no candidate is left out and no pair inside a found group is made.

    Texts that are null, empty or white space have no shingles, are linked with
    nothing and kept. A row without doc_id has no component_id, links nothing
    and is kept. Rows that repeat a doc_id are rows of their own. Other columns
    are ignored. An empty table gives an empty result.
    """
    docs = df.select(*id_columns(id_col), F.col(text_col).alias("text"))
    sketches = materialize(docs.mapInPandas(partial(_sketches, size=size), SKETCH), "sketches")
    known = sketches.where("set_id is not null and doc_id is not null")
    first = known.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    body = known.select("set_id", "signature", "bands").dropDuplicates(["set_id"])
    classes = materialize(body.join(first, "set_id"), "classes")
    docs = docs.where("not no_id")

    buckets = classes.select("set_id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("set_id").alias("a"), F.count("*").alias("n"))
    shared = materialize(shared.where("n > 1").select("bucket", "a"), "buckets")
    members = materialize(buckets.join(shared, "bucket"), "members")
    pairs = members.where("a <> set_id").select("a", F.col("set_id").alias("b")).distinct()
    least = least_matches(percent, miss)
    alive = materialize(_promising_pairs(pairs, classes, least), "alive")
    wanted = alive.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    near = _confirmed(alive, _full_sets(wanted, classes, docs, size), percent)
    roots = materialize(components(near), "roots")

    placed = members.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = materialize(
        placed.select("bucket", "set_id", F.coalesce("root", "set_id").alias("root")), "placed"
    )
    more = _across(placed, classes, docs, least, size, percent)
    if not more.isEmpty():
        roots = materialize(components(near.unionByName(more)), "roots")

    placed = known.select("doc_id", "set_id").distinct()
    placed = placed.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = placed.select("doc_id", "set_id", F.coalesce("root", "set_id").alias("root"))
    placed = materialize(placed, "placed")
    names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = materialize(names, "names")
    final = materialize(placed.join(names, "root").select("doc_id", "set_id", "component_id"), "final")
    alone = F.when(F.col("set_id").isNull(), F.col("doc_id"))
    component = F.coalesce("component_id", alone)
    return (
        sketches.select("doc_id", "n_shingles", "set_id")
        .join(final, ["doc_id", "set_id"], "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
