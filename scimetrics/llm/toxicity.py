"""Toxicity by a classifier chain of linear models.

The categories are learned in order. The model of each one reads word features
and the probabilities of all earlier categories; while training, these are
out-of-fold predictions, so no model sees a probability that was fitted on the
same document. Training uses a bounded sample of labelled documents, scoring
covers every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.session import materialize

#: Name and condition over the columns of documents and labels; the last one decides.
CATEGORIES = (
    ("junk", "quality = 0"),
    ("abuse_en", "toxic = 1 and lang = 'en'"),
    ("abuse_other", "toxic = 1 and coalesce(lang, '') <> 'en'"),
    ("toxic", "toxic = 1"),
)
SAMPLE_ROWS, FOLDS = 6000, 5
LEAST_DOCUMENTS, MOST_FEATURES, LEAST_Z = 6, 300, 4.0
PENALTY = 0.5
PREFIXES = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]{4,}")


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words of four or more letters, and their beginnings marked by *."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


@dataclass
class Linear:
    columns: np.ndarray  # positions in the vocabulary
    weights: np.ndarray
    chain: np.ndarray  # weights of the earlier categories' probabilities
    bias: float

    def predict(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        z = x[:, self.columns] @ self.weights + earlier @ self.chain + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Penalised logistic regression by Newton steps on the most associated features."""
    n1, n0 = y.sum() + 1.0, (1 - y).sum() + 1.0
    c1, c0 = x[y == 1].sum(axis=0) + 0.5, x[y == 0].sum(axis=0) + 0.5
    z = np.log(c1 / n1) - np.log(c0 / n0)
    z = np.abs(z) / np.sqrt(1 / c1 + 1 / c0)
    order = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    columns = np.sort(order[z[order] >= LEAST_Z])
    design = np.hstack([x[:, columns], earlier, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(design.shape[1])
    w[-1] = np.log(n1 / n0)
    penalty = np.full(len(w), PENALTY)
    penalty[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + penalty * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 5 / np.abs(step).max())
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    k = len(columns)
    return Linear(columns, w[:k], w[k:-1], float(w[-1]))


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model per column of ``y``, each fed with the out-of-fold predictions of those before."""
    earlier, models = np.zeros((len(x), 0)), []
    for k in range(y.shape[1]):
        models.append(_fit(x, earlier, y[:, k]))
        unseen = np.zeros(len(x))
        for f in np.unique(fold):
            out = fold == f
            held = _fit(x[~out], earlier[~out], y[~out, k]) if (~out).any() else models[-1]
            unseen[out] = held.predict(x[out], earlier[out])
        earlier = np.hstack([earlier, unseen[:, None]])
    return models


@dataclass
class Chain:
    """A trained chain over a vocabulary of feature strings."""

    names: list[str]
    words: dict[str, int]
    models: list[Linear]

    def __post_init__(self) -> None:
        # only words with one of these beginnings can have a feature
        self.gate = {w[:4] for w in self.words}
        self.table = np.zeros((len(self.words) + 1, len(self.models)))
        for k, model in enumerate(self.models):
            self.table[model.columns, k] = model.weights

    def found(self, text: str | None) -> list[int]:
        hits = set()
        for word in set(_WORD.findall((text or "").lower())):
            if word[:4] in self.gate:
                for name in (word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]):
                    if (i := self.words.get(name)) is not None:
                        hits.add(i)
        return sorted(hits)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        sums = np.array([self.table[self.found(t)].sum(axis=0) for t in texts])
        sums = sums.reshape(len(texts), len(self.models))
        p = np.zeros_like(sums)
        for k, model in enumerate(self.models):
            z = sums[:, k] + p[:, :k] @ model.chain + model.bias
            p[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p


def _hashes(names: list[str]) -> np.ndarray:
    if not names:
        return np.empty(0, np.int64)
    return pd.util.hash_array(np.array(names, dtype=object), categorize=False).view(np.int64)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(features=[_hashes(sorted(features(t))) for t in batch["text"]]).drop(columns="text")


def _associated(hashed: DataFrame, names: list[str]) -> list[int]:
    """The features most associated with any category, at most 2 * MOST_FEATURES of each.

    Counted in Spark, so that the driver sees no more than these.
    """
    totals = hashed.agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    counts = (
        hashed.select(F.explode("features").alias("feature"), *names)
        .groupBy("feature")
        .agg(F.count("*").alias("_n"), *[F.sum(n).alias(n) for n in names])
        .where(F.col("_n") >= LEAST_DOCUMENTS)
    )
    counts = materialize(counts, "features")
    found: set[int] = set()
    for name in names:
        with_, without = F.col(name) + 0.5, F.col("_n") - F.col(name) + 0.5
        rate = F.log(with_ / (totals[name] + 1.0)) - F.log(without / (totals["n"] - totals[name] + 1.0))
        z = F.abs(rate) / F.sqrt(1 / with_ + 1 / without)
        best = counts.select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(2 * MOST_FEATURES)
        found |= {r["feature"] for r in best.collect()}
    return sorted(found)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: tuple[tuple[str, str], ...] = CATEGORIES,
    sample_rows: int = SAMPLE_ROWS,
) -> Chain:
    """Fit the chain on the ``sample_rows`` labelled documents with the smallest hashed doc_id.

    Rows without doc_id are not used; a condition that is null counts as
    false. A category with one class gets a model that says so; without
    labelled documents every probability is one half.
    """
    names = [name for name, _ in categories]
    chosen = (
        labels.where("doc_id is not null")
        .drop("lang", "text")
        .withColumn("_order", F.xxhash64(F.col("doc_id").cast("long"), F.lit(2)))
        .orderBy("_order", *[c for c in labels.columns if c in ("quality", "toxic")])
        .limit(sample_rows)
    )
    text = docs.select(F.col("doc_id"), F.col("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = text.join(F.broadcast(chosen), "doc_id").select(
        "doc_id",
        F.pmod("_order", F.lit(FOLDS)).cast("int").alias("fold"),
        *[F.coalesce(F.expr(rule), F.lit(False)).cast("int").alias(name) for name, rule in categories],
        "text",
    )
    rows = materialize(rows, "labelled")
    if rows.isEmpty():
        nothing = [Linear(np.empty(0, int), np.empty(0), np.zeros(k), 0.0) for k in range(len(names))]
        return Chain(names, {}, nothing)
    flags = ", ".join(f"`{n}` int" for n in names)
    hashed = rows.mapInPandas(_hashed, f"doc_id long, fold int, {flags}, features array<long>")
    useful = np.array(_associated(materialize(hashed, "hashed"), names), np.int64)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(useful, _hashes(list(features(t))))) for t in batch["text"]]
            yield batch.assign(columns=found).drop(columns="text")

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = sorted(set().union(*[features(t) for t in batch["text"]]))
            hashes = _hashes(every)
            place = np.minimum(np.searchsorted(useful, hashes), max(len(useful) - 1, 0))
            hit = np.flatnonzero(useful[place] == hashes) if len(useful) else []
            if len(hit):
                yield pd.DataFrame({"name": [every[i] for i in hit], "position": place[hit]})

    sample = rows.mapInPandas(sparse, f"doc_id long, fold int, {flags}, columns array<long>").toPandas()
    sample = sample.sort_values(["doc_id", *names], kind="stable")
    x = np.zeros((len(sample), len(useful)), np.float32)
    for i, columns in enumerate(sample["columns"]):
        x[i, np.asarray(columns, np.int64)] = 1
    models = fit_chain(x, sample[names].to_numpy(np.float64), sample["fold"].to_numpy())
    found = rows.select("text").mapInPandas(spelled, "name string, position long").distinct().toPandas()
    words = dict(zip(found["name"], found["position"].tolist()))
    return Chain(names, words, models)


def score(df: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with a struct column ``toxicity``: p_<category> of each category, and ``toxic``.

    ``toxic`` is true when the last category's probability reaches
    ``threshold``. A null or empty text has no features and gets the chain's
    base probabilities. Every row is scored by itself, so null and repeated ids
    do not matter. An empty table gives an empty result.
    """
    names = [f"p_{name}" for name in chain.names]
    model = df.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def probabilities(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.value.probabilities(text.tolist()), columns=names)

    scored = df.withColumn("toxicity", probabilities(F.col(text_col)))
    flag = F.col(f"toxicity.{names[-1]}") >= threshold
    return scored.withColumn("toxicity", F.col("toxicity").withField("toxic", flag))
