import random
import re

import numpy as np
import pytest

from scimetrics.llm import repeats
from scimetrics.llm.fmindex import FmIndex, WaveletMatrix, suffix_array


def brute(rows, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (doc_id, _), own in zip(rows, words):
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            if doc_id is not None:
                first[key] = min(doc_id, first.get(key, doc_id))
    out = []
    for (doc_id, _), own in zip(rows, words):
        keep = [True] * len(own)
        for i in range(len(own) - window + 1):
            if doc_id is not None and first[tuple(own[i : i + window])] < doc_id:
                keep[i : i + window] = [False] * window
        out.append((doc_id, len(own), len(own) - sum(keep), " ".join(w for w, k in zip(own, keep) if k)))
    return sorted(out, key=str)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"é{i}" for i in range(300)] + ["the"] * 100
    shared = [[rng.choice(vocab) for _ in range(rng.randint(20, 150))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            part = list(rng.choice(shared))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "changed"
            a = rng.randint(0, len(part) // 3)
            words += part[a:] + [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("window", [50, 20])
def test_equals_brute_force(spark, window):
    rows = corpus() + [(100, None), (101, ""), (102, " \n"), (None, "a " * 80), (None, "a " * 80), (103, "b " * 70)]
    rows += [(104, "b " * 60 + "c " * 60), (5, corpus()[5][1]), (200, corpus()[7][1]), (201, corpus()[7][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, copy int")
    got = [tuple(r) for r in repeats.remove_repeats(df, window).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=str) == brute(rows, window)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_WORDS", 120)
    rows = corpus(seed=9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in repeats.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=str) == brute(rows, 50)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_index_parts():
    rng = np.random.default_rng(1)
    symbols = np.append(rng.integers(1, 9, 300), 0)
    order = suffix_array(symbols)
    assert order.tolist() == sorted(range(301), key=lambda i: symbols[i:].tolist())
    matrix = WaveletMatrix(symbols, 9)
    for c in range(9):
        at = np.arange(302)
        assert matrix.rank(np.full(302, c), at).tolist() == [int((symbols[:i] == c).sum()) for i in at]


def test_partial_matches_and_owners():
    index = FmIndex([(3, [b"%d" % i for i in range(30)]), (9, [b"x"] * 20)])
    words = [b"%d" % i for i in range(5, 25)]
    hit, late, broken, own = index.matched(
        [(4, words), (3, words), (4, words[:9] + [b"?"] + words[10:]), (9, [b"x"] * 12)], 10
    )
    assert hit.all() and not late.any() and not own.any()
    assert broken.tolist() == [False] * 10 + [True] * 10
