"""Periodic runs against a search of all periods."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scimetrics.llm import periods
from scimetrics.llm.queries import op12_periods

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of all runs: every period, every longest stretch, smallest period first."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        j = 0
        while j < n - q:
            k = j
            while k < n - q and words[k] == words[k + q]:
                k += 1
            if k + q - j >= max(6, 4 * q):
                found.setdefault((j, k + q - j), q)
            j = max(k, j + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def runs_of(lists):
    flat = np.array([w for t in lists for w in t], np.int64)
    begin, end, q = periods.find_runs(flat, np.array([len(t) for t in lists]))
    return list(zip(begin.tolist(), (end - begin).tolist(), q.tolist()))


def placed(lists):
    found, at = [], 0
    for words in lists:
        found += [(s + at, n, q) for s, n, q in brute(words)]
        at += len(words)
    return sorted(found, key=lambda r: (r[0], r[2]))


piece = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 40))
text = st.lists(piece, max_size=4).map(
    lambda parts: [w for words, times, rest in parts for w in words * times + words[:rest]]
)


@settings(max_examples=150, deadline=None)
@given(st.lists(text, max_size=5))
def test_equals_brute_force(lists):
    assert runs_of(lists) == placed(lists)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_equals_brute_force_on_two_words(words):
    assert runs_of([words]) == placed([words])


def test_every_period_at_four_times_its_length():
    for q in [*range(1, 70), 127, 128, 129, 255, 256, 300]:
        noise = list(range(10_000, 10_050))
        words = noise + [i % q for i in range(max(6, 4 * q))] + noise
        assert runs_of([words]) == [(50, max(6, 4 * q), q)]
        assert runs_of([words[:-51]]) == []


def test_no_run_crosses_two_texts():
    assert runs_of([[1, 2] * 3, [1, 2] * 3]) == []
    assert runs_of([[], [1] * 6, [], [1] * 5]) == [(0, 6, 1)]


def test_nested_runs_and_long_texts():
    inner = [1, 1, 1, 1, 1, 1, 2, 3] * 40
    assert runs_of([inner]) == placed([inner])
    long = np.tile(np.arange(5_000), 9).tolist()
    assert runs_of([long, [7] * 100_000]) == [(0, 45_000, 5_000), (45_000, 100_000, 1)]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    first = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs), *first, first[0] if first[0] is None else 1000 * first[1] // first[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs)),
    )


NAMES = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op12_periods(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert sum(r["n_runs"] > 0 for r in got) > 5
    # brute force takes the square of a text's words
    for row in sorted(got, key=lambda r: len(docs[r["doc_id"]] or ""))[:185]:
        assert tuple(row[c] for c in NAMES) == expected(row["doc_id"], docs[row["doc_id"]])


def test_nulls_blanks_repeated_rows_and_other_columns(spark):
    rows = [
        (1, "a b " * 4 + "c", "x"),
        (1, "a b " * 4 + "c", "x"),
        (None, "a " * 9, None),
        (2, None, "x"),
        (3, "", "x"),
        (4, " a\xa0b\x1cc \x0b\t" * 7, "x"),
        (-7, "one", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = periods.periodic_runs(df)
    got = sorted(
        (-99 if r["doc_id"] is None else r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
        for r in found.collect()
    )
    word = " a\xa0b\x1cc"
    assert got == [
        (-99, 9, [(0, 9, 1)], "a"), (-7, 1, [], "one"), (1, 9, [(0, 8, 2)], "a b c"), (1, 9, [(0, 8, 2)], "a b c"),
        (2, 0, [], ""), (3, 0, [], ""), (4, 7, [(0, 7, 1)], word),
    ]
    digest = {r["doc_id"]: r for r in periods.digests(found).collect()}
    assert digest[2]["start"] is None and digest[2]["exponent_milli"] is None
    assert digest[2]["runs_sha256"] == digest[2]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    planted = {r["doc_id"]: r["text"] for r in periods.with_planted_runs(df).collect()}
    assert planted[None] == "a " * 9 and planted[2] == ""
    assert periods.periodic_runs(df.limit(0)).collect() == []
