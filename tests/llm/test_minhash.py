import random

from scimetrics.llm import minhash


def brute(rows, size, percent):
    """Components of documents by their exact shingle sets."""
    import re

    sets = []
    for _, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and shared and 100 * shared >= percent * union:
                root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best[find(i)] = min(doc_id, best.get(find(i), doc_id)) if doc_id is not None else None
    return sorted(((d, len(s), best[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(n=150, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    return rows


def ours(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, set_id int")
    got = minhash.near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def test_equals_brute_force(spark):
    rows = corpus() + [
        (900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (None, "one"),
        (905, "É b"), (906, "é b"), (907, "word " * 30000), (908, "word word"),
    ]
    assert ours(spark, rows, size=2) == brute(rows, 2, 80)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (9, "x y")]
    assert ours(spark, rows) == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 1, 9)]
    assert ours(spark, []) == []


def test_pruning_keeps_close_pairs():
    least = minhash.least_matches(80, 1e-4)
    assert len(least) == 4 and all(0 < m < 0.8 * 64 * (k + 1) for k, m in enumerate(least))


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minhash, "LEFT_BLOCK", 3)
    monkeypatch.setattr(minhash, "RIGHT_BLOCK", 5)
    monkeypatch.setattr(minhash, "LEFT_SHINGLES", 300)
    monkeypatch.setattr(minhash, "RIGHT_SHINGLES", 500)
    rows = corpus(120, seed=8)
    assert ours(spark, rows, size=2) == brute(rows, 2, 80)
