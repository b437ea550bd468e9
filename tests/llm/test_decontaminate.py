import random

import numpy as np

from scimetrics.llm import decontaminate
from scimetrics.llm.words import read_words


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def items_and_docs(seed=2, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["th", "er", "on", "an", "re", "in", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(14, 60)))) for i in range(n)]
    docs, planted = [], set()
    for d in range(2 * n):
        words = [rng.choice(vocab) for _ in range(150)]
        if d % 2 == 0:
            item_id, text = items[d // 2]
            own = text.split()
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                at = rng.randrange(len(own))
                own[at] = own[at][:-1] + rng.choice("xyz")
            words[40:40] = own
            planted.add((d, item_id))
        docs.append((d, " ".join(words)))
    return items, docs, planted


def brute(items, docs):
    """Pairs with a window of as many words that meets the definition, by looking near every shared word pair."""
    found = set()
    for d, text in docs:
        words = text.lower().split()
        for i, item in items:
            own = item.lower().split()
            n, pairs = len(own), set(zip(own, own[1:]))
            hits = np.array([p in pairs for p in zip(words, words[1:])], int)
            most = int(len(" ".join(own)) * decontaminate.DISTANCE)
            for s in range(len(words) - n + 1):
                if hits[s : s + n - 1].sum() >= decontaminate.needed_pairs(n):
                    if edit_distance(" ".join(words[s : s + n]), " ".join(own)) <= most:
                        found.add((d, i))
    return found


def test_recall_against_brute_force(spark):
    items, docs, planted = items_and_docs()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, words int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, benchmark).collect()}
    want = brute(items, docs)
    assert planted <= want | got
    assert got <= want and len(got) >= 0.95 * len(want)


def test_exact_passages_and_edge_cases(spark):
    item = "One two three four five six seven eight nine ten eleven twelve"
    docs = [
        (1, f"x {item} y"), (2, f"x\n{item.upper().replace(' ', '  ')}"), (3, None), (4, ""), (5, "one two three"),
        (None, item), (6, "z " * 50000 + item), (6, "again " + item), (7, "twelve eleven ten nine eight seven six"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(
        [(1, item), (2, None), (3, "word"), (None, item), (1, item)], "item_id long, text string"
    )
    rows = decontaminate.contaminated(df, benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in rows) == [(1, 1, 0), (2, 1, 0), (6, 1, 0)]
    assert decontaminate.contaminated(df, benchmark.limit(0)).collect() == []
    assert decontaminate.contaminated(df.limit(0), benchmark).collect() == []


def test_embedding_is_the_same_wherever_it_stands():
    words = read_words(["a b cc ddd eeee", "zz a b cc ddd eeee yy"], lower=True)
    normal = decontaminate.normalised(words)
    start = np.array([0, 6])
    keys = decontaminate.cgk_keys(normal.data, normal.start[start], normal.end[start + 4], np.array([5, 5]))
    assert (keys[0] == keys[1]).all()
