"""Recall of op8 against a brute force that knows only the edit distance."""

import random

import numpy as np
import pytest

from scimetrics.llm import decontaminate

SYLLABLES = ["th", "er", "on", "an", "re", "in", "st", "ció", "ñas", "ble"]


def free_distance(item, text):
    """Edit distance of the best piece of the text."""
    codes = np.array([ord(c) for c in text])
    row = np.zeros(len(codes) + 1, int)
    steps = np.arange(len(codes) + 1)
    for c in item:
        new = np.concatenate([[row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def changed(text, kind, rng):
    words = text.split()
    some = lambda share: rng.sample(range(len(words)), max(1, int(share * len(words))))
    if kind == "letters":
        for i in some(0.4):
            k = rng.randrange(len(words[i]))
            words[i] = words[i][:k] + "q" + words[i][k + 1 :]
    elif kind == "indels":
        for i in some(0.35):
            k = rng.randrange(len(words[i]))
            words[i] = words[i][:k] + (words[i][k] + "q" if rng.random() < 0.5 else "") + words[i][k + 1 :]
    elif kind == "front":
        words[: max(1, len(words) // 12)] = ["qqq"]
    elif kind == "joined":
        text = " ".join(words)
        for _ in range(3):
            blanks = [i for i, c in enumerate(text) if c == " "]
            k = rng.choice(blanks)
            text = text[:k] + text[k + 1 :]
        return text
    elif kind == "dropped":
        for _ in range(2):
            del words[rng.randrange(1, len(words) - 1)]
    elif kind == "inserted":
        for _ in range(2):
            words.insert(rng.randrange(1, len(words)), "qu")
    return " ".join(w for w in words if w)


def planted(kinds, seed=3, n=24):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 45)))) for i in range(n)]
    docs = []
    for kind in kinds:
        for i, text in items:
            filler = [rng.choice(vocab) for _ in range(60)]
            filler[30:30] = [changed(text, kind, rng)]
            docs.append((len(docs), " ".join(filler)))
    return items, docs


def within_limit(items, docs):
    return {
        (d, i)
        for d, text in docs
        for i, item in items
        if free_distance(item, text) <= int(len(item) * decontaminate.DISTANCE)
    }


@pytest.mark.parametrize("kind", ["letters", "indels", "front"])
def test_no_passage_within_the_limit_is_filtered_out(kind):
    items, docs = planted([kind])
    index = decontaminate.item_index(*zip(*items), decontaminate.DISTANCE)
    data = np.frombuffer("".join(t + " " for _, t in docs).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in docs])])
    found = decontaminate.candidates(data, bounds, index)
    want = within_limit(items, docs)
    assert len(want) >= 10 and want <= set(zip(found["text"], found["item"]))


def test_chunks_of_any_size_give_the_same_candidates(monkeypatch):
    items, docs = planted(["letters", "dropped"])
    # a common opening makes many items share the same runs
    items = [(i, "the following sentence opens every item " + t) for i, t in items]
    docs = [(d, t + " the following sentence opens every item") for d, t in docs]
    index = decontaminate.item_index(*zip(*items), decontaminate.DISTANCE)
    data = np.frombuffer("".join(t + " " for _, t in docs).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in docs])])
    rows = lambda: {tuple(map(int, r)) for r in decontaminate.candidates(data, bounds, index).itertuples(index=False)}
    whole = rows()
    for chunk, hits in ((2_000, 10**9), (50_000, 500), (777, 100)):
        monkeypatch.setattr(decontaminate, "CHUNK", chunk)
        monkeypatch.setattr(decontaminate, "HITS", hits)
        assert rows() == whole
    assert len(whole) > 100


def test_joined_dropped_and_inserted_words_are_found(spark):
    items, docs = planted(["joined", "dropped", "inserted"])
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, benchmark).collect()}
    want = within_limit(items, docs)
    assert got == want and len(want) >= 50


def test_items_without_blanks_are_found(spark):
    passage = "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少"
    docs = [(1, f"前文{passage}後文"), (2, f"前文{passage.replace('聞', '')}後文"), (3, "前文後文" * 9), (4, "Word."), (5, "wor d")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, passage), (2, "word")], "item_id long, text string")
    rows = decontaminate.contaminated(df, benchmark).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 0, 0, 1), (2, 1, 1, 0, 1), (4, 2, 0, 0, 1)]


def test_the_walk_reads_the_item_to_its_end():
    text = "ñandúñandúñandú " * 3
    data = np.frombuffer((text + text[:-2] + "x ").encode("utf-32-le"), np.uint32)
    n = len(text)
    keys = decontaminate.cgk_keys(data, np.array([0, n]), np.array([n - 1, 2 * n - 1]), np.array([n - 1] * 2))
    assert (keys[0] != keys[1]).any()


def test_recall_of_the_whole_chain_at_the_edit_limit(spark):
    items, docs = planted(["letters", "indels", "front"], seed=4)
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, benchmark).collect()}
    want = within_limit(items, docs)
    assert got <= want and len(want) >= 40 and len(got) >= 0.99 * len(want)
