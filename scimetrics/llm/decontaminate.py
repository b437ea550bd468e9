"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit distance.

Texts are compared lower-cased in A-Z with single spaces. A passage is any
piece of a document, in characters, within the edit limit of an item. Counts
of shared character runs bound the places where one can begin: they lose none
(see ``needed_runs``). The CGK random walk maps an item-sized window there to
a string whose Hamming distance follows the edit distance; windows that share
a key of sampled steps with the item are confirmed by their edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.llm.tables import id_columns, known_ids
from scimetrics.llm.words import LOWER, SPACE, Words, mix, read_words, text_slices
from scimetrics.session import materialize

#: Largest edit distance, as a share of the item's characters.
DISTANCE = 0.10
#: Share of word pairs that the first brute force of the tests looks near; the operator does not use it.
INTACT_PAIRS = 0.40
#: Characters of a shared run, less for short items.
RUN = 8
#: Steps of a walk per character: half of them move on, so the end is reached with steps to spare.
STEPS_PER_CHAR = 3
WALKS, SAMPLED = 3, 3
#: Chance that a window at the edit limit shares a key, if it agrees in this share of the steps.
TARGET_RECALL, AGREEMENT = 0.999, 0.40
#: Characters and keys of the items that tasks hold at a time.
BATCH = 4_000_000
#: Characters of documents read at a time, characters searched at a time, shared runs held at a time.
SLICE, CHUNK, HITS = 1_000_000, 250_000, 2_000_000


def tables_for(recall: float, agreement: float) -> int:
    """Tables of a walk so that WALKS walks find a window with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**SAMPLED) / WALKS)


TABLES = tables_for(TARGET_RECALL, AGREEMENT)


def _samples(n: int) -> np.ndarray:
    """Sampled steps of the items of size n: (WALKS, TABLES, SAMPLED)."""
    return np.random.default_rng([82, n]).integers(0, STEPS_PER_CHAR * n, (WALKS, TABLES, SAMPLED))


def needed_pairs(n: int) -> int:
    return max(1, math.ceil(INTACT_PAIRS * (n - 1)))


def run_length(n: int, edits: int) -> int:
    """Cut into ``edits + 1`` pieces of this length, one piece of n characters stays whole."""
    return min(RUN, n // (edits + 1))


def needed_runs(n: int, edits: int) -> int:
    """Runs of an item of n characters that ``edits`` edits leave whole: each breaks at most ``run_length``."""
    q = run_length(n, edits)
    return n - q + 1 - edits * q


@dataclass
class Normal:
    """Bytes of a batch, lower-cased, one space after every word; word offsets in them."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def normalised(words: Words) -> Normal:
    raw = LOWER[np.frombuffer(words.data, np.uint8)]
    space = SPACE[raw]
    after = space & np.concatenate([[False], ~space[:-1]])
    keep = ~space | after
    place = np.concatenate([[0], np.cumsum(keep)])
    raw = np.where(space, np.uint8(32), raw)[keep]
    return Normal(raw, place[words.start], place[words.end])


def _characters(normal: Normal) -> Normal:
    """The same in code points instead of bytes."""
    data = np.frombuffer(normal.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(data) == len(normal.data):
        return Normal(data, normal.start, normal.end)
    place = np.concatenate([[0], np.cumsum((normal.data & 0xC0) != 0x80)])
    return Normal(data, place[normal.start], place[normal.end])


def cgk_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(windows, WALKS * TABLES) keys of the strings ``data[begin:end]`` for items of ``sizes`` characters.

    A walk emits the character it stands on, as a byte, and moves on if the
    random bit of the step and the byte says so; behind the end it emits zeros.
    """
    count = len(begin)
    keys = np.zeros((count, WALKS * TABLES), np.uint64)
    if not count:
        return keys
    order = np.argsort(-sizes, kind="stable")
    begin, end, sizes = begin[order], end[order], sizes[order]
    steps = STEPS_PER_CHAR * int(sizes[0])
    # by step first, so that a longer walk begins like a shorter one
    bits = np.random.default_rng(81).integers(0, 2, (steps, WALKS, 256), np.uint8)
    walk = np.arange(WALKS)[:, None]
    padded = np.append(data, data.dtype.type(0))
    seen = np.zeros((steps, WALKS, count), np.uint8)
    at = np.repeat(begin[None, :].astype(np.int64), WALKS, axis=0)
    active = np.searchsorted(-sizes, -(np.arange(steps) // STEPS_PER_CHAR), "left")
    for j in range(steps):
        now = at[:, : active[j]]
        byte = np.where(now < end[: active[j]], padded[now] & 0xFF, 0).astype(np.uint8)
        seen[j, :, : active[j]] = byte
        now += bits[j][walk, byte]
        np.minimum(now, end[: active[j]], out=now)
    for n in np.unique(sizes):
        rows, sample = np.flatnonzero(sizes == n), _samples(int(n))
        number = np.arange(WALKS * TABLES, dtype=np.uint64).reshape(WALKS, TABLES)
        for w in range(WALKS):
            key = np.repeat((number[w] + np.uint64(int(n) * 1000))[:, None], len(rows), axis=1)
            for k in range(SAMPLED):
                key = mix(key + seen[sample[w, :, k], w][:, rows] + np.uint64(1))
            keys[order[rows], w * TABLES : (w + 1) * TABLES] = key.T
    return keys


def _runs(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of every run of q characters, by doubling."""
    base, out, size = 0x9E3779B97F4A7C15, None, 0
    power, width = data.astype(np.uint64) + np.uint64(1), 1
    while q:
        if q & 1:
            if out is None:
                out, size = power, width
            else:
                n = len(power) - size
                out = power[:n] * np.uint64(pow(base, size, 2**64)) + out[width : width + n]
                size += width
        q >>= 1
        if q:
            power = power[:-width] * np.uint64(pow(base, width, 2**64)) + power[width:]
            width *= 2
    return out * np.uint64(0xFF51AFD7ED558CCD)


@dataclass
class Index:
    """Items of a batch: their texts, limits and keys; by run length the slots, hashes and places of their runs."""

    ids: np.ndarray
    texts: list[str]
    size: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    keys: np.ndarray
    runs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def item_index(ids: list[int], texts: list[str], distance: float) -> Index:
    size = np.array([len(t) for t in texts])
    edits = np.array([math.floor(n * distance) for n in size])
    needed = np.array([needed_runs(int(n), int(d)) for n, d in zip(size, edits)])
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    end = np.cumsum(size)
    parts = [
        cgk_keys(data, (end - size)[at : at + 5000], end[at : at + 5000], size[at : at + 5000])
        for at in range(0, len(size), 5000)
    ]
    lengths = np.array([run_length(int(n), int(d)) for n, d in zip(size, edits)])
    groups = []
    for q in np.unique(lengths):
        own = np.flatnonzero(lengths == q)
        hashes = np.concatenate([_runs(data[end[i] - size[i] : end[i]], int(q)) for i in own])
        count = size[own] - q + 1
        item = np.repeat(own, count)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        order = np.argsort(hashes, kind="stable")
        known, first = np.unique(hashes[order], return_index=True)
        bits = min(25, max(20, int(len(known)).bit_length() + 4))
        slots = np.zeros(1 << bits, bool)
        slots[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
        first = np.append(first, len(item))
        groups.append((int(q), bits, slots, known, first, item[order], offset[order]))
    return Index(np.array(ids, np.int64), texts, size, edits, needed, np.concatenate(parts), groups)


def _distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of an ascending array and how often each occurs."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``size`` of them."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _matches(data: np.ndarray, index: Index) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By run length the places of runs known to the index, and where and how many are the items' equal runs."""
    found = []
    for q, bits, slots, known, first, item, offset in index.runs:
        if len(data) < q:
            continue
        hashes = _runs(data, q)
        place = np.flatnonzero(slots[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
        at = np.searchsorted(known, hashes[place])
        at[at == len(known)] = 0
        same = known[at] == hashes[place]
        place, at = place[same], at[same]
        found.append((place, first[at], first[at + 1] - first[at], item, offset))
    return found


def candidates(data: np.ndarray, bounds: np.ndarray, index: Index) -> pd.DataFrame:
    """(item, text, low, start): window starts, and the first start of the band that they stand in.

    The data are searched in chunks that overlap by the widest band, so every
    band lies whole in one of them. A chunk with more than HITS shared runs is
    halved, which bounds memory whatever the items have in common.
    """
    overlap = int((index.size + 2 * index.edits).max()) + 2
    open_ = [(at, min(at + CHUNK + overlap, len(data))) for at in range(0, len(data), CHUNK)]
    parts = []
    while open_:
        begin, end = open_.pop()
        found = _matches(data[begin:end], index)
        if end - begin > 4 * overlap and sum(int(x[2].sum()) for x in found) > HITS:
            middle = (begin + end) // 2
            open_ += [(begin, middle + overlap), (middle, end)]
        else:
            parts.append(_banded(found, begin, bounds, index))
    return pd.concat(parts).drop_duplicates() if parts else pd.DataFrame(columns=["item", "text", "low", "start"])


def _banded(found: list[tuple], base: int, bounds: np.ndarray, index: Index) -> pd.DataFrame:
    """Candidates among the shared runs of one chunk that begins at ``base``.

    A passage keeps ``needed_runs`` runs of its item, and their diagonals
    (place less offset) are at most ``edits`` apart, so they lie in two
    consecutive strips of ``edits + 1`` diagonals.
    """
    rows = [(_spans(at, count), np.repeat(place + base, count), i, o) for place, at, count, i, o in found]
    item = np.concatenate([i[r] for r, _, i, _ in rows] or [np.empty(0, np.int64)])
    place = np.concatenate([p for _, p, _, _ in rows] or [np.empty(0, np.int64)])
    diagonal = place - np.concatenate([o[r] for r, _, _, o in rows] or [np.empty(0, np.int64)])
    wide, top = index.edits[item] + 1, 1 << 40
    shift = int(index.size.max()) + 1
    key = item * top + (diagonal + shift) // wide + 1
    order = np.argsort(key)
    key = key[order]
    strips, count = _distinct(key)
    # a band is a strip and the next one; the one before a strip has hits in its second half only
    bands, _ = _distinct(np.sort(np.concatenate([strips, strips - 1]), kind="stable"))
    total = np.zeros(len(bands), np.int64)
    strips, count = np.append(strips, -1), np.append(count, 0)
    for step in (0, 1):
        at = np.searchsorted(strips[:-1], bands + step)
        total += np.where(strips[at] == bands + step, count[at], 0)
    bands = bands[total >= index.needed[(bands + 1) // top]]
    parts = []
    for step in (0, 1):
        begin, end = np.searchsorted(key, bands + step, "left"), np.searchsorted(key, bands + step, "right")
        rows = order[_spans(begin, end - begin)]
        parts.append(
            pd.DataFrame(
                {
                    "band": np.repeat(bands, end - begin),
                    "item": item[rows],
                    "text": np.searchsorted(bounds, place[rows], "right") - 1,
                    "start": diagonal[rows],
                }
            )
        )
    found = pd.concat(parts)
    hits = found.groupby(["band", "text"])["start"].transform("size")
    found = found[hits.to_numpy() >= index.needed[found["item"].to_numpy()]].drop_duplicates()
    wide = index.edits[found["item"].to_numpy()] + 1
    low = (found["band"] - found["item"] * top - 1) * wide - shift
    return found.assign(low=low)[["item", "text", "low", "start"]]


def _regions(kept: pd.DataFrame, index: Index) -> pd.DataFrame:
    """(item, text, low, high): first and last band of every chain of overlapping bands."""
    kept = kept[["item", "text", "low"]].drop_duplicates().sort_values(["text", "item", "low"])
    same = (kept[["text", "item"]].diff() == 0).all(axis=1)
    chained = same & (kept["low"].diff() <= index.edits[kept["item"].to_numpy()] + 1)
    chain = (~chained).cumsum()
    return kept.groupby(chain.to_numpy()).agg(
        item=("item", "first"), text=("text", "first"), low=("low", "first"), high=("low", "last")
    )


def _distances(item: str, text: str, anchored: bool) -> list[int]:
    """Edit distance of ``item`` to the best piece of ``text`` that ends at every place, or to every prefix (Myers)."""
    n, where = len(item), {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << (n - 1)
    plus, minus, now = full, 0, n
    out = [n]
    for c in text:
        eq = where.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(across | plus) & full
        down = plus & across
        now += bool(up & last) - bool(down & last)
        up, down = (up << 1 | anchored) & full, down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        out.append(now)
    return out


def best_passage(item: str, text: str) -> tuple[int, int, int]:
    """(edits, begin, end) of the best piece of ``text``, the first to end, the shortest."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    ends = _distances(item, text, False)
    edits = min(ends)
    end = ends.index(edits)
    begins = _distances(item[::-1], text[max(0, end - len(item) - edits) : end][::-1], True)
    return edits, end - begins.index(edits), end


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in text_slices(batch["text"].tolist()):
            words = read_words(batch["text"].tolist()[part], lower=True)
            normal = normalised(words)
            first, last = words.first[:-1], words.first[1:]
            some = np.flatnonzero(last > first)
            if not len(some):
                continue
            begin, end = normal.start[first[some]], normal.end[last[some] - 1]
            texts = [normal.data[b:e].tobytes().decode("utf-8", "replace") for b, e in zip(begin, end)]
            yield pd.DataFrame({"item_id": batch["item_id"].iloc[part].to_numpy()[some], "item": texts})


def _passages(batches: Iterator[pd.DataFrame], index: Index) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in text_slices(batch["text"].tolist(), SLICE):
            words = read_words(batch["text"].tolist()[part], lower=True)
            if not len(words.start):
                continue
            normal = _characters(normalised(words))
            filled = np.flatnonzero(words.first[1:] > words.first[:-1])
            bounds = np.append(normal.start[words.first[filled]], len(normal.data))
            ids = known_ids(batch.iloc[part]).array[filled]
            found = candidates(normal.data, bounds, index)
            kept = []
            for at in range(0, len(found), 5000):
                some = found.iloc[at : at + 5000]
                item, text = some["item"].to_numpy(), some["text"].to_numpy()
                begin = np.maximum(some["start"].to_numpy(), bounds[text])
                end = np.minimum(some["start"].to_numpy() + index.size[item], bounds[text + 1] - 1)
                keys = cgk_keys(normal.data, begin, np.maximum(begin, end), index.size[item])
                kept.append(some[(keys == index.keys[item]).any(axis=1)])
            if not kept:
                continue
            best = {}
            for item, text, low, high in _regions(pd.concat(kept), index).itertuples(index=False):
                if best.get((text, item), (1,))[0] == 0:
                    continue
                d, n = int(index.edits[item]), int(index.size[item])
                # the start is within d diagonals of a band's 2 d + 2, the passage at most n + d long
                begin = max(low - d, int(bounds[text]))
                end = min(high + 2 * d + 1 + d + n + d, int(bounds[text + 1]) - 1)
                piece = normal.data[begin:end].tobytes().decode("utf-32-le", "replace")
                edits, b, e = best_passage(index.texts[item], piece)
                if edits <= d:
                    best[text, item] = min(best.get((text, item), (n + 1,)), (edits, begin + b, begin + e))
            if not best:
                continue
            text, item = (np.array(x) for x in zip(*best))
            edits, begin, end = (np.array(x) for x in zip(*best.values()))
            # words that the passage touches
            first = np.searchsorted(normal.end, begin, "right")
            yield pd.DataFrame(
                {
                    "doc_id": ids[text],
                    "item_id": index.ids[item],
                    "edits": edits,
                    "word": first - words.first[filled[text]],
                    "words": np.searchsorted(normal.start, end, "left") - first,
                }
            )


def _batches(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["item"])
        size += len(row["item"]) + WALKS * TABLES
        if size >= BATCH:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    distance: float = DISTANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, edits, word, words): best passage of every pair found.

    A passage is a piece of the text, from any character to any other, whose
    edit distance is at most ``distance`` of the item's characters. ``word`` is
    the word in which it begins, from 0, and ``words`` how many it touches.

    Empty items, null texts and rows without an id match nothing; the passages
    of rows that repeat a doc_id are taken together. Other columns are ignored;
    an empty table on either side gives an empty result. Items go to the tasks
    in batches of bounded size; documents are read once per batch.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = materialize(items.where("item_id is not null").mapInPandas(_items, "item_id long, item string"), "items")
    docs = df.select(*id_columns(id_col), F.coalesce(text_col, F.lit("")).alias("text")).where("not no_id")
    schema = "doc_id long, item_id long, edits int, word long, words int"
    found = spark.createDataFrame([], schema)
    for ids, texts in _batches(items):
        shared = spark.sparkContext.broadcast(item_index(ids, texts, distance))

        def passages(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return _passages(batches, shared.value)

        found = found.unionByName(materialize(docs.mapInPandas(passages, schema), "passages"))
        shared.destroy()
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "word", "words")).alias("best"))
    return best.select("doc_id", "item_id", "best.edits", "best.word", "best.words")
