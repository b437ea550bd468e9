"""Periodic runs of words by string synchronising sets.

A run is a longest stretch of words whose smallest period is q and that is at
least four periods long. Runs with q from t to 2t - 1, t a power of two, are
proposed by the synchronising set of scale t: positions that a hash picks from
the t + 1 stretches of t words around them, so that equal surroundings pick
equal places. In such a run the next picked place with the same 2t words is
exactly q further on, and each run holds at least one such pair, because
stretches of a period up to t / 4 alone are left out of the choice. These
belong to runs of smaller scales, which are known by then; periods below the
first scale are found by direct comparison. Every proposal is checked word by
word, so the hashes never decide that something repeats.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.llm.tables import id_columns, known_ids
from scimetrics.llm.words import mix, text_slices

FIRST_SCALE = 4
LEAST_REPEATS = 4
LEAST_WORDS = 6
SLICE_CHARACTERS = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# str.split() also cuts at these, which are parts of words here
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_NONE = np.uint64(2**64 - 1)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> list[str]:
    return _WORD.findall(text) if _OTHER_BLANKS.search(text) else text.split()


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every longest stretch of true values."""
    edges = np.diff(np.concatenate([[0], equal.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours, a power of two, by doubling."""
    step = 1
    while step < size:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values


class _Found:
    """Runs by begin and end, each with its smallest period."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}

    def add(self, begin: int, end: int, q: int) -> None:
        key = begin, end
        if end - begin >= LEAST_REPEATS * q and q < self.period.get(key, q + 1):
            self.period[key] = q


def _extended(x: np.ndarray, begin: int, end: int, q: int) -> tuple[int, int]:
    """The longest stretch around ``begin`` to ``end`` in which words ``q`` apart agree, in growing steps."""
    step = 32
    while end < len(x):
        part = x[end : end + step] == x[end - q : end - q + len(x[end : end + step])]
        if not part.all():
            end += int(np.argmin(part))
            break
        end += len(part)
        step *= 2
    step = 32
    while begin > 0:
        low = max(0, begin - step)
        part = (x[low:begin] == x[low + q : begin + q])[::-1]
        if not part.all():
            begin -= int(np.argmin(part))
            break
        begin = low
        step *= 2
    return begin, end


def _proposals(level: np.ndarray, context: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Picked places with the same surroundings, a period from ``scale`` to 2 ``scale`` - 1 apart.

    ``level`` holds the hash of the stretch of ``scale`` words at each place,
    ``_NONE`` where it may not be picked; ``context`` that of twice as many words.
    """
    n = len(context)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    window = np.minimum(_least(level, scale)[:n], level[scale : scale + n])
    picked = np.flatnonzero(((window == level[:n]) | (window == level[scale : scale + n])) & (window != _NONE))
    own = context[picked]
    order = np.argsort(own, kind="stable")
    own, picked = own[order], picked[order]
    apart = np.diff(picked)
    near = np.flatnonzero((own[1:] == own[:-1]) & (apart >= scale) & (apart < 2 * scale))
    return picked[near], apart[near]


def _direct(x: np.ndarray, found: _Found) -> None:
    """Runs with a period below the first scale."""
    for q in range(1, min(FIRST_SCALE, len(x))):
        begin, end = _stretches(x[:-q] == x[q:])
        long = end - begin >= (LEAST_REPEATS - 1) * q
        for a, b in zip(begin[long].tolist(), (end[long] + q).tolist()):
            found.add(a, b, q)


def _verified(x: np.ndarray, at: np.ndarray, q: np.ndarray, scale: int, found: _Found) -> None:
    """Extend every proposal to its longest stretch; proposals inside a known stretch are passed over."""
    order = np.lexsort((at, q))
    reached = last = -1
    for a, period in zip(at[order].tolist(), q[order].tolist()):
        if period != last:
            last, reached = period, -1
        if a < reached - period:
            continue
        begin, end = a, a + period + 2 * scale
        if not np.array_equal(x[begin : end - period], x[begin + period : end]):
            continue
        begin, end = _extended(x, begin, end, period)
        reached = end
        found.add(begin, end, period)


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and smallest period of all runs in several texts of numbered words.

    ``words`` are the texts one after the other, ``sizes`` their lengths. A
    border with a number of its own stands between two texts, so that no run
    crosses it. Texts too short for a scale are left out of it.
    """
    found = _Found()
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    texts = np.flatnonzero(sizes >= LEAST_REPEATS)
    scale = 1
    joined = places = level = None
    while True:
        keep = texts[sizes[texts] >= LEAST_REPEATS * max(scale, 1)]
        if not len(keep):
            break
        if joined is None or len(keep) < len(texts):
            # texts that stay, each followed by its border
            texts, own = keep, sizes[keep] + 1
            ends = np.cumsum(own)
            shift = np.repeat(starts[keep] - (ends - own), own)
            places = np.arange(ends[-1]) + shift
            border = np.zeros(ends[-1], bool)
            border[ends - 1] = True
            joined = np.where(border, -1 - np.arange(ends[-1]), words[np.minimum(places, len(words) - 1)])
            level, size = mix(joined.astype(np.uint64) * _SALT + _SALT), 1
            while size < scale:
                level, size = mix(level[:-size] * _SALT + level[size:]), size * 2
            offset = ends - own
        if scale == 1:
            small = _Found()
            _direct(joined, small)
            for (a, b), q in small.period.items():
                found.add(int(places[a]), int(places[b - 1]) + 1, q)
        if scale >= FIRST_SCALE:
            context = mix(level[:-scale] * _SALT + level[scale:])
            choice = level.copy()
            # where these texts begin among all words, to place the runs of smaller periods
            begins = starts[texts]
            mark = np.zeros(len(level) + 1, np.int32)
            for (a, b), q in found.period.items():
                if LEAST_REPEATS * q <= scale <= b - a:
                    k = int(np.searchsorted(begins, a, "right")) - 1
                    if k >= 0 and a < begins[k] + sizes[texts[k]]:
                        here = int(offset[k] + a - begins[k])
                        mark[here] += 1
                        mark[here + b - a - scale + 1] -= 1
            choice[np.cumsum(mark[:-1]) > 0] = _NONE
            at, q = _proposals(choice, context, scale)
            more = _Found()
            _verified(joined, at, q, scale, more)
            for (a, b), p in more.period.items():
                found.add(int(places[a]), int(places[b - 1]) + 1, p)
        level = mix(level[:-scale] * _SALT + level[scale:])
        scale *= 2
    rows = sorted((a, q, b) for (a, b), q in found.period.items() if b - a >= LEAST_WORDS)
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 2], table[:, 1]


def _numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, equal words equal numbers, and the sizes of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for t in texts for w in t]
    return (pd.factorize(flat)[0].astype(np.int64) if len(flat) else np.empty(0, np.int64)), sizes


RESULT = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in text_slices(batch["text"].tolist(), SLICE_CHARACTERS):
            rows = batch.iloc[part]
            texts = [split_words(t) for t in rows["text"]]
            words, sizes = _numbered(texts)
            begin, end, period = find_runs(words, sizes)
            starts = np.cumsum(sizes) - sizes
            owner = np.searchsorted(starts, begin, "right") - 1
            # of several texts with the same start all but the last are empty
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, begin + period, 1)
            np.add.at(mark, end, -1)
            kept = np.cumsum(mark[:-1]) == 0
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            runs, collapsed = [], []
            for i, text in enumerate(texts):
                a, b = int(bounds[i]), int(bounds[i + 1])
                first = int(starts[i])
                runs.append(
                    [
                        {"start": s - first, "length": e - s, "period": q}
                        for s, e, q in zip(begin[a:b].tolist(), end[a:b].tolist(), period[a:b].tolist())
                    ]
                )
                if a < b:
                    text = [w for w, k in zip(text, kept[first : first + len(text)].tolist()) if k]
                collapsed.append(" ".join(text))
            yield pd.DataFrame(
                {"doc_id": known_ids(rows), "n_words": sizes, "runs": runs, "collapsed": collapsed}
            )


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per input row.

    ``runs`` lists (start, length, period) of all longest stretches of words
    ``[^\\x20\\x09-\\x0D]+`` with a smallest period q that are at least
    max(6, 4 q) words long, by start, then period; starts are word numbers from
    0. ``collapsed`` are the words, joined by a blank, without those that some
    run holds after its first q words.

    Nothing is shuffled and nothing is shared between rows: null and repeated
    ids are rows like others, a null or empty text has no words, no runs and an
    empty ``collapsed``, other columns are ignored, an empty table gives an
    empty result. A text is worked on whole, in memory that grows with its words.
    """
    docs = df.select(*id_columns(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return docs.mapInPandas(_rows, RESULT)


def _planted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in text_slices(batch["text"].tolist(), SLICE_CHARACTERS):
            rows = batch.iloc[part].copy()
            texts = []
            for doc_id, missing, text in zip(rows["doc_id"].tolist(), rows["no_id"].tolist(), rows["text"]):
                h = 1 if missing else zlib.crc32(str(doc_id).encode())
                if h % 10 == 0 and (words := split_words(text)):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = " ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))])
                texts.append(text)
            yield pd.DataFrame({"doc_id": known_ids(rows), "text": texts})


def with_planted_runs(df: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic tail in about a tenth of the texts.

    With h = crc32 of the decimal doc_id and g = floor(h / 10), a text of n > 0
    words is changed if h % 10 = 0: from word a = g % n on it repeats its p =
    1 + floor((n - a) / (3 + g % 8)) words from there. A row without id stays
    as it is; a null text becomes empty.
    """
    docs = df.select(*id_columns("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInPandas(_planted, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """Run count, the run of the greatest exponent, and digests, of what ``periodic_runs`` returns."""
    # length / period as an exact fraction: a > b if a.length * b.period > b.length * a.period
    first = F.aggregate(
        "runs",
        F.expr("cast(null as struct<start:long,length:long,period:long>)"),
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n"))))
    return found.withColumn("best", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
