"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds to them.

The CRF labels the words of every line. It is trained on a small table of lines
of a bounded sample of documents, whose words carry the labels of the fixed
patterns, so it learns how such data looks and finds forms the patterns miss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scimetrics.llm.tables import id_columns, known_ids
from scimetrics.llm.words import CODES, SPACE, Words, mix, powers, read_words, text_slices
from scimetrics.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds of one word; neighbouring words of the others form one span.
SINGLE = (0, 1)
TRAIN_DOCUMENTS, TRAIN_LINES = 4000, 1500
SLOTS, FIELDS, STATES = 1 << 13, 6, len(KINDS) + 1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[Span]:
    """From every @ the local part is read backwards, so long words cost no retries."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield 0, start, free
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[Span]:
    """The first four numbers of a dotted run match, then the next four."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = start + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in own):
                yield 1, start, end
            start = end + 1


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    found = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += _addresses(text)
    for run in _CARD.finditer(text):
        digits = "".join(c for c in run.group() if c not in " -")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *run.span()))
    if "+" in text:
        for run in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(run.group())) <= 15:
                found.append((3, *run.span()))
    return found


_SHAPE = np.full(256, ord("a"), np.uint8)
_SHAPE[:128] = np.arange(128)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123] = ord("9"), ord("A"), ord("a")
_FOLDED = np.isin(np.arange(256), [ord("9"), ord("A"), ord("a")])


def _hashes(codes: np.ndarray, words: Words, word: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Hash of the kept bytes of every word; ``word`` is the word at or before each byte."""
    count = np.concatenate([[0], np.cumsum(keep)])
    place = np.where(keep, count[:-1] - count[words.start[word]], 0)
    values = np.where(keep, CODES[codes] * powers(int(place.max()) + 1)[place], np.uint64(0))
    sizes = count[words.end] - count[words.start]
    return mix(np.add.reduceat(values, words.start) + sizes.astype(np.uint64))


def shape_features(words: Words) -> np.ndarray:
    """(words, FIELDS) slots: shape, folded shape, and the folded shapes around.

    A shape maps letters to A or a and digits to 9; a folded shape writes runs
    of them once. Neighbours are those of the same line, so that the slots of a
    word follow from its line alone, whatever else is in the batch.
    """
    n = len(words.start)
    slots = np.zeros((n, FIELDS), np.int64)
    if not n:
        return slots
    raw = np.frombuffer(words.data, np.uint8)
    codes = _SHAPE[raw]
    first = np.zeros(len(codes), bool)
    first[words.start] = True
    word = np.maximum(np.cumsum(first) - 1, 0)
    inside = ~SPACE[raw]
    repeated = np.concatenate([[False], codes[1:] == codes[:-1]]) & _FOLDED[codes] & ~first
    full = _hashes(codes, words, word, inside)
    folded = _hashes(codes, words, word, inside & ~repeated)
    length = np.minimum(words.end - words.start, 24).astype(np.uint64)
    before = np.concatenate([[np.uint64(0)], folded[:-1]])
    after = np.concatenate([folded[1:], [np.uint64(0)]])
    cuts = lines(words)
    before[cuts[:-1]] = 0
    after[cuts[1:] - 1] = 0
    fields = (full, folded, before, after, mix(folded + length), mix(before ^ mix(after)))
    for k, values in enumerate(fields):
        slots[:, k] = (values % np.uint64(SLOTS)).astype(np.int64) + k * SLOTS
    return slots


def lines(words: Words) -> np.ndarray:
    """Index of the first word of every line, and the number of words."""
    raw = np.frombuffer(words.data, np.uint8)
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    if not len(words.start):
        return np.zeros(1, np.int64)
    own = breaks[words.start]
    return np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])


@dataclass
class Crf:
    """Weights of a linear-chain CRF: emissions by slot, transitions, starts."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, slots: np.ndarray) -> np.ndarray:
        total = np.zeros((len(slots), STATES), np.float32)
        for k in range(FIELDS):
            total += self.emit[slots[:, k]]
        return total

    def decode(self, slots: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Best state of every word (Viterbi), all lines of a batch in step."""
        scores, best = self.scores(slots), np.zeros(len(slots), np.int8)
        size = np.diff(cuts)
        order = np.argsort(-size, kind="stable")
        begin, size = cuts[:-1][order], size[order]
        back = np.zeros((len(slots), STATES), np.int8)
        active = int((size > 0).sum())
        now = scores[begin[:active]] + self.start
        last = np.zeros((len(begin), STATES), np.float32)
        last[:active] = now
        for t in range(1, int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size, -t, "left"))
            paths = last[:active, :, None] + self.move
            came = paths.argmax(axis=1)
            at = begin[:active] + t
            back[at] = came
            last[:active] = np.take_along_axis(paths, came[:, None, :], 1)[:, 0] + scores[at]
        state = last.argmax(axis=1)
        for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            active = int(np.searchsorted(-size, -t, "left"))
            at = begin[:active] + t
            best[at] = state[:active]
            state[:active] = back[at, state[:active]]
        return best


def fit_crf(slots: list[np.ndarray], states: list[np.ndarray], rounds: int = 120) -> Crf:
    """Maximum likelihood by Adam over all lines at once, with an L2 penalty."""
    crf = Crf(np.zeros((FIELDS * SLOTS, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES))
    if not slots:
        crf.start[0] = crf.move[:, 0] = 1.0
        crf.emit = crf.emit.astype(np.float32)
        return crf
    size = np.array([len(s) for s in slots])
    n, longest = len(slots), int(size.max())
    flat, gold = np.concatenate(slots), np.concatenate(states)
    row, column = np.repeat(np.arange(n), size), np.concatenate([np.arange(s) for s in size])
    used, place = np.unique(flat, return_inverse=True)
    place = place.reshape(flat.shape)
    weights = [np.zeros((len(used), STATES)), crf.move, crf.start]
    memory = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    truth = np.eye(STATES)[gold]
    moved = np.zeros((STATES, STATES))
    inner = column[1:] > 0
    np.add.at(moved, (gold[:-1][inner], gold[1:][inner]), 1)
    mask = np.zeros((n, longest), bool)
    mask[row, column] = True
    for step in range(1, rounds + 1):
        emit, move, start = weights
        score = np.zeros((n, longest, STATES))
        score[row, column] = emit[place].sum(axis=1)
        forward = np.zeros_like(score)
        forward[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            paths = forward[:, t - 1, :, None] + move
            top = paths.max(axis=1)
            new = top + np.log(np.exp(paths - top[:, None]).sum(axis=1)) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        end = forward[:, -1]
        top = end.max(axis=1, keepdims=True)
        total = (top + np.log(np.exp(end - top).sum(axis=1, keepdims=True)))[:, :, None]
        backward = np.zeros_like(score)
        expected = np.zeros((STATES, STATES))
        for t in range(longest - 2, -1, -1):
            paths = move + (score[:, t + 1] + backward[:, t + 1])[:, None, :]
            on = mask[:, t + 1, None]
            both = np.exp(forward[:, t, :, None] + paths - total) * on[:, :, None]
            expected += both.sum(axis=0)
            top = paths.max(axis=2)
            new = top + np.log(np.exp(paths - top[:, :, None]).sum(axis=2))
            backward[:, t] = np.where(on, new, 0.0)
        likely = np.exp(forward + backward - total)[row, column]
        off = likely - truth
        slope = np.zeros_like(emit)
        for k in range(FIELDS):
            for s in range(STATES):
                slope[:, s] += np.bincount(place[:, k], weights=off[:, s], minlength=len(used))
        slopes = [slope, expected - moved, off[column == 0].sum(axis=0)]
        for w, g, (m, v) in zip(weights, slopes, memory):
            g = g / n + 2e-5 * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    crf.emit[used] = weights[0]
    crf.emit = crf.emit.astype(np.float32)
    return crf


def _code_points(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in code points of the batch."""
    raw = np.frombuffer(words.data, np.uint8)
    seen = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return seen[words.start], seen[words.end]


def _offsets(texts: list[str]) -> np.ndarray:
    """Code points before each text in a batch, one separator after each."""
    return np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def _labels(spans: list[Span], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """State of every word: 1 + kind of the first span it overlaps, else 0."""
    state = np.zeros(len(start), np.int64)
    for kind, a, b in reversed(spans):
        state[np.searchsorted(end, a, "right") : np.searchsorted(start, b, "left")] = kind + 1
    return state


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in text_slices(batch["text"].tolist()):
            texts = batch["text"].tolist()[part]
            words = read_words(texts)
            slots, cuts = shape_features(words), lines(words)
            start, end = _code_points(words)
            before = _offsets(texts)
            state = np.zeros(len(start), np.int64)
            for i, text in enumerate(texts):
                own = words.of(i)
                state[own] = _labels(base_spans(text), start[own] - before[i], end[own] - before[i])
            rows = [
                (int(state[a:b].any()), slots[a:b].ravel(), state[a:b])
                for a, b in zip(cuts[:-1], cuts[1:])
                if 0 < b - a <= 200
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["positive", "slots", "states"])


def train(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    documents: int = TRAIN_DOCUMENTS,
    per_class: int = TRAIN_LINES,
) -> Crf:
    """Fit the CRF on lines of the ``documents`` documents with the smallest hashed doc_id.

    Of their lines of up to 200 words, ``per_class`` with and as many without
    personal data are used. Rows without doc_id are not; without any line the
    CRF labels nothing.
    """
    ids = df.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    ids = ids.withColumn("order", F.xxhash64("doc_id", F.lit(10))).orderBy("order").limit(documents)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(ids), "doc_id").select("text")
    found = materialize(
        texts.mapInPandas(_examples, "positive int, slots array<long>, states array<long>"), "lines"
    )
    key = F.xxhash64("slots")
    parts = [found.where(f"positive = {p}").orderBy(key, "states").limit(per_class) for p in (1, 0)]
    table = parts[0].unionByName(parts[1]).toPandas()
    return fit_crf(
        [np.asarray(s, np.int64).reshape(-1, FIELDS) for s in table["slots"]],
        [np.asarray(s, np.int64) for s in table["states"]],
    )


def crf_spans(states: np.ndarray, start: np.ndarray, end: np.ndarray, cut: np.ndarray) -> list[Span]:
    """Spans of a text's labelled words; ``cut`` marks the words that begin a line."""
    found: list[Span] = []
    previous = -1
    for i in np.flatnonzero(states).tolist():
        kind = int(states[i]) - 1
        if found and previous == i - 1 and found[-1][0] == kind and kind not in SINGLE and not cut[i]:
            found[-1] = (kind, found[-1][1], int(end[i]))
        else:
            found.append((kind, int(start[i]), int(end[i])))
        previous = i
    return found


def _found(batches: Iterator[pd.DataFrame], model) -> Iterator[pd.DataFrame]:
    crf = model.value
    for batch in batches:
        for part in text_slices(batch["text"].tolist(), 1_000_000):
            texts = batch["text"].tolist()[part]
            words = read_words(texts)
            cuts = lines(words)
            states = crf.decode(shape_features(words), cuts)
            begins = np.zeros(len(states) + 1, bool)
            begins[cuts] = True
            start, end = _code_points(words)
            before = _offsets(texts)
            rows = []
            for i, text in enumerate(texts):
                base, own = base_spans(text), words.of(i)
                more = crf_spans(states[own], start[own] - before[i], end[own] - before[i], begins[own])
                # words around a known span are its punctuation
                more = [s for s in more if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                rows.append(tuple(list(c) for c in zip(*spans)) if spans else ([], [], [], []))
            out = pd.DataFrame(rows, columns=["kind", "start", "end", "base"])
            yield out.assign(doc_id=known_ids(batch.iloc[part]).array)[["doc_id", "kind", "start", "end", "base"]]


def find_personal_data(df: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): array of (kind, start, end, base), by kind as listed, then start.

    One row per input row, offsets in code points, ends exclusive. ``base`` is
    true for spans of the fixed patterns; the CRF's spans that overlap none of
    them follow with false. A null text is empty; null and repeated doc_ids are
    rows like others; other columns are ignored; an empty table gives an empty
    result.
    """
    model = df.sparkSession.sparkContext.broadcast(crf)
    docs = df.select(*id_columns(id_col), F.coalesce(text_col, F.lit("")).alias("text"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _found(batches, model)

    schema = "doc_id long, kind array<int>, start array<int>, end array<int>, base array<boolean>"
    names = F.array(*[F.lit(k) for k in KINDS])
    return docs.mapInPandas(found, schema).select(
        "doc_id",
        F.transform(
            F.arrays_zip("kind", "start", "end", "base"),
            lambda s: F.struct(
                names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")
            ),
        ).alias("found"),
    )


def _joined(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of ``find_personal_data``'s rows."""
    base = F.filter("found", lambda s: s["base"])
    counts = [_count(base, k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )
