"""Passages repeated across documents, confirmed and measured by FM-indexes per shard.

Routing: every window of words has an anchor, the smallest hashed run of a few
words in it, and equal windows have equal anchors. Only windows whose anchor
occurs in several documents are looked at. Equal windows are grouped by hash,
and the smallest document of each group owns them; claimed segments go to the
shard of their owner. Matching: each shard indexes the owners' segments and
streams the claims through backward search. Only what the index confirms is
reported.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scimetrics.llm.fmindex import FmIndex
from scimetrics.llm.tables import id_columns
from scimetrics.llm.words import mix, powers, read_words, runs, slices, text_slices
from scimetrics.session import materialize

WINDOW, GRAM = 50, 8
SHARD_WORDS, STREAM_WORDS = 200_000, 1000
KEY = ["doc_id", "copy"]


def _anchor_runs(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Runs of consecutive windows with one anchor: where, how many, the anchor, the run's hash."""
    for batch in batches:
        for part in text_slices(batch["text"].tolist()):
            words = read_words(batch["text"].tolist()[part])
            count = len(words.start)
            if count < window:
                continue
            text = np.searchsorted(words.first, np.arange(count), "right") - 1
            grams = runs(words.hashes, GRAM)
            start = np.flatnonzero(text[: count - window + 1] == text[window - 1 :])
            if not len(start):
                continue
            spread = window - GRAM + 1
            views = np.lib.stride_tricks.sliding_window_view(grams, spread)
            least = np.concatenate(
                [views[start[i : i + 20_000]].argmin(axis=1) for i in range(0, len(start), 20_000)]
            )
            anchor = start + least
            fresh = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1) | (np.diff(text[start]) != 0)])
            begin = np.flatnonzero(fresh)
            n = np.diff(np.append(begin, len(start)))
            at = start[begin]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(words.hashes * powers(count), dtype=np.uint64)])
            size = n + window - 1
            key = mix((sums[at + size] - sums[at]) * powers(count, inverse=True)[at] + size.astype(np.uint64))
            rows = batch.iloc[part]
            own = text[at]
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].to_numpy()[own],
                    "copy": rows["copy"].to_numpy()[own],
                    "start": (at - words.first[own]).astype(np.int32),
                    "n": n.astype(np.int32),
                    "anchor": grams[anchor[begin]].view(np.int64),
                    "key": key.view(np.int64),
                }
            )


RUNS = "doc_id long, copy long, start int, n int, anchor long, key long"


def _units(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Keys to compare per document: whole runs, or single windows where runs differ; and the text."""
    for batch in batches:
        for part in text_slices(batch["text"].tolist()):
            rows = batch.iloc[part]
            words = read_words(rows["text"].tolist())
            starts, sizes, keys = [], [], []
            for i, found in enumerate(rows["runs"]):
                windows = runs(words.hashes[words.of(i)], window).view(np.int64)
                start, n, key = [], [], []
                for r in found:
                    if r["mixed"]:
                        at = range(r["start"], r["start"] + r["n"])
                        start += at
                        n += [1] * len(at)
                        key += windows[at.start : at.stop].tolist()
                    else:
                        start.append(r["start"])
                        n.append(r["n"])
                        key.append(r["key"])
                starts.append(start)
                sizes.append(n)
                keys.append(key)
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].array,
                    "copy": rows["copy"].array,
                    "start": starts,
                    "n": sizes,
                    "key": keys,
                    "body": [zlib.compress(t.encode(), 1) for t in rows["text"]],
                }
            )


UNITS = "doc_id long, copy long, start array<int>, n array<int>, key array<long>, body binary"


def _segments(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Claims of a document that go on in the same owner, as segments of bounded length."""
    for batch in batches:
        found = []
        for doc_id, copy, claims in zip(batch["doc_id"].tolist(), batch["copy"].tolist(), batch["claims"]):
            rows: list[list] = []
            for c in claims:
                start, n, owner = c["start"], c["n"], (c["owner"], c["owner_copy"], c["owner_start"] - c["start"])
                last = rows[-1] if rows else None
                if (
                    last
                    and last[2] == owner
                    and start <= last[1]
                    and start + n - last[0] + window - 1 <= STREAM_WORDS
                ):
                    last[1] = max(last[1], start + n)
                else:
                    rows.append([start, start + n, owner])
            found += [(doc_id, copy, a, b - a + window - 1, o[0], o[1], a + o[2]) for a, b, o in rows]
        yield pd.DataFrame(
            found, columns=["doc_id", "copy", "start", "size", "owner", "owner_copy", "owner_start"]
        )


SEGMENTS = "doc_id long, copy long, start int, size int, owner long, owner_copy long, owner_start int"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of requested segments: streams as asked for, references without overlap."""
    for batch in batches:
        rows = []
        for doc_id, copy, body, asked in zip(batch["doc_id"], batch["copy"], batch["body"], batch["asked"]):
            words = zlib.decompress(body).split()
            open_: dict[int, list[int]] = {}
            for a in sorted(asked, key=lambda a: (a["start"], a["size"])):
                shard, start, end = a["shard"], a["start"], a["start"] + a["size"]
                if a["stream"]:
                    rows.append((shard, 1, doc_id, copy, start, b" ".join(words[start:end])))
                elif shard in open_ and start <= open_[shard][1]:
                    open_[shard][1] = max(end, open_[shard][1])
                else:
                    if shard in open_:
                        rows.append((shard, 0, doc_id, copy, open_[shard][0], b" ".join(words[slice(*open_[shard])])))
                    open_[shard] = [start, end]
            for shard, (start, end) in open_.items():
                rows.append((shard, 0, doc_id, copy, start, b" ".join(words[start:end])))
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=["shard", "stream", "doc_id", "copy", "start", "words"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["shard", "stream", "doc_id", "copy", "start", "words"])


CUT = "shard long, stream int, doc_id long, copy long, start int, words binary"


def _matched(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Streams of every shard against its index; rows come sorted by shard, references first."""
    shard, references, index = None, [], None
    for batch in batches:
        for (own, stream), rows in batch.groupby(["shard", "stream"], sort=True):
            if own != shard:
                shard, references, index = own, [], None
            if not stream:
                references += [(d, w.split(b" ")) for d, w in zip(rows["doc_id"].tolist(), rows["words"])]
                continue
            if index is None:
                index, references = FmIndex(references), []
            for part in slices(rows["words"].map(len).tolist()):
                out = []
                asked = rows.iloc[part]
                segments = [(d, w.split(b" ")) for d, w in zip(asked["doc_id"].tolist(), asked["words"])]
                for row, covered in zip(asked.itertuples(index=False), index.matched(segments, window)):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8)))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        out.append((row.doc_id, row.copy, row.start + a, row.start + b))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "copy", "start", "end"])


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, copy, start, end): word intervals made of windows that a smaller doc_id has too.

    ``docs(doc_id, copy, text)``: doc_id not null, ``copy`` tells rows of one
    doc_id apart.
    """
    spark = docs.sparkSession
    found = materialize(docs.mapInPandas(partial(_anchor_runs, window=window), RUNS), "runs")
    shared = found.groupBy("anchor").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("key").alias("a"), F.max("key").alias("b")
    )
    shared = shared.where("lo < hi").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    shared = materialize(shared, "anchors")
    common = materialize(found.join(shared, "anchor").drop("anchor"), "common")
    grouped = common.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n", "key", "mixed")).alias("runs"))
    texts = docs.join(grouped, KEY)
    units = materialize(texts.mapInPandas(partial(_units, window=window), UNITS), "units")

    flat = units.select(*KEY, F.inline(F.arrays_zip("start", "n", "key")))
    owners = flat.groupBy("key").agg(F.min(F.struct("doc_id", "copy", "start")).alias("o"), F.max("doc_id").alias("hi"))
    owners = owners.where("o.doc_id < hi").select(
        "key", F.col("o.doc_id").alias("owner"), F.col("o.copy").alias("owner_copy"), F.col("o.start").alias("owner_start")
    )
    owners = materialize(owners, "owners")
    claims = flat.join(owners, "key").where("owner < doc_id").drop("key")
    claims = claims.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", "n", "owner", "owner_copy", "owner_start"))).alias("claims")
    )
    segments = materialize(claims.mapInPandas(partial(_segments, window=window), SEGMENTS), "segments")

    # a shard's index holds some owners; an owner with many claims has several shards
    load = segments.groupBy("owner", "owner_copy").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    load = load.withColumn("salts", F.ceil(F.col("words") / SHARD_WORDS))
    load = materialize(load.select("owner", "owner_copy", "salts", "words"), "load")
    total = load.agg(F.sum("words")).first()[0] or 0
    shards = F.lit(1 + total // SHARD_WORDS)
    salt = F.pmod(F.xxhash64("doc_id", "copy", "start"), F.col("salts"))
    placed = segments.join(load.drop("words"), ["owner", "owner_copy"])
    shard = F.pmod(F.xxhash64("owner", "owner_copy", salt), shards)
    placed = materialize(placed.withColumn("shard", shard), "placed")
    streams = placed.select(*KEY, F.struct("start", "size", "shard", F.lit(True).alias("stream")).alias("a"))
    references = placed.select(
        F.col("owner").alias("doc_id"), F.col("owner_copy").alias("copy"),
        F.struct(F.col("owner_start").alias("start"), "size", "shard", F.lit(False).alias("stream")).alias("a"),
    ).distinct()
    asked = streams.unionByName(references).groupBy(*KEY).agg(F.collect_list("a").alias("asked"))
    bodies = units.select(*KEY, "body").join(asked, KEY)
    cut = bodies.mapInPandas(_cut, CUT)
    sorted_ = cut.repartition("shard").sortWithinPartitions("shard", "stream")
    return materialize(
        sorted_.mapInPandas(partial(_matched, window=window), "doc_id long, copy long, start int, end int"), "passages"
    )


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch["text"], batch["spans"]):
            words = text.encode().split()
            n, kept = len(words), words
            if spans is not None and len(spans):
                keep = np.ones(n, bool)
                for s in spans:
                    keep[s["start"] : s["end"]] = False
                kept = [words[i] for i in np.flatnonzero(keep).tolist()]
            rows.append((n, n - len(kept), b" ".join(kept).decode()))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
        ids = batch["doc_id"].astype("Int64").mask(batch["no_id"].astype(bool))
        yield out.assign(doc_id=ids.array)


def remove_repeats(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed if it is
    covered by a window of ``window`` words of its document whose words also
    stand in a row with a smaller doc_id; ``kept`` joins the others by one
    space. A null text has no words. A row without doc_id loses nothing and
    takes nothing away; rows that repeat a doc_id do not count against each
    other. Other columns are ignored; an empty table gives an empty result.
    """
    docs = df.select(*id_columns(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    docs = docs.withColumn("copy", F.xxhash64("text"))
    found = repeated_passages(docs.where("not no_id").select("doc_id", "copy", "text"), window)
    spans = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.withColumn("no_id", F.lit(False))
    joined = docs.join(spans, [*KEY, "no_id"], "left").select("doc_id", "no_id", "text", "spans")
    return joined.mapInPandas(_kept, "doc_id long, n_words long, n_removed long, kept string")
