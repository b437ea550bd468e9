"""BPE encoding and decoding through a table of distinct words.

Documents are packed into compressed chunks of a few MB. Each chunk sends its
distinct words to buckets, where every distinct word of the corpus is encoded
once; the ids travel back to the chunk and are joined to the text by word
position. Decoding joins the ids with the table of pieces, whose size the
vocabulary bounds. Distinct words and ids are exchanged packed as well.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scimetrics.llm.tables import id_columns, known_ids
from scimetrics.llm.words import text_slices

CHUNK_CHARACTERS = 8_000_000
# str.split() also cuts at these, which no tokenizer counts as white space
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[ \t-\r]+")

CHUNK = "chunk long, ids binary, missing binary, sizes binary, body binary"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, once per process."""
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def split_words(text: str) -> list[str]:
    """Pieces of the text between white space; no token crosses these borders."""
    if _SEPARATORS.search(text):
        return [w for w in _BLANKS.split(text) if w]
    return text.split()


def _chunks(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Packed consecutive rows; equal content gets an equal chunk number in every attempt."""
    for batch in batches:
        for part in text_slices(batch["text"].tolist(), limit):
            rows = batch.iloc[part]
            ids = rows["doc_id"].to_numpy(np.int64).tobytes()
            missing = rows["no_id"].to_numpy(bool).tobytes()
            sizes = rows["text"].str.len().to_numpy(np.int64).tobytes()
            body = zlib.compress("".join(rows["text"]).encode(), 1)
            number = blake2b(ids + sizes + body, digest_size=8).digest()
            yield pd.DataFrame(
                {
                    "chunk": [int.from_bytes(number, "little", signed=True)],
                    "ids": [ids],
                    "missing": [missing],
                    "sizes": [sizes],
                    "body": [body],
                }
            )


def _texts(sizes: bytes, body: bytes) -> Iterator[str]:
    text, at = zlib.decompress(body).decode(), 0
    for size in np.frombuffer(sizes, np.int64).tolist():
        yield text[at : at + size]
        at += size


def _distinct(sizes: bytes, body: bytes, buckets: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a chunk ordered by bucket; the buckets; where each begins.

    Words of a bucket stand in the order of their first occurrence, so both
    readers of a chunk get the same lists.
    """
    seen: dict[str, None] = {}
    for text in _texts(sizes, body):
        seen.update(dict.fromkeys(split_words(text)))
    words = list(seen)
    if not words:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    bucket = pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order].astype(np.int64)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [words[i] for i in order.tolist()], bucket[begin], begin


def _vocabularies(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for chunk, sizes, body in zip(batch["chunk"], batch["sizes"], batch["body"]):
            words, own, begin = _distinct(sizes, body, buckets)
            ends = np.append(begin[1:], len(words))
            lists = [
                zlib.compress("\n".join(words[a:b]).encode(), 1) for a, b in zip(begin.tolist(), ends.tolist())
            ]
            if lists:
                yield pd.DataFrame({"chunk": chunk, "bucket": own, "words": lists})


def _encoded(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    known: dict[str, str] = {}
    for batch in batches:
        packed = []
        for words in batch["words"]:
            words = zlib.decompress(words).decode().split("\n")
            fresh = [w for w in words if w not in known]
            for at in range(0, len(fresh), 2000):
                part = fresh[at : at + 2000]
                codes = tokenizer(path).encode_batch_fast(part, add_special_tokens=False)
                known.update((w, " ".join(map(str, c.ids))) for w, c in zip(part, codes))
            packed.append(zlib.compress("\n".join([known[w] for w in words]).encode(), 1))
        yield pd.DataFrame({"chunk": batch["chunk"], "bucket": batch["bucket"], "coded": packed})


def _joined(chunks: pd.DataFrame, replies: pd.DataFrame, buckets: int, pieces) -> Iterator[tuple]:
    """(id, id is missing, ids as text, decoded text) of every document of equal chunks."""
    table = pieces.value
    coded = dict(zip(replies["bucket"].tolist(), replies["coded"]))
    ids_of: dict[str, str] = {}
    for row in chunks.itertuples(index=False):
        if not ids_of:
            words, own, begin = _distinct(row.sizes, row.body, buckets)
            lines: list[str] = []
            for b in own.tolist():
                lines += zlib.decompress(coded[b]).decode().split("\n")
            ids_of = dict(zip(words, lines))
            spelled = {w: " ".join([table[i] for i in x.split()]) for w, x in ids_of.items()}
            blank = "" in lines
        ids, missing = np.frombuffer(row.ids, np.int64), np.frombuffer(row.missing, bool)
        for doc_id, no_id, text in zip(ids.tolist(), missing.tolist(), _texts(row.sizes, row.body)):
            words = split_words(text)
            if blank:
                words = [w for w in words if ids_of[w]]
            yield doc_id, no_id, " ".join([ids_of[w] for w in words]), " ".join([spelled[w] for w in words])


def _arrays(rows: Iterator[tuple]) -> pd.DataFrame:
    ids, missing, coded, decoded = ([*c] for c in zip(*rows))
    frame = pd.DataFrame({"doc_id": ids, "no_id": missing})
    return pd.DataFrame(
        {
            "doc_id": known_ids(frame),
            "ids": [np.array(c.split(), np.int32) for c in coded],
            "decoded": decoded,
        }
    )


def _digests(rows: Iterator[tuple]) -> pd.DataFrame:
    found = [
        (i, m, c.count(" ") + 1 if c else 0, sha256(c.encode()).hexdigest(), sha256(d.encode()).hexdigest())
        for i, m, c, d in rows
    ]
    frame = pd.DataFrame(found, columns=["doc_id", "no_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return frame.assign(doc_id=known_ids(frame)).drop(columns="no_id")


ARRAYS = (_arrays, "doc_id long, ids array<int>, decoded string")
#: Reduces the ids and the text of each document to digests as soon as they are there.
DIGESTS = (_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_decode(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    result: tuple[Callable[[Iterator[tuple]], pd.DataFrame], str] = ARRAYS,
    chunk_characters: int = CHUNK_CHARACTERS,
) -> DataFrame:
    """(doc_id, ids, decoded), one row per input row, or what ``result`` makes of them.

    ``path`` is a vocabulary file of a tokenizer that splits at white space, has
    no decoder of its own and adds nothing at the ends; every executor must be
    able to read it. ``ids`` are those of encoding the whole text without special
    tokens, ``decoded`` is the text decoded from them with all tokens.

    A null or empty text has no ids and decodes to the empty text. Null and
    repeated doc_ids are rows like others; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(*id_columns(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.mapInPandas(partial(_chunks, limit=chunk_characters), CHUNK).repartition("chunk")
    # both readers of the chunks take all columns, so that they share one shuffle
    words = packed.mapInPandas(
        partial(_vocabularies, buckets=buckets), "chunk long, bucket long, words binary"
    )
    replies = words.repartition("bucket").mapInPandas(
        partial(_encoded, path=path), "chunk long, bucket long, coded binary"
    )
    read = tokenizer(path)
    spellings = {str(i): read.id_to_token(i) for i in range(read.get_vocab_size())}
    pieces = spark.sparkContext.broadcast(spellings)
    finish, schema = result

    def joined(chunks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        return finish(_joined(chunks, replies, buckets, pieces))

    return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(joined, schema)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a vocabulary file."""
    read = tokenizer(path)
    rows = [(i, read.id_to_token(i)) for i in range(read.get_vocab_size())]
    return spark.createDataFrame(rows, "id int, piece string")


def decode(df: DataFrame, pieces: DataFrame, key: str, ids_col: str = "ids") -> DataFrame:
    """(key, decoded) of a table with a unique ``key`` and an array of ids.

    The ids are exploded with their positions and joined with ``pieces(id,
    piece)``, which a vocabulary bounds and which is therefore broadcast. Null
    or empty arrays and unknown ids give no piece.
    """
    ids = df.select(key, F.posexplode_outer(ids_col).alias("position", "id"))
    spelled = ids.join(F.broadcast(pieces), "id", "left")
    placed = F.when(F.col("piece").isNotNull(), F.struct("position", "piece"))
    ordered = F.transform(F.array_sort(F.collect_list(placed)), lambda p: p["piece"])
    return spelled.groupBy(key).agg(F.array_join(ordered, " ").alias("decoded"))
