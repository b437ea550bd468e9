"""Token ids of a corpus in compressed, searchable shard files.

Texts are sorted by document over range partitions; each task encodes its texts
and cuts them into shards of bounded size. A file holds one shard, a wavelet
matrix with a table of its documents, and can be read, counted and searched
without its neighbours.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer, pre_tokenizers

from scimetrics.llm.tables import checked, id_columns, known_ids
from scimetrics.llm.wavelet import TokenShard, write_shard
from scimetrics.llm.words import text_slices
from scimetrics.session import materialize, new_path

SHARD_TOKENS = 1 << 21
KNOWN_PIECES = 1_000_000
JOINED_PIECES = 5_000
SLICE_CHARS = 4_000_000
# a byte-level pre-token never goes on over a blank that a visible character follows
_CUT = re.compile(r" (?=\S)")
_OTHER_BLANKS = re.compile(r" (?=\s|\Z)")
# nor from a letter to a mark, nor over a single line feed between visible characters
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"(\n?)([{_LETTERS}]+)([{_MARKS}]*)")
_PLAIN_GROUPS = rf"^(?P<line>\n?)(?P<word>[{_LETTERS}]+)(?P<marks>[{_MARKS}]*)$"
_DIVIDED = re.compile(rf"[{_LETTERS}]+[{_MARKS}]+")


class Pieces(dict):
    """Numbers of known pieces. A missing one is numbered and noted; odd ones are those that the whole tokenizer encodes."""

    def __init__(self, numbers: Iterator[int]) -> None:
        super().__init__()
        self.numbers = numbers
        self.new: list[str] = []
        self.odd: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = next(self.numbers)
        self.new.append(piece)
        return number


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    longer = np.zeros(max(size, 2 * len(array)), array.dtype)
    longer[: len(array)] = array
    return longer


def _strings(values: pa.Array) -> list[str]:
    """``values.to_pylist()``, several times as fast."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _gathered(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` of these beginnings and sizes, one after the other."""
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return values[at]


class Encoder:
    """Ids of whole texts, each distinct stretch between blanks and line feeds going to the tokenizer once.

    Made for byte-level BPE: the cuts lie between two pre-tokens of any text. A
    stretch of letters is one pre-token and goes to the tokenizer's model alone;
    others are encoded as one text, and the ids of each are told apart by the bytes
    that its tokens spell. Added tokens with a spelling that a cut could divide are
    refused.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        split = self.tokenizer.pre_tokenizer
        if not isinstance(split, pre_tokenizers.ByteLevel):
            raise ValueError("a byte-level tokenizer is needed")
        size = self.tokenizer.get_vocab_size()
        spelled = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = np.array([len(s) for s in spelled], np.int64)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            content, bound = token.content, token.lstrip or token.rstrip or token.single_word
            if re.search(r"[\s.,;:!?]", content) or bound or content.isalpha() or _DIVIDED.fullmatch(content):
                raise ValueError(f"the added token {content!r} could be divided")
            self.bytes[i] = len(content.encode())
        # two line feeds are two pre-tokens only before a visible character that is no added token's
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs = ["\n\n\n", "\n\n ", *[f"\n\n{content}" for content in added]]
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.model = self.tokenizer.model
        letters = [c for c in map(chr, range(256)) if re.match(f"[{_LETTERS}]", c)]
        # the spelling of each letter and of a blank in the vocabulary
        self.spelling = {ord(c): split.pre_tokenize_str(c)[0][0] for c in letters}
        self.blank = split.pre_tokenize_str(" ")[0][0]
        self._line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        numbers = count()
        self.after = Pieces(numbers)  # of stretches behind a blank, which is encoded with them, or from one line feed on
        self.first = Pieces(numbers)  # of stretches encoded as they are
        self.ids = np.empty(0, self.kind)
        self.held = 0
        self.begin = np.zeros(1, np.int64)
        self.size = np.zeros(1, np.int64)
        self.first[""] = next(numbers)  # 0, without ids

    def _keep(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        top, end = max(numbers) + 1, self.held + len(ids)
        self.begin, self.size, self.ids = _grown(self.begin, top), _grown(self.size, top), _grown(self.ids, end)
        self.ids[self.held : end] = ids
        self.begin[numbers] = self.held + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.held = end

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of these numbers, one after the other, and how many each has."""
        sizes = self.size[numbers]
        return _gathered(self.ids, self.begin[numbers], sizes), sizes

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, each behind a blank, from encoding them as one text, and how many each has."""
        text = "".join([f" {p}" for p in pieces])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends, wanted = np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) + 1 for p in pieces])
        last = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[np.minimum(last, len(ends) - 1)], wanted):
            raise ValueError("a token reaches over a blank")
        return ids, np.diff(last + 1, prepend=0)

    def _spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens of letters, given as the vocabulary spells them, from the model, and how many each has."""
        ids: list[int] = []
        ends = []
        for word in words:
            ids += [t.id for t in self.model.tokenize(word)]
            ends.append(len(ids))
        return np.array(ids), np.diff(ends, prepend=0)

    def _learn(self) -> None:
        """Ids of the noted pieces: of words from the model, of odd ones from the tokenizer, of others from their parts."""
        after, first = self.after, self.first
        words: list[str] = []
        of_words: list[int] = []
        parts: list[int] = []
        of_parts: list[int] = []
        unsound: list[int] = []
        for known, blank in ((after, self.blank), (first, "")):
            for piece in known.new:  # grows by the words and marks that are met
                if piece.isascii() and piece.isalpha():
                    words.append(blank + piece)  # plain letters spell themselves
                    of_words.append(known[piece])
                elif plain := _PLAIN.fullmatch(piece):
                    line, word, marks = plain.groups()
                    if line or marks:
                        of_parts.append(known[piece])
                        parts += first[line], (first if line else known)[word], first[marks]
                    else:
                        words.append(blank + word.translate(self.spelling))
                        of_words.append(known[piece])
                elif known is first:
                    first.odd.append(piece)
                elif piece != "\n" and (not piece or piece[-1].isspace() or piece.removeprefix("\n")[0].isspace()):
                    unsound.append(after[piece])
                elif piece[0] == "\n":
                    of_parts.append(after[piece])
                    parts += first["\n"], first[piece[1:]], 0
                else:
                    after.odd.append(piece)
            known.new.clear()
        if words:
            self._keep(of_words, *self._spelled(words))
        for i in range(0, len(after.odd), JOINED_PIECES):
            odd = after.odd[i : i + JOINED_PIECES]
            self._keep([after[p] for p in odd], *self._joined(odd))
        for i in range(0, len(first.odd), JOINED_PIECES):
            odd = first.odd[i : i + JOINED_PIECES]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            self._keep([first[p] for p in odd], np.concatenate(coded), np.array(list(map(len, coded))))
        after.odd.clear()
        first.odd.clear()
        if of_parts:
            ids, sizes = self._ids(np.array(parts))
            self._keep(of_parts, ids, sizes.reshape(-1, 3).sum(1))
        if unsound:
            self._keep(unsound, self.ids[:0], np.zeros(len(unsound), np.int64))
            self.size[unsound] = -1

    def _numbers(self, pieces: pa.Array, known: Pieces) -> np.ndarray:
        """Numbers of pieces; each distinct one is looked up once."""
        coded = pieces.dictionary_encode()
        numbers = np.array([known[p] for p in _strings(coded.dictionary)], np.int64)
        return numbers[coded.indices.to_numpy()]

    def _parts(self, pieces: pa.Array) -> np.ndarray:
        """Three numbers for each piece: line feed, word and marks of a plain one; an odd one stands for itself."""
        found = pc.extract_regex(pieces, _PLAIN_GROUPS)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        parts = np.zeros((len(pieces), 3), np.int64)
        line, word, marks = (pc.struct_field(found, name) for name in ("line", "word", "marks"))
        fed = plain & pc.equal(line, "\n").fill_null(False).to_numpy(zero_copy_only=False)
        parts[fed, 0] = self.first["\n"]
        for rows, known in ((fed, self.first), (plain & ~fed, self.after)):
            parts[rows, 1] = self._numbers(word.filter(pa.array(rows)), known)
        parts[plain, 2] = self._numbers(marks.filter(pa.array(plain)), self.first)
        parts[~plain, 1] = [self.after[p] for p in _strings(pieces.filter(pa.array(~plain)))]
        return parts

    def _whole(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts in which every blank and line feed is a cut; None where one turns out to be none.

        Blanks have to stand alone, line feeds alone or, before a visible character, in twos.
        """
        # a line feed in front makes the head a piece like others
        lines = pc.replace_substring(pa.array([f"\n{t}" for t in texts], pa.large_string()), "\n", " \n")
        cut = pc.split_pattern(lines, " ")
        coded = cut.values.dictionary_encode()
        at, ends = coded.indices.to_numpy(), cut.offsets.to_numpy()[1:]
        parts = self._parts(coded.dictionary)
        self._learn()
        unsound = (self.size[parts] < 0).any(1)
        parts[unsound] = 0
        ids, sizes = self._ids(parts.ravel())
        sizes = sizes.reshape(-1, 3).sum(1)
        own = sizes[at]
        packed = _gathered(ids, (np.cumsum(sizes) - sizes)[at], own).tobytes()
        width = np.dtype(self.kind).itemsize
        bounds = (np.concatenate([[0], np.cumsum(own)[ends - 1]]) * width).tolist()
        skip = len(self._line) * width
        done: list[bytes | None] = [packed[a + skip : b] for a, b in zip(bounds[:-1], bounds[1:])]
        # the empty piece before the line feed in front of each text is no sign of another blank
        wrong = unsound[at]
        wrong[cut.offsets.to_numpy()[:-1]] = False
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(wrong), "right")).tolist():
            done[i] = None
        return done

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts."""
        rows = []
        for text in texts:
            head, *tail = _CUT.split(text) if _OTHER_BLANKS.search(text) else text.split(" ")
            rest = [self.first[f" {p}"] if p[-1].isspace() else self.after[p] for p in tail]
            rows.append([self.first[head], *rest])
        self._learn()
        return [self._ids(np.array(row))[0].tobytes() for row in rows]

    def _runs(self, text: str) -> bool:
        return "  " in text or "\r\n" in text or "\n\n" in text and any(run in text for run in self.runs)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as packed numbers of ``kind``."""
        if len(self.after) + len(self.first) > KNOWN_PIECES:
            self._forget()
        done: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not (t[:1].isspace() or t.endswith("\n\n") or self._runs(t))]
        if whole:
            for i, packed in zip(whole, self._whole([texts[i] for i in whole])):
                done[i] = packed
        rest = [i for i, packed in enumerate(done) if packed is None]
        for i, packed in zip(rest, self._cut([texts[i] for i in rest])):
            done[i] = packed
        return done


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once per process, so that tasks share its known pieces."""
    return Encoder(path)


def _shards(batches: Iterator[pd.DataFrame], path: str, end_id: int | None, limit: int) -> Iterator[pd.DataFrame]:
    """The shards of a partition in order; one closes as soon as it holds ``limit`` tokens."""
    code = encoder(path)
    end = b"" if end_id is None else np.array([end_id], code.kind).tobytes()
    part, number = TaskContext.get().partitionId(), 0
    parts: list[bytes] = []
    sizes: list[int] = []
    ids: list[int | None] = []
    held = 0

    def closed() -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(parts), code.kind)
        return pd.DataFrame({"content": [write_shard(tokens, sizes, ids, (part, number))]})

    for batch in batches:
        texts, missing = batch["text"].tolist(), batch["no_id"].tolist()
        own = batch["doc_id"].tolist()
        for rows in text_slices(texts, SLICE_CHARS):
            for at, packed in zip(range(len(texts))[rows], code.encode(texts[rows])):
                packed += end
                parts.append(packed)
                sizes.append(len(packed) // np.dtype(code.kind).itemsize)
                ids.append(None if missing[at] else own[at])
                held += sizes[-1]
                if held >= limit:
                    yield closed()
                    parts, sizes, ids, held, number = [], [], [], 0, number + 1
    if sizes:
        yield closed()


def write_tokens(
    df: DataFrame,
    tokenizer_path: str,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write the ids of all texts to shard files in the folder ``path``, in ascending order of the id.

    Every text is encoded whole, without special tokens, and ends with
    ``end_id`` if that is given. A null text is empty; rows without an id come
    first; rows of one id stand in the order of a hash of their texts, equal
    rows side by side. A text is never cut, so a shard holds up to
    ``shard_tokens`` tokens and one text more. Other columns are ignored.
    """
    docs = df.select(*id_columns(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    # the last key splits rows that agree in all others over several tasks
    docs = docs.withColumns({"mark": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    order = [F.col("no_id").desc(), "doc_id", "mark", "at"]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "no_id", "text")
    made = ordered.mapInPandas(
        partial(_shards, path=tokenizer_path, end_id=end_id, limit=shard_tokens), "content binary"
    )
    content = made.select(F.col("content").cast("string").alias("value"))
    content.write.option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def _loaded(batches: Iterator[pd.DataFrame]) -> Iterator[TokenShard]:
    for batch in batches:
        for content in batch["content"]:
            yield TokenShard(content)


_PLACE = "part long, shard long"
INDEX = f"{_PLACE}, at long, doc_id long, no_id boolean, begin long, n_tokens long, ids_crc32 long"


def _documents(batches: Iterator[pd.DataFrame], schema: str) -> Iterator[pd.DataFrame]:
    for shard in _loaded(batches):
        tokens = shard.tokens().astype("<u4")
        ends = np.cumsum(shard.sizes)
        begin = ends - shard.sizes
        texts = [tokens[a:b] for a, b in zip(begin.tolist(), ends.tolist())]
        frame = pd.DataFrame(
            {
                "part": shard.order[0],
                "shard": shard.order[1],
                "at": np.arange(shard.documents),
                "doc_id": shard.ids,
                "no_id": ~shard.known,
                "begin": begin,
                "n_tokens": shard.sizes,
                "ids_crc32": [zlib.crc32(t.tobytes()) for t in texts],
            }
        )
        if "ids array<long>" in schema:
            frame["ids"] = [t.astype(np.int64) for t in texts]
        yield frame


def _with_start(index: DataFrame) -> DataFrame:
    """``index`` with the number of ids before each document; a partition's shards are numbered.

    The window over all partitions has a row for each task that wrote, not for each document.
    """
    index = materialize(index, "token-index")
    shards = index.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    parts = shards.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    places = shards.join(parts, "part").select("part", "shard", (F.col("inside") + F.col("ahead")).alias("base"))
    places = checked(materialize(places, "token-places"), 24)
    return index.join(places, ["part", "shard"]).withColumn("start", F.col("base") + F.col("begin"))


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, shard) of every document, read back from a folder of shards.

    ``start`` counts the ids of all documents before it. With ``ids`` the column
    ``ids`` holds the decoded ids. An empty folder of an empty table has no rows.
    """
    schema = INDEX + (", ids array<long>" if ids else "")
    found = _files(spark, path).mapInPandas(partial(_documents, schema=schema), schema)
    known = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    rest = ["ids"] if ids else []
    return _with_start(found).select(known, "start", "n_tokens", "ids_crc32", "part", "shard", *rest)


def _counts(batches: Iterator[pd.DataFrame], wanted: list[int]) -> Iterator[pd.DataFrame]:
    total = np.zeros(len(wanted), np.int64)
    for shard in _loaded(batches):
        total += [shard.count(t) for t in wanted]
    yield pd.DataFrame({"token": wanted, "n": total})


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of a list of tokens stands in a folder of shards; none is 0."""
    wanted = sorted(set(tokens))
    found = _files(spark, path).mapInPandas(partial(_counts, wanted=wanted), "token long, n long")
    counts = found.groupBy("token").agg(F.sum("n").alias("n"))
    listed = spark.createDataFrame([(t,) for t in wanted], StructType([StructField("token", LongType())]))
    return listed.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def _places(batches: Iterator[pd.DataFrame], tokens: list[int]) -> Iterator[pd.DataFrame]:
    for shard in _loaded(batches):
        ends = np.cumsum(shard.sizes)
        for token in tokens:
            found = shard.occurrences(token)
            owner = np.searchsorted(ends, found, "right")
            frame = pd.DataFrame(
                {
                    "doc_id": shard.ids[owner],
                    "no_id": ~shard.known[owner],
                    "token": token,
                    "position": found - (ends - shard.sizes)[owner],
                }
            )
            yield frame.assign(doc_id=known_ids(frame)).drop(columns="no_id")


def find_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(doc_id, token, position) of every occurrence of some tokens, positions counted inside the document.

    Only the blocks of the planes on the way to the tokens are opened.
    """
    search = partial(_places, tokens=sorted(set(tokens)))
    return _files(spark, path).mapInPandas(search, "doc_id long, token long, position long")


def token_files(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the shards to the shared work folder and read their documents back.

    One row per row of ``df``, as ``read_documents`` gives them; nulls, ties and
    repeated rows as in ``write_tokens``; an empty table gives an empty result.
    """
    path = new_path(df.sparkSession, "tokens")
    write_tokens(df, tokenizer_path, path, id_col, text_col, end_id, shard_tokens)
    return read_documents(df.sparkSession, path)
