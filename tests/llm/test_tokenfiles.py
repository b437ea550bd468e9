"""Wavelet shards against plain arrays, token files against the tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import AddedToken, Tokenizer

from scimetrics.llm import tokenfiles, wavelet
from scimetrics.llm.queries import BYTE_VOCABULARY, END_ID, op13_tokenfiles
from scimetrics.session import new_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTE_VOCABULARY)


@pytest.mark.parametrize("n, size", [(0, 3), (1, 1), (9, 1), (1000, 7), (200_000, 3000), (70_000, 50_257)])
def test_shard_equals_plain_array(n, size, monkeypatch):
    monkeypatch.setattr(wavelet, "OPEN_BLOCKS", 3)
    rng = np.random.default_rng(n)
    tokens = rng.zipf(1.3, n) % size
    shard = wavelet.TokenShard(wavelet.write_shard(tokens, [n // 2, n - n // 2], [4, None], (2, 5)) + b"\n")
    assert shard.order == (2, 5) and shard.sizes.tolist() == [n // 2, n - n // 2]
    assert shard.ids.tolist()[0] == 4 and shard.known.tolist() == [True, False]
    assert np.array_equal(shard.tokens(), tokens)
    places = rng.integers(0, n, 40) if n else []
    assert np.array_equal(shard.access(places), tokens[places] if n else [])
    low, high = sorted(rng.integers(0, n + 1, 2).tolist())
    for token in [*tokens[:5].tolist(), 99_999]:
        assert shard.count(token) == (tokens == token).sum()
        assert np.array_equal(shard.occurrences(token), np.flatnonzero(tokens == token))
        assert shard.count(token, low, high) == (tokens[low:high] == token).sum()
        assert np.array_equal(shard.occurrences(token, low, high), low + np.flatnonzero(tokens[low:high] == token))
    with pytest.raises(IndexError):
        shard.access([n])


def test_shard_is_smaller_than_its_tokens_and_searched_in_part():
    tokens = np.random.default_rng(1).zipf(1.4, 500_000) % 20_000
    data = wavelet.write_shard(tokens, [500_000], [1])
    assert len(data) < 2 * 500_000
    shard = wavelet.TokenShard(data)
    shard.access([123_456])
    assert len(shard._open) == shard.levels


def test_no_foreign_bytes():
    with pytest.raises(ValueError):
        wavelet.TokenShard(b"something else" * 20)


def test_pieces_equal_whole_texts(tokenizer):
    random.seed(7)
    bits = [" ", "  ", "\n", "\t", "a", "the", "é", "don't", "'s", "1", "23", ".", "!?", "<|endoftext|>", "<|end"]
    bits += ["\x1c", "\x85", "\xa0", " ", "中文", "😀", "​", "　", "Ġ", "\r\n", "é"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(3000)]
    code = tokenfiles.Encoder(BYTE_VOCABULARY)
    for text, packed in zip(texts, code.encode(texts)):
        assert np.frombuffer(packed, code.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_forgotten_pieces(monkeypatch, tokenizer):
    monkeypatch.setattr(tokenfiles, "KNOWN_PIECES", 2)
    monkeypatch.setattr(tokenfiles, "JOINED_PIECES", 2)
    code = tokenfiles.Encoder(BYTE_VOCABULARY)
    for texts in (["a b c d", "x"], ["a b", " b a", ""], ["c d a"]):
        for text, packed in zip(texts, code.encode(texts)):
            assert np.frombuffer(packed, code.kind).tolist() == tokenizer.encode(text).ids


def test_odd_pieces_are_learned_together(tokenizer, monkeypatch):
    code, asked = tokenfiles.Encoder(BYTE_VOCABULARY), []
    joined = code._joined
    monkeypatch.setattr(code, "_joined", lambda pieces: asked.append(pieces) or joined(pieces))
    texts = ["plain words, only", "x1 y2 plain", "a x1 b", "3d words y2", "x1 don't"]
    for _ in range(2):
        for text, packed in zip(texts, code.encode(texts)):
            assert np.frombuffer(packed, code.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert [sorted(pieces) for pieces in asked] == [["don't", "x1", "y2"]]
    assert not code.after.odd and not code.first.odd


def test_known_pieces_grow_with_words_not_with_their_marks_and_lines(tokenizer, monkeypatch):
    words, marks = ["river", "Été", "niño", "q", "Stone"], ["", ".", "),", "...", "$$$", '"']
    texts = [f"{v}{m}\n{w}{n} {w}{m}" for v in words for w in words for m in marks for n in marks]
    code, asked = tokenfiles.Encoder(BYTE_VOCABULARY), []
    spelled, joined = code._spelled, code._joined
    monkeypatch.setattr(code, "_spelled", lambda pieces: asked.extend(pieces) or spelled(pieces))
    monkeypatch.setattr(code, "_joined", lambda pieces: asked.extend(pieces) or joined(pieces))
    for text, packed in zip(texts, code.encode(texts)):
        assert np.frombuffer(packed, code.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) == 2 * len(words)
    # an unsound empty piece and the line feed, once more as a piece of its own, come on top
    assert len(code.after) + len(code.first) <= 2 * len(words) + len(marks) + 3


def test_runs_of_white_space_between_known_pieces(tokenizer):
    code = tokenfiles.Encoder(BYTE_VOCABULARY)
    gaps = [" ", "\n", "  ", "\n\n", " \n", "\n ", "\t", " \t", "\n\t", "\t\n", "\n\n\n", "\xa0", " \xa0", "\x1c\n", "\r\n", "\n\n<|endoftext|>", ""]
    texts = [f"{a}one{b}two{c}" for a in gaps for b in gaps for c in gaps]
    texts += [f"one{a}{b}{c}two" for a in gaps for b in gaps for c in gaps]
    for _ in range(2):
        for text, packed in zip(texts, code.encode(texts)):
            assert np.frombuffer(packed, code.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokenfiles.Encoder(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("added", [AddedToken("a#"), AddedToken("##", single_word=True), AddedToken("x y")])
def test_added_tokens_that_a_cut_could_divide_are_refused(added, tmp_path):
    other = Tokenizer.from_file(BYTE_VOCABULARY)
    other.add_tokens([added])
    other.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        tokenfiles.Encoder(str(tmp_path / "other.json"))


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_equals_tokenizer(spark, tokenizer):
    docs = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    want, start = [], 0
    for row in docs:
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, END_ID]
        want.append((row["doc_id"], start, len(ids), digest(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in op13_tokenfiles(spark, FOLDER).collect()) == want


ROWS = [
    (5, "one two", "x"),
    (-3, None, "x"),
    (None, "no id", "x"),
    (5, "one two", "x"),
    (5, "another", None),
    (2, "", "x"),
    (9, "long " * 3000, "x"),
    (None, "no id either", "x"),
]


def test_order_shards_and_searches(spark, tokenizer):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, start string").repartition(3)
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(df, BYTE_VOCABULARY, path, end_id=END_ID, shard_tokens=4)
    got = tokenfiles.read_documents(spark, path, ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -3, 2, 5, 5, 5, 9]
    at = 0
    for row in got:
        assert row["start"] == at and row["n_tokens"] == len(row["ids"]) and row["ids"][-1] == END_ID
        assert row["ids_crc32"] == digest(row["ids"])
        at += row["n_tokens"]
    texts = sorted(tokenizer.decode(r["ids"][:-1]) for r in got)
    assert texts == sorted(t or "" for _, t, _ in ROWS)
    assert len({(r["part"], r["shard"]) for r in got}) > 3
    word = tokenizer.encode(" two").ids[0]
    counts = {r["token"]: r["n"] for r in tokenfiles.count_tokens(spark, path, [word, END_ID, 50_000]).collect()}
    assert counts == {word: 2, END_ID: 8, 50_000: 0}
    places = sorted(tuple(r) for r in tokenfiles.find_tokens(spark, path, [word]).collect())
    assert places == [(5, word, 1), (5, word, 1)]
    ends = {(r["doc_id"], r["position"]) for r in tokenfiles.find_tokens(spark, path, [END_ID]).collect()}
    assert ends == {(r["doc_id"], r["n_tokens"] - 1) for r in got}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.token_files(df, BYTE_VOCABULARY).collect() == []


def test_without_end_and_one_giant_text(spark, tokenizer):
    text = "".join(f"word{i % 977} " for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = tokenfiles.token_files(df, BYTE_VOCABULARY, shard_tokens=1000).orderBy("doc_id").collect()
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert [tuple(r)[:4] for r in got] == [(1, 0, len(ids), digest(ids)), (2, len(ids), 0, 0)]
