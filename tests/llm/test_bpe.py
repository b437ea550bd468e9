import hashlib

import public_tokenizers
import pytest

from scimetrics.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The cat's hat, isn't it? 123 naïve CAFÉ",
    None,
    "",
    " \t\n ",
    "a\x1cb \x1d c\x85d e　f g",
    "éclair İstanbul ΣΑΣ straße",
    "<|startoftext|>x<|endoftext|> plain<|endoftext|>",
    "word " * 5000,
    "x" * 3000 + " 😀😀 ​﻿",
    "same same",
    "same same",
]


@pytest.mark.parametrize("chunk_characters", [64, 1 << 20])
def test_equals_the_tokenizer(spark, chunk_characters):
    df = spark.createDataFrame(
        [(i, t, 7, b"x") for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk int, ids binary"
    )
    rows = bpe.encode_decode(df, PATH, chunk_characters=chunk_characters).collect()
    tokenizer = bpe.tokenizer(PATH)
    assert len(rows) == len(TEXTS)
    for row in rows:
        whole = tokenizer.encode(TEXTS[row.doc_id] or "", add_special_tokens=False)
        assert row.ids == whole.ids
        assert row.decoded == tokenizer.decode(whole.ids, skip_special_tokens=False)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.decoded) for r in bpe.encode_decode(df, PATH).collect())
    assert got == [(0, "c</w>"), (1, "a</w> b</w>"), (1, "a</w> b</w>")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(df, PATH, result=bpe.DIGESTS).collect() == []


def test_digests_and_join_decoding(spark):
    df = spark.createDataFrame([(0, "To be, or not"), (1, "")], "doc_id long, text string")
    encoded = bpe.encode_decode(df, PATH)
    decoded = bpe.decode(encoded.select("doc_id", "ids"), bpe.piece_table(spark, PATH), "doc_id")
    joined = encoded.join(decoded.withColumnRenamed("decoded", "again"), "doc_id").collect()
    assert all(r.decoded == r.again for r in joined)
    for row in bpe.encode_decode(df, PATH, result=bpe.DIGESTS).collect():
        ids = bpe.tokenizer(PATH).encode("To be, or not" if row.doc_id == 0 else "").ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
