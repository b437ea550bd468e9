"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scimetrics.llm import (
    bpe,
    decontaminate,
    minhash,
    periods,
    pii,
    projections,
    repeats,
    secrets,
    templates,
    tokenfiles,
    toxicity,
    warc,
    whitening,
)
from scimetrics.llm.statements import STATEMENTS as STATEMENTS

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archive(_table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    chain = toxicity.train(docs, _table(spark, folder, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", "toxicity.*", (~F.col("toxicity.toxic")).alias("kept"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, folder, "documents"), VOCABULARY, result=bpe.DIGESTS)


def op4_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.extract(_table(spark, folder, "pages"))


def op5_projections(spark: SparkSession, folder: str) -> DataFrame:
    return projections.near_vectors(_table(spark, folder, "embeddings"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), size=2)


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(_table(spark, folder, "documents")))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return pii.digests(pii.find_personal_data(docs, pii.train(docs)))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.component_rows(whitening.whiten(_table(spark, folder, "embeddings")))


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    docs = periods.with_planted_runs(_table(spark, folder, "documents"))
    return periods.digests(periods.periodic_runs(docs))


def op13_tokenfiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = tokenfiles.token_files(docs, BYTE_VOCABULARY, end_id=END_ID)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_templates": op4_templates,
    "op5_projections": op5_projections,
    "op6_minhash": op6_minhash,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_repeats": op9_repeats,
    "op10_pii": op10_pii,
    "op11_whitening": op11_whitening,
    "op12_periods": op12_periods,
    "op13_tokenfiles": op13_tokenfiles,
    "pipeline": corpus_pipeline.run,
}
