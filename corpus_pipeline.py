"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the docs of the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scimetrics.llm import bpe, decontaminate, minhash, secrets, toxicity
from scimetrics.llm.tables import checked
from scimetrics.session import materialize

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``; rows without one stay."""
    gone = checked(materialize(ids.distinct(), name), 24)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier chain finds toxic."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return toxicity.score(whole, chain).where("not toxicity.toxic").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group; five-word shingles, 0.8."""
    found = minhash.near_duplicates(docs, size=5, percent=80)
    return _without(docs, found.where("not kept").select("doc_id"), "copies")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contaminated(docs, benchmark).select("doc_id"), "leaks")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret; n_chars follows the text. All documents stay."""
    found = secrets.find_secrets(docs, carry=tuple(docs.columns))
    text = secrets.redacted(found)
    new = {"text": F.when(F.col("row.text").isNotNull(), text)}
    if "n_chars" in docs.columns:
        changed = F.size("found") > 0
        new["n_chars"] = F.when(changed, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every kept document."""
    return bpe.encode_decode(docs, VOCABULARY, result=bpe.DIGESTS)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", encoded),
]

# several stages are trained or iterate, which SQL cannot state
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
