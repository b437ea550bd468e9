"""Inputs: the flat frame, side tables, directories of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scimetrics.functions.names import clean_names, safe_label
from scimetrics.functions.wordlists import STOPWORDS
from scimetrics.operators.dedupe import ORDER

ID_COLUMNS = ("paper_id", "author_id", "affiliation_id", "field_id", "journal_id")

NOUN_SCHEMA = "paper_id long, lemma string, n int"
MAIN_AFFILIATION_SCHEMA = "AuthorID string, AffiliationID string"
GENDER_SCHEMA = "AuthorID string, `P(gf)` double"
MAIN_FIELD_SCHEMA = (
    "AuthorID string, field_predominant_all string, type_predominant_all string"
)


def as_raw(df: DataFrame) -> DataFrame:
    """Snake-case names and long ids, both fixed once at ingest.

    ``_seq`` is the row order that keep-first and pair operators use. It may be
    of any sortable type, also a struct, and must differ between rows.
    """
    df = clean_names(df)
    ids = {c: F.col(c).try_cast("long") for c in ID_COLUMNS if c in df.columns}
    return df.withColumns(ids)


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The flat frame from Parquet; without ``_seq`` the file position is the order.

    File path and row index are known per file, so no global numbering pass
    over the rows is needed.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    if ORDER not in df.columns:
        position = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        df = df.select("*", position.alias(ORDER))
    return as_raw(df)


def read_tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Named columns of a headed TSV; others are ignored and ``NA`` is missing.

    ``_seq`` is the row order: the file, the block of it that a task read, and
    the running number in that task.
    """
    wanted = T.StructType.fromDDL(columns)
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False, nullValue="NA")
    position = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(
        *[F.nullif(F.col(f"`{f.name}`"), F.lit("")).try_cast(f.dataType).alias(f.name) for f in wanted],
        position.alias(ORDER),
    )


def _noun_rows(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(f"{NOUN_SCHEMA}, _rejected string")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_rejected")
        # else a reader of few columns would not see what is wrong in the others
        .option("columnPruning", False)
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
        .csv(path)
    )


def read_nouns(spark: SparkSession, path: str) -> DataFrame:
    """Externally tagged nouns from a folder of CSV files; unreadable files are skipped.

    Rows that do not fit the schema are in ``rejected_nouns`` instead.
    """
    return _noun_rows(spark, path).where(F.col("_rejected").isNull()).drop("_rejected")


def rejected_nouns(spark: SparkSession, path: str) -> DataFrame:
    """(file, rejected, with_id, first): rows per file that ``read_nouns`` leaves out.

    ``with_id`` of them have a readable paper_id, ``first`` is one of them.
    """
    rows = _noun_rows(spark, path).select("*", F.col("_metadata.file_path").alias("file"))
    return (
        rows.where(F.col("_rejected").isNotNull())
        .groupBy("file")
        .agg(
            F.count("*").alias("rejected"),
            F.count("paper_id").alias("with_id"),
            F.min("_rejected").alias("first"),
        )
    )


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length): files that ``read_nouns`` skips as a whole, because no line of them can be read.

    Empty files are no skipped files. A file that breaks off later keeps the
    rows before that point and is not listed.
    """
    name = F.col("_metadata.file_path").alias("file")
    listed = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select(name, "length")
    lenient = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return listed.join(lenient.text(path).select(name).distinct(), "file", "left_anti")


def read_labelled(spark: SparkSession, path: str, suffix: str, label: str) -> DataFrame:
    """A folder of Parquet files as one table; the file name gives the ``label`` column."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), rf"{suffix}(\.parquet)?$", "")
    return df.select("*", safe_label(name).alias(label))


def stopword_table(spark: SparkSession) -> DataFrame:
    """The fixed stopwords as a table, repeats kept."""
    return spark.createDataFrame([(w,) for w in STOPWORDS], "stopword string")


def name_tables(tables: dict[str, DataFrame]) -> None:
    """Make tables available by name, for ``spark.table`` and SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
