"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# frees the shuffle files of a finished write, which its result no longer needs
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spark_session(app: str = "scimetrics", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    Shuffle partitions start high on a cluster and AQE coalesces them; skewed
    join partitions are split at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session whose tasks all run in the driver's process may fall back to
    a folder of its own: elsewhere a machine-local path would be invisible to
    the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    created = tempfile.mkdtemp(prefix="scimetrics-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    This cuts the lineage of an iterative job with files that outlive any
    executor, and gives the next plan real sizes to choose its joins by.
    """
    return _written(df, new_path(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared work folder."""
    return f"{work_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


class WorkTables:
    """Work tables that are deleted together when the block ends.

    ``keep`` works as ``materialize``; what a later step still needs has to be
    written outside before the end of the block.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> WorkTables:
        return self

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        self.paths.append(path)
        return _written(df, path)

    def __exit__(self, *error: object) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in self.paths:
            place = hadoop.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
