"""The folder that every executor can reach, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, read from spark.checkpoint.dir.

    A folder of our own is made only where the setting is absent, as in tests on one machine.
    """
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage replaced by files in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def local_path(uri: str) -> str:
    """A path that open() takes, for a file: URI or a mounted folder."""
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri
