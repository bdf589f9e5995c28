"""Tables of quads in any format or database that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import KEY, conform

#: Formats that keep no types and read an empty text as null.
_TEXT = ("csv",)


def read_quads(spark: SparkSession, format: str, path: str | None = None, **options: str) -> DataFrame:
    """Quads of a table with the columns s, p and o, and others of a quad where it has them (parquet, orc, json, csv, jdbc
    and so on; options are the source's own). A null object is an empty text."""
    if format in _TEXT:
        options = {"header": "true", "escape": '"', "multiLine": "true", **options}
    reader = spark.read.format(format).options(**options)
    df = reader.load(path) if path else reader.load()
    return conform(df.withColumn("o", F.coalesce(F.col("o").cast("string"), F.lit(""))))


def write_quads(quads: DataFrame, format: str, path: str | None = None, mode: str = "error", **options: str) -> None:
    """The quads as a table that read_quads() reads."""
    if format in _TEXT:
        options = {"header": "true", "escape": '"', "quoteAll": "true", "emptyValue": "", **options}
    writer = quads.select(*KEY).write.format(format).options(**options).mode(mode)
    writer.save(path) if path else writer.save()
