"""Incremental import: a stream of quads, or of N-Quads lines, into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quadrille.operators.store import Context, QuadStore
from quadrille.sources.rdf import from_lines


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Quads of the N-Quads files that arrive in a folder."""
    return from_lines(spark.readStream.text(folder))


def ingest(quads: DataFrame, store: QuadStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge each micro-batch into the store.

    Merging is idempotent, so that a batch that is run again after a failure adds nothing twice. No state is kept but
    the store itself.
    """

    def merge(batch: DataFrame, _: int) -> None:
        store.transaction().add(batch).commit(Context("merge"))

    w = quads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
