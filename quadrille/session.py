"""One session object over a store, a SPARQL engine and a search index; each is optional."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.functions.terms import KEY
from quadrille.operators import search as S
from quadrille.operators.filters import Criteria, QuadFilter
from quadrille.operators.store import QuadStore, materialize
from quadrille.shared import fresh_path
from quadrille.sparql.engine import Result, SparqlEngine


def make_filter(include: dict | None = None, exclude: dict | None = None) -> QuadFilter:
    return QuadFilter(Criteria(**(include or {})), Criteria(**(exclude or {})))


class ScanIndex:
    """Searches the store itself, so that it is never out of date; reindexing only counts."""

    def __init__(self, store: QuadStore):
        self.store = store

    def search(self, query: str, top_k: int | None = None, min_score: float | None = None, include: dict | None = None, exclude: dict | None = None) -> DataFrame:
        return S.search_scan(self.store.quads(), query, make_filter(include, exclude))

    def reindex(self, filter: QuadFilter | None = None, read_page_size: int = 1000) -> dict:
        return {"processed_quad_count": self.store.size(), "chunk_row_count": 0}


class ChunkIndex:
    """Searches a table of chunks that reindex() writes.

    on_import: incremental adds the chunks of what the session imports, deferred rebuilds when next searched; disabled,
    only on call. A replacing import, labels of subjects and a filter of the last reindex need a rebuild in any case.
    """

    def __init__(self, store: QuadStore, service: S.EmbeddingService | None = None, mode: str = "hybrid", splitter=None, label_predicates: tuple[str, ...] = (), on_import: str = "deferred"):
        if on_import not in S.ON_IMPORT:
            raise ValueError(f"on_import is one of {', '.join(S.ON_IMPORT)}")
        self.store, self.service, self.mode, self.splitter = store, service, mode, splitter
        self.label_predicates, self.on_import, self.table, self.stale = label_predicates, on_import, None, True
        self.parts: list[str] = []
        self.postings: list[str] = []
        self.filter: QuadFilter | None = None

    def imported(self, quads: DataFrame | None = None, mode: str = "merge") -> None:
        """Called when the session has imported quads."""
        fresh = self.table is not None and not self.stale
        self.stale = self.stale or self.on_import != "disabled"
        if self.on_import == "incremental":
            if fresh and quads is not None and mode == "merge" and not self.label_predicates and self.filter is None:
                self._add(quads)
            else:
                self.reindex()

    def _add(self, quads: DataFrame) -> None:
        """Write the chunks of quads that have none yet beside those that are there."""
        new = S.build_index(quads.dropDuplicates(KEY), None, self.splitter).join(self.table.select("quad_id").distinct(), "quad_id", "left_anti")
        self._write(new, self.parts, self.postings)

    def _write(self, index: DataFrame, parts: list[str], postings: list[str]) -> None:
        """The chunks of index and their postings as files, beside those of other chunks."""
        spark = self.store.spark
        if self.service is not None:
            index = S.embedded(index, self.service)
        at = fresh_path(spark, "index")
        index.write.parquet(at)
        terms = fresh_path(spark, "postings")
        S.write_postings(spark.read.schema(index.schema).parquet(at), terms)
        self.parts, self.postings = [*parts, at], [*postings, terms]
        self.table, self.stale = spark.read.schema(index.schema).parquet(*self.parts), False

    def reindex(self, filter: QuadFilter | None = None, read_page_size: int = 1000) -> dict:
        """Write the chunks of the quads in the filter anew. Calling it again changes nothing; the page size is unused."""
        self.filter = filter
        self._write(S.build_index(self.store.quads(), filter, self.splitter, self.label_predicates), [], [])
        from quadrille.operators.filters import filter_quads

        return {"processed_quad_count": filter_quads(self.store.quads(), filter).count(), "chunk_row_count": self.table.count()}

    def search(self, query: str, top_k: int = 10, min_score: float = 0.0, include: dict | None = None, exclude: dict | None = None) -> DataFrame:
        if self.table is None or self.stale:
            self.reindex()
        mode = self.mode if self.service is not None else "keyword"
        return S.search_index(self.table, query, mode, self.service, top_k, min_score, make_filter(include, exclude), self.postings)


class GraphSession:
    """import_, export, sparql, search and reindex, each by the part that was given."""

    def __init__(self, store: QuadStore | None = None, engine: SparqlEngine | None = None, index=None):
        self.store, self.engine, self.index = store, engine, index

    @classmethod
    def in_memory(cls, spark: SparkSession) -> GraphSession:
        """A session over a new, empty store that all three parts share."""
        store = QuadStore(spark)
        return cls(store, SparqlEngine(spark, store=store), ScanIndex(store))

    def import_(self, source: dict, mode: str = "merge") -> None:
        if self.store is None:
            raise RuntimeError("Quad store is not configured.")
        quads = materialize(self.store.spark, source)
        self.store.import_({"kind": "dataset", "dataset": quads}, mode)
        if isinstance(self.index, ChunkIndex):
            self.index.imported(quads, mode)

    def export(self, format: dict | None = None) -> dict:
        if self.store is None:
            raise RuntimeError("Quad store is not configured.")
        return self.store.export(format)

    def sparql(self, query: str, base_iri: str = "", timeout_ms: int | None = None) -> Result:
        if self.engine is None:
            raise RuntimeError("SPARQL engine is not configured.")
        return self.engine.execute(query, base_iri, timeout_ms)

    def search(self, query: str, **options) -> DataFrame:
        if self.index is None:
            raise RuntimeError("Search index is not configured.")
        return self.index.search(query, **options)

    def reindex(self, **options) -> dict:
        if self.index is None:
            raise RuntimeError("Search index is not configured.")
        return self.index.reindex(**options)
