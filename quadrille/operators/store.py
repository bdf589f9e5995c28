"""Quad stores: snapshots, transactions, import and export.

A store is a sequence of commits. A commit's state names a base, immutable Parquet folders with all quads of some moment
in one or more orderings, and two small tables, what was added and what was removed since; readers see the base less what
was removed, with what was added. A small commit writes those two tables anew and never shuffles the base, which it only
scans for the quads it concerns; once they hold more than DELTA_ROWS rows, or a commit is large, a new base is written. A
commit's file is made under the number after the last one's, which fails if another writer was faster. A base is laid
out by ranges of the first parts of its ordering, so that a pattern with those parts reads few row groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import COLUMNS, KEY, QUAD_SCHEMA, Quad, conform, quads_from, quads_of, with_number
from quadrille.operators.filters import match
from quadrille.shared import cut, fresh_path
from quadrille.sources import rdf
from quadrille.sources.tables import read_quads

#: Orderings of the four parts that a base may be kept in.
ORDERINGS = ("spog", "sopg", "pso", "pos", "ospg", "opsg", "gpso")
#: Rows that may be added or removed before a new base is written; so many may be broadcast.
DELTA_ROWS = 500_000


class ConcurrentCommit(RuntimeError):
    """Another writer committed since this one read the store."""


@dataclass(frozen=True)
class Patch:
    """What a commit adds and removes; each a DataFrame of quads, or None."""

    insertions: DataFrame | None
    deletions: DataFrame | None

    def is_empty(self) -> bool:
        return all(d is None or d.isEmpty() for d in (self.insertions, self.deletions))


@dataclass(frozen=True)
class Context:
    """Why a commit happens: import_mode is merge or replace for an import, None for others."""

    import_mode: str | None = None

    def is_import(self) -> bool:
        return self.import_mode is not None

    def is_replace(self) -> bool:
        return self.import_mode == "replace"



def without(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """quads that are not in gone, term by term."""
    a, b = quads.alias("a"), gone.select(*KEY).alias("b")
    return a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]), "left_anti")


def among(quads: DataFrame, few: DataFrame) -> DataFrame:
    """quads that are in few, which is small, term by term."""
    a, b = quads.alias("a"), F.broadcast(few.select(*KEY).alias("b"))
    return a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]), "left_semi")


def apply_patch(quads: DataFrame, patch: Patch, context: Context = Context()) -> DataFrame:
    """The quads after a commit: nothing of the old if it replaces, less the deletions, with the insertions, each once."""
    out = quads.limit(0) if context.is_replace() else quads
    if patch.deletions is not None:
        out = without(out, patch.deletions)
    if patch.insertions is not None:
        out = out.unionByName(patch.insertions.select(*COLUMNS))
    return out.dropDuplicates(KEY)


def cancel(insertions: DataFrame | None, deletions: DataFrame | None) -> Patch:
    """The buffers less what is in both, one for one."""
    if insertions is None or deletions is None:
        return Patch(insertions, deletions)
    i, d = insertions.select(*KEY), deletions.select(*KEY)
    return Patch(with_number(i.exceptAll(d)), with_number(d.exceptAll(i)))


class Transaction:
    """Buffered additions and removals, applied by one commit. Reads do not see the buffers."""

    def __init__(self, spark: SparkSession, commit: Callable[[Patch, Context], None], read: Callable[[], DataFrame] | None = None):
        self.spark, self._commit, self._read = spark, commit, read
        self.insertions: DataFrame | None = None
        self.deletions: DataFrame | None = None

    def _frame(self, quads) -> DataFrame:
        return conform(quads) if isinstance(quads, DataFrame) else quads_from(self.spark, [quads] if isinstance(quads, Quad) else quads)

    def add(self, quads: Quad | Iterable[Quad] | DataFrame) -> Transaction:
        new = self._frame(quads)
        self.insertions = new if self.insertions is None else self.insertions.unionByName(new)
        return self

    def delete(self, quads: Quad | Iterable[Quad] | DataFrame) -> Transaction:
        new = self._frame(quads)
        self.deletions = new if self.deletions is None else self.deletions.unionByName(new)
        return self

    add_quad = add_quads = add
    remove_quad = remove_quads = delete

    def remove_matches(self, s=None, p=None, o=None, g=None) -> Transaction:
        """Remove what the pattern matches in the store as it is, whatever is in the buffers."""
        if self._read is None:
            raise ValueError("this transaction has no store to match in")
        return self.delete(match(self._read(), s, p, o, g))

    def delete_graph(self, g) -> Transaction:
        return self.remove_matches(g=g)

    def commit(self, context: Context = Context()) -> None:
        """Apply the buffers less what cancels. Nothing happens if nothing is left; a failure keeps the buffers."""
        patch = cancel(self.insertions, self.deletions)
        if not patch.is_empty():
            self._commit(patch, context)
        self.rollback()

    def rollback(self) -> None:
        self.insertions = self.deletions = None


class Files:
    """Small files beside the snapshots, by way of Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that must not be there; False if it is."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        try:
            stream = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def write(self, path: str, text: str) -> None:
        """Put text in place of the file at once, by a rename over it."""
        fs, p = self._at(path)
        _, tmp = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        option = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(tmp, p, options)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class QuadStore:
    """Quads kept below a folder.

    commit: called with (patch, context) instead of writing, for stores that are kept elsewhere; orderings: those of
    ORDERINGS that the base is kept in, of which a pattern reads the one that begins with most of its parts; guard: called
    right before a commit takes effect, which it may stop by raising.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, commit: Callable[[Patch, Context], None] | None = None, orderings: tuple[str, ...] = ("pso",)):
        if not orderings or set(orderings) - set(ORDERINGS):
            raise ValueError(f"orderings are some of {', '.join(ORDERINGS)}")
        self.spark, self.folder = spark, folder or fresh_path(spark, "store")
        self.files = Files(spark)
        self.orderings = tuple(orderings)
        self._override = commit
        self.guard: Callable[[], None] = lambda: None

    @property
    def pointer(self) -> str:
        return f"{self.folder}/CURRENT"

    def _commit_file(self, version: int) -> str:
        return f"{self.folder}/commit-{version:012d}"

    def state(self) -> dict | None:
        """The last commit: version, base, orderings, added, removed (folders or None) and rows of both. None before any."""
        text = self.files.read(self.pointer)
        state = json.loads(text) if text else None
        # The pointer may lag behind, as it is written after the commit's own file
        while (text := self.files.read(self._commit_file(state["version"] + 1 if state else 1))) is not None:
            state = json.loads(text)
        return state

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(QUAD_SCHEMA).parquet(f"{self.folder}/{name}")

    def _ordering(self, state: dict, bound: str) -> str:
        """The ordering that begins with most of the bound parts."""

        def prefix(ordering: str) -> int:
            return next((i for i, c in enumerate(ordering) if c not in bound), len(ordering))

        return max(state["orderings"], key=prefix)

    def _view(self, state: dict | None, bound: str = "") -> DataFrame:
        if state is None:
            return self.spark.createDataFrame([], QUAD_SCHEMA)
        quads = self._read(f"{state['base']}/{self._ordering(state, bound)}")
        if state["removed"]:
            quads = without(quads, F.broadcast(self._read(state["removed"])))
        return quads.unionByName(self._read(state["added"])) if state["added"] else quads

    def quads(self, bound: str = "") -> DataFrame:
        """The quads as of the last commit. bound: the parts, of spog, that a pattern binds, to pick an ordering by."""
        return self._view(self.state(), bound)

    def _commit(self, old: dict | None, state: dict) -> None:
        state = {"version": (old["version"] if old else 0) + 1, **state}
        self.guard()
        if not self.files.create(self._commit_file(state["version"]), json.dumps(state)):
            raise ConcurrentCommit(f"version {state['version']} of the store was committed by another writer")
        self.files.write(self.pointer, json.dumps(state))
        # The version before stays for readers that have begun; what only older ones read goes
        if old is None or old["version"] < 2:
            return
        before = json.loads(self.files.read(self._commit_file(old["version"] - 1)) or "{}")
        kept = {x.get(k) for x in (old, state) for k in ("base", "added", "removed")}
        for k in ("base", "added", "removed"):
            if before.get(k) and before[k] not in kept:
                self.files.remove(f"{self.folder}/{before[k]}")
        self.files.remove(self._commit_file(old["version"] - 1))

    def _save(self, quads: DataFrame, what: str) -> str:
        name = f"{what}-{uuid.uuid4().hex}"
        quads.select(*COLUMNS).write.parquet(f"{self.folder}/{name}")
        return name

    def _rebase(self, old: dict | None, quads: DataFrame) -> None:
        name = f"base-{uuid.uuid4().hex}"
        for ordering in self.orderings:
            quads.select(*COLUMNS).repartitionByRange(*ordering[:2]).sortWithinPartitions(*ordering).write.parquet(f"{self.folder}/{name}/{ordering}")
        self._commit(old, {"base": name, "orderings": list(self.orderings), "added": None, "removed": None, "rows": 0})

    def write(self, quads: DataFrame) -> None:
        """Make quads all that the store holds."""
        self._rebase(self.state(), quads)

    def apply(self, patch: Patch, context: Context = Context()) -> None:
        if self._override is not None:
            self._override(patch, context)
            return
        old = self.state()
        if old is None or context.is_replace():
            self._rebase(old, apply_patch(self._view(old), patch, context))
            return
        new, gone = (None if d is None else cut(d.select(*COLUMNS).dropDuplicates(KEY)) for d in (patch.insertions, patch.deletions))
        if old["rows"] + sum(d.count() for d in (new, gone) if d is not None) > DELTA_ROWS:
            self._rebase(old, apply_patch(self._view(old), patch, context))
            return
        added = self._read(old["added"]) if old["added"] else None
        removed = self._read(old["removed"]) if old["removed"] else None
        base = self._read(f"{old['base']}/{old['orderings'][0]}")
        hidden = base if removed is None else without(base, F.broadcast(removed))
        if gone is not None:
            hit = among(hidden, gone)
            removed = hit if removed is None else removed.unionByName(hit)
            added = None if added is None else without(added, gone)
        if new is not None:
            there = among(hidden, new)
            if gone is not None:
                there = without(there, gone)
            new = without(new, there)
            added = new if added is None else without(added, new).unionByName(new)
        added, removed = (None if d is None else cut(d.select(*COLUMNS)) for d in (added, removed))
        n = [0 if d is None else d.count() for d in (added, removed)]
        self._commit(old, {"base": old["base"], "orderings": old["orderings"], "added": self._save(added, "added") if n[0] else None, "removed": self._save(removed, "removed") if n[1] else None, "rows": sum(n)})

    def compact(self) -> None:
        """Write a new base with all that was added and without what was removed."""
        old = self.state()
        if old is not None and old["rows"]:
            self._rebase(old, self._view(old))

    def transaction(self) -> Transaction:
        return Transaction(self.spark, self.apply, self.quads)

    def match(self, s=None, p=None, o=None, g=None) -> DataFrame:
        bound = "".join(n for n, x in zip("spog", (s, p, o, g), strict=True) if x is not None)
        return match(self.quads(bound), s, p, o, g)

    def size(self) -> int:
        return self.quads().count()

    def graph_sizes(self) -> DataFrame:
        return self.quads().groupBy("g").agg(F.count("*").alias("n"))

    def clear(self) -> None:
        """Remove all quads; a replacing import of nothing does not."""
        self.write(self.quads().limit(0))

    def import_(self, source: dict, mode: str = "merge") -> None:
        """Add a source's quads, or put them in place of all others (mode replace).

        source: {"kind": "quads", "quads": [...]}, {"kind": "dataset", "dataset": DataFrame or quads} or
        {"kind": "serialized", "data": text, "content_type": type} or with "path" in place of data, or {"kind": "table",
        "format": format, "path": path, "options": {...}} of any source that Spark reads. Data that cannot be read raises before anything changes; replacing with nothing changes nothing.
        """
        if mode not in ("merge", "replace"):
            raise ValueError(f"unknown import mode {mode}")
        tx = self.transaction().add(materialize(self.spark, source))
        try:
            tx.commit(Context(mode))
        except Exception:
            tx.rollback()
            raise

    def export(self, format: dict | None = None) -> dict:
        """{"kind": "quads"} gives the DataFrame; {"kind": "serialized", "content_type": type} gives one string.

        The content type asked for is given back, also where its text is N-Quads for want of a writer.
        """
        return export_quads(self.quads(), format or {"kind": "quads"})


def materialize(spark: SparkSession, source: dict) -> DataFrame:
    """The quads of an import source."""
    kind = source.get("kind")
    if kind == "quads":
        q = source["quads"]
        return conform(q) if isinstance(q, DataFrame) else quads_from(spark, q)
    if kind == "dataset":
        d = source["dataset"]
        return conform(d) if isinstance(d, DataFrame) else quads_from(spark, d)
    if kind == "serialized":
        if "path" in source:
            by_line = rdf.get_format(source.get("content_type")) != "turtle"
            return rdf.read_lines(spark, source["path"]) if by_line else rdf.read_files(spark, source["path"])
        return rdf.read_text(spark, source["data"], source.get("content_type"), source.get("base", ""))
    if kind == "table":
        return read_quads(spark, source["format"], source.get("path"), **source.get("options", {}))
    raise ValueError("Unsupported import source kind")


def export_quads(quads: DataFrame, format: dict) -> dict:
    kind = format.get("kind")
    if kind == "quads":
        return {"kind": "quads", "quads": quads}
    if kind == "serialized":
        content_type = format.get("content_type") or rdf.DEFAULT_TYPE
        return {"kind": "serialized", "data": rdf.serialize(quads, content_type), "content_type": content_type}
    raise ValueError("Invalid format requested")


class TransactionalStore:
    """A store whose reads go to the snapshot and whose writes go to a transaction, unseen until it commits."""

    def __init__(self, store: QuadStore):
        self.store, self.tx = store, store.transaction()

    def match(self, s=None, p=None, o=None, g=None) -> DataFrame:
        return self.store.match(s, p, o, g)

    def has(self, quad: Quad) -> bool:
        return not self.match(quad.s, quad.p, quad.o, quad.g).isEmpty()

    @property
    def size(self) -> int:
        return self.store.size()

    def add(self, quads) -> TransactionalStore:
        self.tx.add(quads)
        return self

    def delete(self, quads) -> TransactionalStore:
        self.tx.delete(quads)
        return self

    def remove_matches(self, s=None, p=None, o=None, g=None) -> TransactionalStore:
        self.tx.remove_matches(s, p, o, g)
        return self

    def delete_graph(self, g) -> TransactionalStore:
        self.tx.delete_graph(g)
        return self

    def commit(self, context: Context = Context()) -> None:
        self.tx.commit(context)

    def rollback(self) -> None:
        self.tx.rollback()


__all__ = ["DELTA_ROWS", "ORDERINGS", "ConcurrentCommit", "Context", "Patch", "QuadStore", "Transaction", "TransactionalStore", "apply_patch", "cancel", "export_quads", "materialize", "quads_of", "without"]
