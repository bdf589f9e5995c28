"""Runs queries and updates over a source of quads."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import DEFAULT, IRI, KEY, LITERAL, QUAD_SCHEMA, Term, with_number
from quadrille.operators.store import Patch, QuadStore, apply_patch, without
from quadrille.shared import cut
from quadrille.sources import rdf
from quadrille.sources.virtual import StoredGraph
from quadrille.sparql import algebra as A
from quadrille.sparql.compiler import Compiler, Scope, Sol
from quadrille.sparql.expressions import STRING, column, ref
from quadrille.sparql.parser import is_update, parse_query, parse_update

DEFAULT_TIMEOUT_MS = 30_000


class QueryTimeout(TimeoutError):
    pass


@dataclass
class Result:
    """kind is select, ask, construct, describe or void. What is not yet computed is a DataFrame."""

    kind: str
    vars: list[str] | None = None
    solutions: DataFrame | None = None
    boolean: bool | None = None
    quads: DataFrame | None = None

    def values(self, numbers: tuple[str, ...] = (), exact: tuple[str, ...] = ()) -> DataFrame:
        """One column of lexical forms for each variable; of doubles for those in numbers, of decimals for those in exact."""
        return self.solutions.select(*[ref(v, "n" if v in numbers else "e" if v in exact else "v").alias(v) for v in self.vars])

    def terms(self) -> DataFrame:
        """One struct column (kind, value, datatype, lang) for each variable; null if unbound."""
        return self.solutions.select(*[F.when(ref(v, "v").isNotNull(), F.struct(ref(v, "k").alias("kind"), ref(v, "v").alias("value"), ref(v, "d").alias("datatype"), ref(v, "l").alias("lang"))).alias(v) for v in self.vars])

    def bindings(self) -> list[dict]:
        """Solutions in the JSON results form, gathered on the driver."""
        out = []
        for r in self.solutions.collect():
            row = {}
            for v in self.vars:
                value, kind, datatype, lang = (r[column(v, p)] for p in "vkdl")
                if value is None:
                    continue
                t = {"type": {IRI: "uri", LITERAL: "literal", "BlankNode": "bnode", "Triple": "triple"}[kind], "value": value}
                if kind == LITERAL and lang:
                    tag, _, direction = lang.partition("--")
                    t |= {"xml:lang": tag} | ({"its:dir": direction} if direction else {})
                elif kind == LITERAL and datatype and datatype != STRING:
                    t["datatype"] = datatype
                row[v] = t
            out.append(row)
        return out

    def data(self):
        """As a JSON results document; quads as a DataFrame."""
        if self.kind == "select":
            return {"head": {"vars": self.vars}, "results": {"bindings": self.bindings()}}
        if self.kind == "ask":
            return {"head": {}, "boolean": self.boolean}
        return self.quads


class SparqlEngine:
    """Queries a source of quads; updates need a store, whose commit they use."""

    def __init__(self, spark: SparkSession, source=None, store: QuadStore | None = None):
        self.spark, self.store = spark, store
        self.source = source if source is not None else StoredGraph(store.quads)

    def execute(self, query: str, base_iri: str = "", timeout_ms: int | None = None, allow_updates: bool = True) -> Result:
        """Run a query or an update. With a time limit, the result is computed within it."""
        if is_update(query, base_iri):
            if not allow_updates:
                raise PermissionError("updates are not allowed here")
            run = lambda: self.update(query, base_iri)
        else:
            run = lambda: self.query(query, base_iri)
        if timeout_ms is None:
            return run()
        return self._within(timeout_ms, run)

    def _within(self, timeout_ms: int, run) -> Result:
        tag, sc = "sparql-" + uuid.uuid4().hex, self.spark.sparkContext
        late = threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        def guard() -> None:
            """Too late to commit; once committed, an update is done whatever the clock says."""
            if late.is_set():
                raise QueryTimeout(f"the update took more than {timeout_ms} ms")
            timer.cancel()

        if self.store is not None:
            self.store.guard = guard

        timer = threading.Timer(timeout_ms / 1000, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            r = run()
            if r.solutions is not None:
                r.solutions = cut(r.solutions)
            if r.quads is not None:
                r.quads = cut(r.quads)
            if late.is_set() and r.kind != "void":
                raise QueryTimeout(f"the query took more than {timeout_ms} ms")
            return r
        except QueryTimeout:
            raise
        except Exception as e:
            if late.is_set():
                raise QueryTimeout(f"the query took more than {timeout_ms} ms") from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
            if self.store is not None:
                self.store.guard = lambda: None

    def query(self, text: str, base: str = "") -> Result:
        q = parse_query(text, base)
        c = Compiler(self.spark, self.source, base)
        scope = Scope(q.default_graphs, q.named_graphs, bool(q.default_graphs or q.named_graphs))
        if q.form == "select":
            sol = c.select(q, scope)
            return Result("select", sol.vars, sol.df)
        if q.form == "ask":
            return Result("ask", boolean=not c.group(q.where, scope).df.isEmpty())
        if q.form == "describe":
            return Result("describe", quads=c.describe(q, scope))
        sol = c.group(q.where, scope)
        sol = c.sliced(q, sol, sol.vars, q.order_by)
        quads = c.instantiate(sol, [(None, t) for t in q.template])
        return Result("construct", quads=quads if quads is not None else self.spark.createDataFrame([], QUAD_SCHEMA))

    # Updates
    def update(self, text: str, base: str = "") -> Result:
        """Operations in order, each on what those before it made; one snapshot is written at the end, or none."""
        if self.store is None:
            raise ValueError("this engine has no store to update")
        operations = parse_update(text, base).operations
        quads = start = self.store.quads()
        if all(isinstance(op, A.Modify) for op in operations):
            # What is added and removed is enough; the store's quads are only read
            new = gone = None
            for i, op in enumerate(operations):
                patch = self.patch_of(quads, op)
                minus, plus = (None if d is None else cut(d) for d in (patch.deletions, patch.insertions))
                if minus is not None:
                    new, gone = None if new is None else without(new, minus), minus if gone is None else gone.unionByName(minus)
                if plus is not None:
                    new = plus if new is None else new.unionByName(plus)
                if i + 1 < len(operations):
                    quads = cut(apply_patch(quads, Patch(plus, minus)))
            if new is not None or gone is not None:
                self.store.apply(Patch(new, gone))
            return Result("void")
        for op in operations:
            quads = cut(self.modified(quads, op) if isinstance(op, A.Modify) else self.managed(quads, op))
        if quads is not start:
            if self.store._override is not None:
                old, new = start.select(*KEY), quads.select(*KEY)
                self.store.apply(Patch(with_number(new.exceptAll(old)), with_number(old.exceptAll(new))))
            else:
                self.store.write(quads)
        return Result("void")

    def modified(self, quads: DataFrame, op: A.Modify) -> DataFrame:
        return apply_patch(quads, self.patch_of(quads, op))

    def patch_of(self, quads: DataFrame, op: A.Modify) -> Patch:
        c = Compiler(self.spark, StoredGraph(quads))
        graph = op.with_graph or ""
        if op.where is None:
            sol = c.unit()
            for template, what in ((op.delete, "delete"),):
                if any(isinstance(x, A.Var) for _, t in template for x in (t.s, t.p, t.o)):
                    raise ValueError(f"blank nodes and variables are not allowed in {what} data")
        else:
            scope = Scope(op.using or ([graph] if graph else []), op.using_named, bool(op.using or op.using_named))
            if graph and not op.using and not op.using_named:
                # WITH makes one graph the default graph of the pattern; named graphs stay
                quads_in = quads.where(F.col("g_kind") != DEFAULT).unionByName(quads.where(F.col("g") == graph).withColumns({"g": F.lit(""), "g_kind": F.lit(DEFAULT)}))
                c = Compiler(self.spark, StoredGraph(quads_in))
                scope = Scope()
            sol = c.group(op.where, scope)
            sol = Sol(cut(sol.df), sol.always, sol.kinds)
        gone, new = c.instantiate(sol, op.delete, graph), c.instantiate(sol, op.insert, graph)
        return Patch(new, gone)

    def managed(self, quads: DataFrame, op: A.Manage) -> DataFrame:
        def inside(target: str):
            if target == "ALL":
                return F.lit(True)
            if target == "NAMED":
                return F.col("g_kind") != DEFAULT
            return F.col("g_kind") == DEFAULT if target == "DEFAULT" else (F.col("g") == target) & (F.col("g_kind") == IRI)

        if op.verb == "CREATE":
            return quads
        if op.verb in ("CLEAR", "DROP"):
            return quads.where(~inside(op.source))
        if op.verb == "LOAD":
            try:
                if not op.source.startswith(("file:", "/")):
                    raise ValueError(f"only local files can be loaded, not {op.source}")
                new = cut(rdf.read_files(self.spark, op.source))
            except Exception:
                if op.silent:
                    return quads
                raise
            return apply_patch(quads, Patch(_moved(new, op.target), None))
        if op.source == op.target:
            return quads
        copied = _moved(quads.where(inside(op.source)), op.target)
        rest = quads if op.verb == "ADD" else quads.where(~inside(op.target))
        if op.verb == "MOVE":
            rest = rest.where(~inside(op.source))
        return apply_patch(rest, Patch(copied, None))


def _moved(quads: DataFrame, target: str) -> DataFrame:
    default = target in (None, "DEFAULT")
    return quads.withColumns({"g": F.lit("" if default else target), "g_kind": F.lit(DEFAULT if default else IRI)})


__all__ = ["DEFAULT_TIMEOUT_MS", "QueryTimeout", "Result", "SparqlEngine", "Term"]
