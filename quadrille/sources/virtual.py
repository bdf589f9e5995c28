"""Relational tables as graphs, without copying them.

Each mapped column is one projection with a literal predicate. A pattern with a known predicate reads only the
projections that have it, so that it costs what a scan of two columns does; numbers keep their native values beside
their lexical form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import COLUMNS, DEFAULT, IRI, LANG_STRING, LITERAL, QUAD_SCHEMA, RDF, XSD

#: The type of an exact number in a solution; a sum of two such fits Spark's widest decimal without loss.
EXACT = "decimal(37,12)"
_TYPES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "double": "double", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}


def _fits(kind: str) -> bool:
    """Whether a type is a decimal whose numbers are all exact ones in SPARQL; others are shown as text."""
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
    return m is not None and int(m[2]) <= 12 and int(m[1]) - int(m[2]) <= 25


def decimal_form(c: Column) -> Column:
    """Without needless zeros behind the point."""
    text = c.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


@dataclass
class TableMap:
    """How a table becomes a graph.

    key: column, or expression, unique to the row, that names it; links: column to the table whose rows it names; lang: column to
    the column of its language; graph: column that names the graph of the row's quads.
    """

    name: str
    table: DataFrame
    key: str | Column
    columns: list[str]
    links: dict[str, str] = field(default_factory=dict)
    lang: dict[str, str] = field(default_factory=dict)
    graph: str | None = None

    def subject(self) -> Column:
        key = F.col(self.key) if isinstance(self.key, str) else self.key
        return F.concat(F.lit(f"urn:{self.name}:"), key.cast("string"))

    def is_subject(self, value: str) -> Column:
        """Whether the row is the one named so; on a plain key column this filter reaches the scan."""
        head = f"urn:{self.name}:"
        if not value.startswith(head):
            return F.lit(False)
        if not isinstance(self.key, str):
            return self.subject() == value
        rest = F.lit(value[len(head) :])
        return (F.col(self.key) == rest.try_cast(dict(self.table.dtypes)[self.key])) & (F.col(self.key).cast("string") == rest)

    def graph_columns(self) -> tuple[Column, Column]:
        if not self.graph:
            return F.lit(""), F.lit(DEFAULT)
        return F.concat(F.lit("urn:graph:"), F.col(self.graph).cast("string")), F.lit(IRI)

    def is_graph(self, value: str) -> Column:
        """Whether the row lies in the graph named so; a filter on the column itself."""
        head = "urn:graph:"
        if not self.graph or not value.startswith(head):
            return F.lit(False)
        return F.col(self.graph).cast("string") == value[len(head) :]

    def objects(self) -> dict[str, tuple]:
        """By predicate: source column, then the object's value, kind, datatype, language, number, instant and exact number,
        and the datatype if it is a number's."""
        types = dict(self.table.dtypes)
        null, no, never, inexact = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast(EXACT)
        out = {RDF + "type": (None, F.lit(f"urn:class:{self.name}"), IRI, null, null, no, never, inexact, None)}
        for c in self.columns:
            p = f"urn:col:{c}"
            if c in self.links:
                out[p] = (c, F.concat(F.lit(f"urn:{self.links[c]}:"), F.col(c).cast("string")), IRI, null, null, no, never, inexact, None)
            elif c in self.lang:
                out[p] = (c, F.col(c), LITERAL, F.lit(LANG_STRING), F.col(self.lang[c]), no, never, inexact, None)
            else:
                kind = "decimal" if _fits(types[c]) else _TYPES.get(types[c])
                # A time as text has its fraction without needless zeros
                text = F.replace(F.col(c).cast("string"), F.lit(" "), F.lit("T")) if kind == "dateTime" else decimal_form(F.col(c)) if kind == "decimal" else F.col(c).cast("string")
                numeric = kind in ("integer", "decimal", "double")
                exact = F.col(c).cast(EXACT) if kind in ("integer", "decimal") else inexact
                when = F.col(c).cast("timestamp_ntz") if kind in ("dateTime", "date") else never
                out[p] = (c, text, LITERAL, F.lit(XSD + kind) if kind else null, null, F.col(c).cast("double") if numeric else no, when, exact, XSD + kind if numeric else None)
        return out

    def branches(self) -> list[tuple[str, DataFrame]]:
        """(predicate, quads) for the class of the rows and each column."""
        null = F.lit(None).cast("string")
        out = []
        for p, (c, o, kind, datatype, lang, num, _, _, _) in self.objects().items():
            parts = (self.subject(), F.lit(IRI), F.lit(p), o, F.lit(kind), datatype, lang, null, *self.graph_columns(), num)
            rows = self.table if c is None else self.table.where(F.col(c).isNotNull())
            out.append((p, rows.select(*[x.alias(n) for x, n in zip(parts, COLUMNS, strict=True)])))
        return out


class VirtualGraph:
    """Tables seen as one set of quads."""

    def __init__(self, maps: list[TableMap]):
        self.maps = maps
        self.spark = maps[0].table.sparkSession
        self._branches = [b for m in maps for b in m.branches()]

    def star(self, predicates: list[str], types: set[str]) -> TableMap | None:
        """The one table whose rows have all these predicates, if there is just one.

        Keys are unique, so that each predicate has one object and a row answers the whole star.
        """
        found = [m for m in self.maps if set(predicates) <= m.objects().keys() and types <= {f"urn:class:{m.name}"}]
        return found[0] if len(found) == 1 else None

    def scan(self, predicate: str | None = None, bound: str = "") -> DataFrame:
        found = [q for p, q in self._branches if predicate is None or p == predicate]
        if not found:
            return self.spark.createDataFrame([], QUAD_SCHEMA)
        return reduce(DataFrame.unionByName, found)

    def quads(self) -> DataFrame:
        return self.scan()


class StoredGraph:
    """A DataFrame of quads, or a function that gives one for the parts that a pattern binds, as a source of patterns."""

    def __init__(self, quads):
        self._quads = quads

    def quads(self, bound: str = "") -> DataFrame:
        return self._quads(bound) if callable(self._quads) else self._quads

    def scan(self, predicate: str | None = None, bound: str = "") -> DataFrame:
        q = self.quads(bound if predicate is None else bound + "p")
        return q if predicate is None else q.where(F.col("p") == predicate)
