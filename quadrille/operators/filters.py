"""Pattern matching and include/exclude filters over quads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import DEFAULT_GRAPH, LITERAL, Quad, Term, literal, row

#: Longer lists become a join, whose table Spark broadcasts or shuffles by its size.
MAX_IN_LIST = 1000


@dataclass
class Criteria:
    """Values of subjects, predicates and graphs. None or an empty list sets no constraint."""

    subjects: list[str] | None = None
    predicates: list[str] | None = None
    graphs: list[str] | None = None

    def lists(self) -> list[tuple[str, list[str]]]:
        return [(c, list(v)) for c, v in (("s", self.subjects), ("p", self.predicates), ("g", self.graphs)) if v]


@dataclass
class QuadFilter:
    """Quads that are in all include lists and in no exclude list, by value whatever the kind."""

    include: Criteria = field(default_factory=Criteria)
    exclude: Criteria = field(default_factory=Criteria)


def filter_quads(quads: DataFrame, f: QuadFilter | None = None) -> DataFrame:
    for how, criteria in (("left_semi", f.include), ("left_anti", f.exclude)) if f else ():
        for c, values in criteria.lists():
            if len(values) <= MAX_IN_LIST:
                hit = F.col(c).isin(values)
                quads = quads.where(hit if how == "left_semi" else ~hit)
            else:
                quads = quads.join(quads.sparkSession.createDataFrame([(v,) for v in set(values)], f"{c} string"), c, how).select(*quads.columns)
    return quads


def pattern(s: Term | str | None = None, p: Term | str | None = None, o: Term | None = None, g: Term | str | None = None) -> Column:
    """Whether a quad matches; None matches all. A string stands for an IRI, and for a graph '' is the default one."""
    found = F.lit(True)
    if s is not None:
        t = Term("NamedNode", s) if isinstance(s, str) else s
        found &= (F.col("s") == t.value) & (F.col("s_kind") == t.kind)
    if p is not None:
        found &= F.col("p") == (p if isinstance(p, str) else p.value)
    if o is not None:
        found &= (F.col("o") == o.value) & (F.col("o_kind") == o.kind)
        if o.kind == LITERAL:
            t = literal(o.value, o.datatype, o.lang, o.dir)
            _, _, _, _, _, datatype, lang, dir_, *_ = row(Quad(Term("NamedNode", ""), Term("NamedNode", ""), t))
            for c, v in (("o_datatype", datatype), ("o_lang", lang), ("o_dir", dir_)):
                found &= F.col(c).isNull() if v is None else F.col(c) == v
    if g is not None:
        t = (DEFAULT_GRAPH if g == "" else Term("NamedNode", g)) if isinstance(g, str) else g
        found &= (F.col("g") == t.value) & (F.col("g_kind") == t.kind)
    return found


def match(quads: DataFrame, s=None, p=None, o=None, g=None) -> DataFrame:
    return quads.where(pattern(s, p, o, g))
