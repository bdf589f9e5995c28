"""Algebra to DataFrames.

A solution table has seven columns for each variable (expressions.PARTS). Which variables are bound in every row is
tracked, so that joins on them stay plain equi-joins, which Catalyst may run as hash or sort-merge joins; only a
variable that may be unbound needs the form with OR.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import BNODE, COLUMNS, DEFAULT, IRI, KEY, LITERAL, RDF, TRIPLE, Term, conform
from quadrille.operators.filters import pattern
from quadrille.shared import cut
from quadrille.sources.virtual import VirtualGraph
from quadrille.sparql import algebra as A
from quadrille.sparql import expressions as X
from quadrille.sparql.expressions import PARTS, column, ref

#: Rounds of a path closure between cuts of its lineage.
CUT_EVERY = 4
TYPE = RDF + "type"
ANY = frozenset((IRI, BNODE, LITERAL, TRIPLE))


@dataclass
class Sol:
    """A solution table: always holds the variables that no row leaves unbound, kinds what a variable may be."""

    df: DataFrame
    always: dict[str, bool] = field(default_factory=dict)
    kinds: dict[str, frozenset] = field(default_factory=dict)

    @property
    def vars(self) -> list[str]:
        return list(self.always)


@dataclass
class Scope:
    """Which graphs patterns read: active None is the default graph."""

    default_graphs: list = field(default_factory=list)
    named_graphs: list = field(default_factory=list)
    restricted: bool = False
    active: A.Node | None = None

    def at(self, graph: A.Node) -> Scope:
        return Scope(self.default_graphs, self.named_graphs, self.restricted, graph)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _term_columns(prefix: str) -> list[Column]:
    """The columns of a quad's part: s, p, o or g."""
    if prefix == "o":
        o, d = F.col("o"), F.col("o_datatype")
        lang = F.when(F.col("o_dir").isNotNull(), F.concat("o_lang", F.lit("--"), "o_dir")).otherwise(F.col("o_lang"))
        return [o, F.col("o_kind"), d, lang, F.col("o_num"), X.parsed_instant(o, d), X.exact(o, d)]
    return _node(F.col(prefix), F.lit(IRI) if prefix == "p" else F.col(f"{prefix}_kind"))


def _node(v: Column, kind: Column) -> list[Column]:
    """The columns of a term that is no literal."""
    return [v, kind, X.null(), X.null(), X.no_number(), X.no_instant(), X.no_exact()]


class Compiler:
    def __init__(self, spark: SparkSession, source, base: str = ""):
        self.spark, self.source, self.base = spark, source, base
        self.now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.made = 0
        #: Variables that only a table's numeric column binds, with its datatype; None for all others met.
        self.numeric: dict[str, str | None] = {}

    def note(self, name: str, datatype: str | None) -> None:
        self.numeric[name] = datatype if self.numeric.get(name, datatype) == datatype else None

    def fresh(self, what: str) -> str:
        self.made += 1
        return f"#{what}{self.made}"

    def expressions(self, sol: Sol, exists=None) -> X.Expressions:
        return X.Expressions(set(sol.vars), self.now, self.base, exists, self.numeric)

    # Scans
    def scan(self, predicate: str | None, scope: Scope, bound: str = "") -> DataFrame:
        """Quads of the scope's graphs. bound: which of s and o a pattern binds."""
        g = scope.active
        q = self.source.scan(predicate, bound + ("" if isinstance(g, A.Var) or (g is None and not scope.restricted) else "g"))
        if g is None:
            if scope.restricted:
                return q.where(F.col("g").isin(scope.default_graphs)).withColumns({"g": F.lit(""), "g_kind": F.lit(DEFAULT)}).dropDuplicates(KEY) if scope.default_graphs else q.where(F.lit(False))
            return q.where(F.col("g_kind") == DEFAULT)
        q = q.where(F.col("g_kind") != DEFAULT)
        if scope.restricted:
            q = q.where(F.col("g").isin(scope.named_graphs)) if scope.named_graphs else q.where(F.lit(False))
        return q if isinstance(g, A.Var) else q.where(F.col("g") == g.value)

    def unit(self) -> Sol:
        return Sol(self.spark.range(1).select())

    def bind_quads(self, q: DataFrame, parts: list[tuple[str, A.Node]]) -> Sol:
        """Rows of quads as solutions: constants filter, variables name, repeated variables must agree."""
        picked: dict[str, str] = {}
        for part, x in parts:
            if isinstance(x, Term):
                q = q.where(pattern(**{part: x}))
            elif x.name in picked:
                a, b = _term_columns(picked[x.name]), _term_columns(part)
                q = q.where((a[0] == b[0]) & (a[1] == b[1]) & a[2].eqNullSafe(b[2]) & a[3].eqNullSafe(b[3]))
            else:
                picked[x.name] = part
        cols = [c.alias(column(v, p)) for v, part in picked.items() for c, p in zip(_term_columns(part), PARTS, strict=True)]
        for v in picked:
            self.note(v, None)
        kinds = {v: frozenset((IRI,)) if part in ("p", "g") else frozenset((IRI, BNODE)) if part == "s" else ANY for v, part in picked.items()}
        return Sol(q.select(*cols), dict.fromkeys(picked, True), kinds)

    def triple(self, t: A.Triple, scope: Scope) -> Sol:
        if isinstance(t.s, Term) and t.s.kind == LITERAL:
            return Sol(self.unit().df.where(F.lit(False)))
        if not isinstance(t.p, (A.Var, Term)):
            return self.path_triple(t, scope)
        predicate = t.p.value if isinstance(t.p, Term) else None
        parts = [("s", t.s), ("p", t.p), ("o", t.o)]
        if isinstance(scope.active, A.Var):
            parts.append(("g", scope.active))
        bound = "".join(n for n, x in (("s", t.s), ("o", t.o)) if isinstance(x, Term))
        return self.bind_quads(self.scan(predicate, scope, bound), parts)

    def bgp(self, triples: list[A.Triple], scope: Scope, start: Sol | None) -> Sol:
        """Patterns joined, the most constant first and then only what shares a variable, where there is any."""
        left = self.stars(triples, scope)
        sol = start
        bound = set(start.vars) if start else set()

        def names(t) -> set[str]:
            return {x.name for u in (t if isinstance(t, list) else [t]) for x in (u.s, u.p, u.o) if isinstance(x, A.Var)}

        def rank(t):
            constants = sum(w for u in (t if isinstance(t, list) else [t]) for x, w in ((u.s, 4), (u.o, 3), (u.p, 1)) if isinstance(x, Term))
            return (bool(names(t) & bound) or not bound, constants)

        while left:
            t = max(left, key=rank)
            left.remove(t)
            one = self.star(t, scope) if isinstance(t, list) else self.triple(t, scope)
            sol = one if sol is None else self.join(sol, one)
            bound |= names(t)
        return sol if sol is not None else self.unit()

    def stars(self, triples: list[A.Triple], scope: Scope) -> list:
        """Patterns, with those of one subject that one table of a virtual graph answers by a row put together."""
        if not isinstance(self.source, VirtualGraph) or scope.restricted:
            return list(triples)
        by: dict = {}
        rest: list = []
        for t in triples:
            plain = isinstance(t.p, Term) and not (isinstance(t.s, Term) and t.s.kind != IRI)
            (by.setdefault(t.s, []) if plain else rest).append(t)
        for group in by.values():
            types = {t.o.value for t in group if t.p.value == TYPE and isinstance(t.o, Term)}
            one = self.source.star([t.p.value for t in group], types)
            rest += [group] if one is not None else group
        return rest

    def star(self, triples: list[A.Triple], scope: Scope) -> Sol:
        """One projection of a table for all patterns of a subject."""
        types = {t.o.value for t in triples if t.p.value == TYPE and isinstance(t.o, Term)}
        m = self.source.star([t.p.value for t in triples], types)
        objects, df = m.objects(), m.table
        g, g_kind = m.graph_columns()
        if (m.graph is None) != (scope.active is None):
            df = df.where(F.lit(False))
        elif isinstance(scope.active, Term):
            df = df.where(m.is_graph(scope.active.value))
        ends: dict[str, list] = {}
        kinds: dict[str, frozenset] = {}

        def bind(x: A.Node, parts: list, kind: frozenset, number: str | None = None) -> None:
            nonlocal df
            if isinstance(x, A.Var):
                self.note(x.name, number)
            if isinstance(x, Term):
                c = X.constant(x)
                df = df.where((parts[0] == c.v) & (parts[1] == c.k) & parts[2].eqNullSafe(c.d) & parts[3].eqNullSafe(c.l))
            elif x.name in ends:
                o = ends[x.name]
                df = df.where((parts[0] == o[0]) & (parts[1] == o[1]) & parts[2].eqNullSafe(o[2]) & parts[3].eqNullSafe(o[3]))
            else:
                ends[x.name], kinds[x.name] = parts, kind

        if isinstance(triples[0].s, Term):
            df = df.where(m.is_subject(triples[0].s.value))
        else:
            bind(triples[0].s, _node(m.subject(), F.lit(IRI)), frozenset((IRI,)))
        for t in triples:
            c, v, kind, d, lang, n, when, exact, number = objects[t.p.value]
            if c is not None:
                df = df.where(F.col(c).isNotNull())
            if t.p.value == TYPE and isinstance(t.o, Term):
                continue
            bind(t.o, [v, F.lit(kind), d, lang, n, when, exact], frozenset((kind,)), number)
        if isinstance(scope.active, A.Var):
            bind(scope.active, _node(g, g_kind), frozenset((IRI,)))
        return Sol(df.select(*[x.alias(column(v, p)) for v, parts in ends.items() for x, p in zip(parts, PARTS, strict=True)]), dict.fromkeys(ends, True), kinds)

    # Joins
    def _beside(self, left: Sol, right: Sol) -> tuple[DataFrame, list[str], Column]:
        """The right table with shared variables renamed, these variables, and the condition that they agree."""
        shared = [v for v in left.vars if v in right.always]
        df = right.df.withColumnsRenamed({column(v, p): column(v, p) + "'" for v in shared for p in PARTS})
        conditions = []
        for v in shared:
            other = lambda p, v=v: F.col(f"`{column(v, p)}'`")
            same = ref(v, "v") == other("v")
            kl, kr = left.kinds.get(v, ANY), right.kinds.get(v, ANY)
            if len(kl | kr) > 1:
                same &= ref(v, "k") == other("k")
            if LITERAL in kl and LITERAL in kr:
                same &= ref(v, "d").eqNullSafe(other("d")) & ref(v, "l").eqNullSafe(other("l"))
            if not (left.always[v] and right.always[v]):
                same = ref(v, "v").isNull() | other("v").isNull() | same
            conditions.append(same)
        return df, shared, _all(conditions)

    def _merged(self, df: DataFrame, left: Sol, right: Sol, shared: list[str], keep_left: bool) -> Sol:
        cols, always, kinds = [], {}, {}
        for v in left.vars:
            always[v], kinds[v] = left.always[v], left.kinds.get(v, ANY)
            if v in shared and not left.always[v]:
                for p in PARTS:
                    cols.append(F.when(ref(v, "v").isNotNull(), ref(v, p)).otherwise(F.col(f"`{column(v, p)}'`")).alias(column(v, p)))
                always[v] = right.always[v] and not keep_left
                kinds[v] |= right.kinds.get(v, ANY)
            else:
                cols += [ref(v, p) for p in PARTS]
        for v in right.vars:
            if v not in shared:
                cols += [ref(v, p) for p in PARTS]
                always[v], kinds[v] = right.always[v] and not keep_left, right.kinds.get(v, ANY)
        return Sol(df.select(*cols), always, kinds)

    def join(self, left: Sol, right: Sol) -> Sol:
        other, shared, same = self._beside(left, right)
        df = left.df.join(other, same) if shared else left.df.crossJoin(other)
        return self._merged(df, left, right, shared, False)

    def left_join(self, left: Sol, right: Sol, filters: list) -> Sol:
        other, shared, same = self._beside(left, right)
        scope = Sol(left.df, {**left.always, **right.always})
        e = self.expressions(scope)
        df = left.df.join(other, _all([same, *(e.truth(f) for f in filters)]), "left_outer")
        return self._merged(df, left, right, shared, True)

    def minus(self, left: Sol, right: Sol) -> Sol:
        other, shared, same = self._beside(left, right)
        if not shared:
            return left
        if not all(left.always[v] and right.always[v] for v in shared):
            same &= reduce(lambda a, b: a | b, [ref(v, "v").isNotNull() & F.col(f"`{column(v, 'v')}'`").isNotNull() for v in shared])
        return Sol(left.df.join(other, same, "left_anti"), left.always, left.kinds)

    def exists(self, left: Sol, e: A.Exists, scope: Scope) -> Sol:
        group, outer = self._split(e.group, left, scope)
        right = self.group(group, scope)
        other, shared, same = self._beside(left, right)
        if outer:
            x = self.expressions(Sol(left.df, {**left.always, **right.always}))
            same = _all([same, *(x.truth(f) for f in outer)])
        how = "left_anti" if e.negated else "left_semi"
        return Sol(left.df.join(other, same, how), left.always, left.kinds)

    def _split(self, group: A.Group, left: Sol, scope: Scope) -> tuple[A.Group, list]:
        """A group without the filters that mention variables of the left side that it does not bind itself."""
        inside = self.group(A.Group(group.elements), scope).vars if group.filters else []
        outer = [f for f in group.filters if not isinstance(f, A.Exists) and (X.variables(f) - set(inside)) & set(left.vars)]
        return A.Group(group.elements, [f for f in group.filters if f not in outer]), outer

    def union(self, branches: list[Sol]) -> Sol:
        names = list(dict.fromkeys(v for b in branches for v in b.vars))
        frames = []
        for b in branches:
            frames.append(b.df.select(*[ref(v, p) if v in b.always else F.lit(None).cast(X.TYPES.get(p, "string")).alias(column(v, p)) for v in names for p in PARTS]))
        always = {v: all(b.always.get(v, False) for b in branches) for v in names}
        kinds = {v: frozenset().union(*(b.kinds.get(v, ANY) for b in branches if v in b.always)) for v in names}
        return Sol(reduce(DataFrame.unionAll, frames), always, kinds)

    # Groups
    def group(self, g: A.Group, scope: Scope) -> Sol:
        sol: Sol | None = None
        waiting: list[A.Triple] = []

        def flush() -> None:
            nonlocal sol, waiting
            if waiting:
                sol = self.bgp(waiting, scope, sol)
                waiting = []

        for e in g.elements:
            if isinstance(e, A.Triple):
                waiting.append(e)
                continue
            flush()
            now = sol if sol is not None else self.unit()
            if isinstance(e, A.Optional_):
                inner = [f for f in e.group.filters if isinstance(f, A.Exists) or self._has_exists(f)]
                right = self.group(A.Group(e.group.elements, inner), scope)
                sol = self.left_join(now, right, [f for f in e.group.filters if f not in inner])
            elif isinstance(e, A.Minus):
                sol = self.minus(now, self.group(e.group, scope))
            elif isinstance(e, A.Bind):
                if e.var in now.always:
                    raise ValueError(f"?{e.var} is bound already")
                sol = self.extend(now, e.var, e.expr)
            else:
                right = self.element(e, scope)
                sol = right if sol is None else self.join(sol, right)
        flush()
        sol = sol if sol is not None else self.unit()
        for f in g.filters:
            sol = self.filter(sol, f, scope)
        return sol

    def element(self, e, scope: Scope) -> Sol:
        if isinstance(e, A.Group):
            return self.group(e, scope)
        if isinstance(e, A.Union_):
            return self.union([self.group(b, scope) for b in e.branches])
        if isinstance(e, A.InGraph):
            inner = scope.at(e.graph)
            if not e.group.elements and isinstance(e.graph, A.Var):
                return self.bind_quads(self.scan(None, inner).select(*COLUMNS).dropDuplicates(["g"]), [("g", e.graph)])
            return self.group(e.group, inner)
        if isinstance(e, A.Values):
            return self.values(e)
        if isinstance(e, A.SubSelect):
            return self.select(e.query, scope)
        raise ValueError(f"unknown pattern {type(e).__name__}")

    def values(self, e: A.Values) -> Sol:
        schema = ", ".join(f"`{column(v, p)}` {X.TYPES.get(p, 'string')}" for v in e.vars for p in PARTS)
        rows = []
        for r in e.rows:
            row: list = []
            for t in r:
                if t is None:
                    row += [None] * len(PARTS)
                else:
                    lang = (f"{t.lang}--{t.dir}" if t.dir else t.lang) if t.kind == LITERAL else None
                    d = X.LANG_STRING if lang else t.datatype
                    row += [t.value, t.kind, d, lang, _python_number(t.value, d), None, None]
            rows.append(tuple(row))
        if not e.vars:
            return Sol(self.spark.range(len(rows)).select())
        always = {v: all(r[i] is not None for r in e.rows) for i, v in enumerate(e.vars)}
        df = self.spark.createDataFrame(rows, schema)
        df = df.withColumns({column(v, p): f(ref(v, "v"), ref(v, "d")) for v in e.vars for p, f in (("t", X.parsed_instant), ("e", X.exact))})
        for v in e.vars:
            self.note(v, None)
        return Sol(df, always, {v: ANY for v in e.vars})

    def extend(self, sol: Sol, name: str, expr) -> Sol:
        x = self.expressions(sol).build(expr)
        self.note(name, None)
        df = sol.df.withColumns({column(name, p): c for p, c in zip(PARTS, x.parts(), strict=True)})
        return Sol(df, {**sol.always, name: False}, {**sol.kinds, name: ANY})

    def _has_exists(self, e) -> bool:
        return isinstance(e, A.Exists) or (isinstance(e, A.Call) and any(map(self._has_exists, e.args)))

    def filter(self, sol: Sol, f, scope: Scope) -> Sol:
        if isinstance(f, A.Call) and f.name == "&&" and self._has_exists(f):
            for a in f.args:
                sol = self.filter(sol, a, scope)
            return sol
        if isinstance(f, A.Call) and f.name == "!" and isinstance(f.args[0], A.Exists):
            f = A.Exists(f.args[0].group, not f.args[0].negated)
        if isinstance(f, A.Exists):
            return self.exists(sol, f, scope)
        if self._has_exists(f):
            return self._flagged(sol, f, scope)
        return Sol(sol.df.where(self.expressions(sol).truth(f)), sol.always, sol.kinds)

    def _flagged(self, sol: Sol, f, scope: Scope) -> Sol:
        """A filter with EXISTS inside: each row is numbered, and what exists is joined back as a flag."""
        row = self.fresh("row")
        numbered = Sol(cut(sol.df.withColumn(row, F.monotonically_increasing_id())), sol.always, sol.kinds)
        df, flags = numbered.df, {}

        def walk(e):
            nonlocal df
            if isinstance(e, A.Exists):
                flag = self.fresh("flag")
                hit = self.exists(numbered, A.Exists(e.group, False), scope).df.select(row, F.lit(True).alias(flag))
                df = df.join(hit, row, "left")
                flags[id(e)] = F.coalesce(F.col(f"`{flag}`"), F.lit(False)) if not e.negated else ~F.coalesce(F.col(f"`{flag}`"), F.lit(False))
            elif isinstance(e, A.Call):
                for a in e.args:
                    walk(a)

        walk(f)
        x = X.Expressions(set(sol.vars), self.now, self.base, lambda e: flags[id(e)], self.numeric)
        out = df.where(x.truth(f)).select(*[ref(v, p) for v in sol.vars for p in PARTS])
        return Sol(out, sol.always, sol.kinds)

    # Paths: tables with the columns a|v.. and b|v.. of their ends, and g of the graph
    def path(self, p, scope: Scope) -> DataFrame:
        in_var = isinstance(scope.active, A.Var)
        graph = F.col("g") if in_var else F.lit("")
        if isinstance(p, (A.Link, A.Negated)) or (isinstance(p, Term)):
            if isinstance(p, A.Negated):
                q = self.scan(None, scope)
                forward = self._ends(q.where(~F.col("p").isin(list(p.forward))) if p.forward else q, graph)
                backward = self._swap(self._ends(q.where(~F.col("p").isin(list(p.backward))), graph)) if p.backward else None
                if not p.forward and backward is not None:
                    return backward
                return forward if backward is None else forward.unionByName(backward)
            return self._ends(self.scan(p.iri if isinstance(p, A.Link) else p.value, scope), graph)
        if isinstance(p, A.Inverse):
            return self._swap(self.path(p.path, scope))
        if isinstance(p, A.Sequence):
            return reduce(self._chain, [self.path(x, scope) for x in p.parts])
        if isinstance(p, A.Alternative):
            return reduce(DataFrame.unionByName, [self.path(x, scope) for x in p.parts])
        return self.closure(p, scope, graph)

    def _ends(self, q: DataFrame, graph: Column) -> DataFrame:
        cols = [c.alias(column("a", p)) for c, p in zip(_term_columns("s"), PARTS, strict=True)]
        cols += [c.alias(column("b", p)) for c, p in zip(_term_columns("o"), PARTS, strict=True)]
        return q.select(*cols, graph.alias("g"))

    def _swap(self, df: DataFrame) -> DataFrame:
        return df.select(*[ref("b", p).alias(column("a", p)) for p in PARTS], *[ref("a", p).alias(column("b", p)) for p in PARTS], "g")

    def _chain(self, left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({c: c + "'" for c in right.columns})
        other = lambda c: F.col(f"`{c}'`")
        same = (ref("b", "v") == other("a|v")) & (ref("b", "k") == other("a|k")) & ref("b", "d").eqNullSafe(other("a|d")) & ref("b", "l").eqNullSafe(other("a|l")) & (F.col("g") == other("g"))
        return left.join(right, same).select(*[ref("a", p) for p in PARTS], *[other(f"b|{p}").alias(column("b", p)) for p in PARTS], "g")

    def _nodes(self, scope: Scope, graph: Column) -> DataFrame:
        e = self._ends(self.scan(None, scope), graph)
        one = lambda end: e.select(*[ref(end, p).alias(column("a", p)) for p in PARTS], "g")
        n = one("a").unionByName(one("b")).dropDuplicates([column("a", p) for p in "vkdl"] + ["g"])
        return n.select(*[ref("a", p) for p in PARTS], *[ref("a", p).alias(column("b", p)) for p in PARTS], "g")

    def closure(self, p: A.Closure, scope: Scope, graph: Column, ends: tuple[Term | None, Term | None] = (None, None)) -> DataFrame:
        """Pairs of ends that one or more steps (or none, if zero) connect, each once.

        Each round joins the pairs found last with the steps and keeps what is new; it ends when nothing is. ends: the
        constant at the first or last end, from which alone the rounds then go out.
        """
        keys = [column(x, part) for x in "ab" for part in "vkdl"] + ["g"]
        step = self.path(p.path, scope).dropDuplicates(keys)
        if not p.many:
            return step.unionByName(self._nodes(scope, graph)).dropDuplicates(keys)
        step = cut(step)
        seen = frontier = step
        backward = ends[0] is None and ends[1] is not None
        for end, x in (("b", ends[1]),) if backward else (("a", ends[0]),):
            if x is not None:
                seen = frontier = step.where(self._is(end, x))
        rounds = 0
        while True:
            new = (self._chain(step, frontier) if backward else self._chain(frontier, step)).dropDuplicates(keys)
            old = seen.select(*[F.col(f"`{c}`").alias(c + "'") for c in keys])
            same = _all([F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}'`")) for c in keys])
            frontier = cut(new.join(old, same, "left_anti"))
            if frontier.isEmpty():
                break
            rounds += 1
            seen = seen.unionByName(frontier)
            if rounds % CUT_EVERY == 0:
                seen = cut(seen)
        if not p.zero:
            return seen
        nodes = self._nodes(scope, graph)
        for x in ends:
            nodes = nodes if x is None else nodes.where(self._is("a", x))
        return seen.unionByName(nodes).dropDuplicates(keys)

    def _is(self, end: str, x: Term) -> Column:
        c = X.constant(x)
        return (ref(end, "v") == c.v) & (ref(end, "k") == c.k) & ref(end, "d").eqNullSafe(c.d) & ref(end, "l").eqNullSafe(c.l)

    def path_triple(self, t: A.Triple, scope: Scope) -> Sol:
        if isinstance(t.p, A.Closure) and t.p.many:
            graph = F.col("g") if isinstance(scope.active, A.Var) else F.lit("")
            df = self.closure(t.p, scope, graph, tuple(x if isinstance(x, Term) else None for x in (t.s, t.o)))
        else:
            df = self.path(t.p, scope)
        if isinstance(t.p, A.Closure) and t.p.zero:  # a constant end reaches itself, whether in the graph or not
            consts = [x for x in (t.s, t.o) if isinstance(x, Term)]
            if consts and not isinstance(scope.active, A.Var):
                rows = []
                for x in consts:
                    c = X.constant(x)
                    rows.append(self.spark.range(1).select(*[v.alias(column(end, p)) for end in "ab" for v, p in zip(c.parts(), PARTS, strict=True)], F.lit("").alias("g")))
                df = reduce(DataFrame.unionByName, [df, *rows]).dropDuplicates([column(x, part) for x in "ab" for part in "vkdl"] + ["g"])
        picked: dict[str, str] = {}
        for end, x in (("a", t.s), ("b", t.o)):
            if isinstance(x, Term):
                df = df.where(self._is(end, x))
            elif x.name in picked:
                df = df.where((ref("a", "v") == ref("b", "v")) & (ref("a", "k") == ref("b", "k")) & ref("a", "d").eqNullSafe(ref("b", "d")) & ref("a", "l").eqNullSafe(ref("b", "l")))
            else:
                picked[x.name] = end
        cols = [ref(end, p).alias(column(v, p)) for v, end in picked.items() for p in PARTS]
        always = dict.fromkeys(picked, True)
        for v in picked:
            self.note(v, None)
        if isinstance(scope.active, A.Var):
            g = _node(F.col("g"), F.lit(IRI))
            cols += [c.alias(column(scope.active.name, p)) for c, p in zip(g, PARTS, strict=True)]
            always[scope.active.name] = True
        return Sol(df.select(*cols), always, {v: ANY for v in always})

    # Solution modifiers
    def aggregates_in(self, e, found: list) -> None:
        if isinstance(e, A.Aggregate):
            if e not in found:
                found.append(e)
        elif isinstance(e, A.Call):
            for a in e.args:
                self.aggregates_in(a, found)

    def aggregate(self, sol: Sol, a: A.Aggregate) -> list[Column]:
        """The columns of an aggregate, to be named by the caller."""
        if a.arg is None:
            n = F.count_distinct(F.struct(*[ref(v, p) for v in sol.vars for p in "vkdl"])) if a.distinct and sol.vars else F.count(F.lit(1))
            return list(X.integer(n).parts())
        x = self.expressions(sol).build(a.arg)
        term = F.when(x.v.isNotNull(), F.struct(x.v.alias("v"), x.k.alias("k"), x.d.alias("d"), x.l.alias("l")))
        if a.name == "COUNT":
            n = F.count_distinct(term) if a.distinct else F.count(x.v)
            return list(X.integer(n).parts())
        if a.name in ("SUM", "AVG"):
            return self._total(a, x)
        if a.name == "GROUP_CONCAT":
            v = F.collect_set(x.v) if a.distinct else F.collect_list(x.v)
            return list(X.string(F.array_join(F.array_sort(v), a.separator)).parts())
        known = self.numeric.get(a.arg.name) if isinstance(a.arg, A.Var) else None
        if known:  # a number needs no ordering of terms, and fits a hash aggregate
            best = (F.max if a.name == "MAX" else F.min)(x.n if x.lane == "double" else x.e)
            return list((X.numeric if x.lane == "double" else X.exact_number)(best, known).parts())
        key = F.when(x.v.isNotNull(), F.struct(*_order_key(x), x.v.alias("v"), x.k.alias("k"), x.d.alias("d"), x.l.alias("l"), x.n.alias("n")))
        best = F.max(key) if a.name == "MAX" else F.min(key)  # SAMPLE takes the smallest
        return [best[p] for p in PARTS]

    def _total(self, a: A.Aggregate, x: X.Ex) -> list[Column]:
        """SUM or AVG; exact if all that goes in is, and as doubles if one is a double."""
        double = None if x.lane == "exact" else F.sum_distinct(x.n) if a.distinct else F.sum(x.n)
        exact = None if x.lane == "double" else F.sum_distinct(x.exact()) if a.distinct else F.try_sum(x.exact())
        one = x.n if x.lane == "double" else x.exact() if x.lane == "exact" else F.when(x.n.isNotNull(), F.struct(x.n, x.exact()))
        many = F.count_distinct(one) if a.distinct else F.count(x.n)
        fine = F.count(x.v) == F.count(x.n)
        wide = F.when(F.max(x.d.isin(X.DOUBLE, X.XSD + "float")), X.DOUBLE).when(F.max(x.d == X.DECIMAL), X.DECIMAL).otherwise(X.INTEGER)
        if a.name == "AVG":
            wide = F.when(many == 0, X.INTEGER).when(wide == X.INTEGER, X.DECIMAL).otherwise(wide)
            double = None if double is None else F.when(many == 0, 0.0).otherwise(double / many)
            exact = None if exact is None else F.when(many == 0, F.lit(0).cast(X.EXACT)).otherwise(F.try_divide(exact, many.cast("decimal(20,0)")).try_cast(X.EXACT))
        if x.lane == "double":
            return list(X.numeric(F.when(fine, F.coalesce(double, F.lit(0.0))), wide).parts())
        exact = F.when(fine, F.when(F.count(x.n) == 0, F.lit(0).cast(X.EXACT)).otherwise(exact))
        if x.lane == "exact":
            return list(X.exact_number(exact, wide).parts())
        every = F.count(x.n) == F.count(x.exact())
        exact = F.when(every, exact)
        return list(X.either_number(exact, F.when(every, exact.cast("double")).otherwise(F.when(fine, double)), wide).parts())

    def grouped(self, q: A.Query, sol: Sol, found: list) -> tuple[Sol, dict]:
        keys, always, rename = [], {}, {}
        for name, e in q.group_by:
            v = name or self.fresh("key")
            x = self.expressions(sol).build(e)
            keys.append((v, x))
            always[v] = sol.always.get(e.name, False) if isinstance(e, A.Var) else False
            if name is None:
                rename[id(e)] = v
        cols = [c.alias(column(v, p)) for v, x in keys for c, p in zip(x.parts(), PARTS, strict=True) if p in "vkdl"]
        aggs = [F.first(c, ignorenulls=True).alias(column(v, p)) for v, x in keys for c, p in zip(x.parts(), PARTS, strict=True) if p not in "vkdl"]
        names = {}
        for a in found:
            name = self.fresh("agg")
            names[id(a)] = name
            aggs += [c.alias(column(name, p)) for c, p in zip(self.aggregate(sol, a), PARTS, strict=True)]
            always[name] = False
        df = sol.df.groupBy(*cols).agg(*(aggs or [F.count(F.lit(1)).alias("#n")]))
        return Sol(df, always, {v: ANY for v in always}), names

    def replaced(self, e, names: dict, found: list):
        if isinstance(e, A.Aggregate):
            return A.Var(names[id(next(a for a in found if a == e))])
        if isinstance(e, A.Call):
            return A.Call(e.name, [self.replaced(a, names, found) for a in e.args])
        return e

    def select(self, q: A.Query, scope: Scope) -> Sol:
        sol = self.group(q.where, scope)
        found: list = []
        for e in [e for _, e in q.select if e is not None] + q.having + [e for e, _ in q.order_by]:
            self.aggregates_in(e, found)
        chosen, having, order = q.select, q.having, q.order_by
        if q.group_by or found:
            sol, names = self.grouped(q, sol, found)
            chosen = [(n, None if e is None else self.replaced(e, names, found)) for n, e in chosen]
            having = [self.replaced(e, names, found) for e in having]
            order = [(self.replaced(e, names, found), up) for e, up in order]
        for e in having:
            sol = self.filter(sol, e, scope)
        for n, e in chosen:
            if e is not None:
                sol = self.extend(sol, n, e)
        names = [n for n, _ in chosen] or [v for v in sol.vars if not v.startswith((".", "#"))]
        return self.sliced(q, sol, names, order)

    def sliced(self, q: A.Query, sol: Sol, names: list[str], order: list) -> Sol:
        sol = Sol(sol.df, {**sol.always, **{n: False for n in names if n not in sol.always}}, sol.kinds)
        missing = {column(n, p): F.lit(None).cast(X.TYPES.get(p, "string")) for n in names for p in PARTS if column(n, p) not in sol.df.columns}
        df = sol.df.withColumns(missing) if missing else sol.df
        keys = []
        x = self.expressions(sol)
        for i, (e, up) in enumerate(order):
            for j, c in enumerate(_order_key(x.build(e))):
                name = f"#o{i}.{j}"
                df = df.withColumn(name, c)
                keys.append(F.col(f"`{name}`").asc_nulls_first() if up else F.col(f"`{name}`").desc_nulls_last())
        cols = [ref(n, p) for n in names for p in PARTS]
        if q.distinct or q.reduced:
            df = df.dropDuplicates([column(n, p) for n in names for p in "vkdl"]) if names else df.limit(1)
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Sol(df.select(*cols), {n: sol.always[n] for n in names}, {n: sol.kinds.get(n, ANY) for n in names})

    # Other forms
    def instantiate(self, sol: Sol, template: list[tuple[A.Node | None, A.Triple]], default_graph: str = "") -> DataFrame | None:
        """Quads of a template for every solution; those with an unbound or misplaced part are left out."""
        out = []
        mark = F.sha2(F.concat_ws("\x1f", *[F.coalesce(ref(v, p), F.lit("\x00")) for v in sol.vars for p in "vkdl"]), 256) if sol.vars else F.lit("0")

        def build(x: A.Node) -> X.Ex:
            if isinstance(x, Term):
                return X.constant(x)
            if x.name in sol.always:
                return X.var(x.name)
            if x.name.startswith("."):
                v = F.concat(F.lit("c"), F.substring(F.sha2(F.concat(mark, F.lit(x.name)), 256), 1, 24))
                return X.Ex(v, F.lit(BNODE), X.null(), X.null(), X.no_number())
            return X.unbound()

        for g, t in template:
            s, p, o = build(t.s), build(t.p), build(t.o)
            graph = X.constant(Term(IRI, default_graph)) if g is None and default_graph else build(g) if g is not None else None
            lang, direction = F.regexp_replace(o.l, "--.*$", ""), F.regexp_extract(o.l, "--(.*)$", 1)
            cols = {
                "s": s.v, "s_kind": s.k, "p": p.v, "o": o.v, "o_kind": o.k, "o_datatype": o.d, "o_lang": lang, "o_dir": F.when(direction != "", direction),
                "g": graph.v if graph else F.lit(""), "g_kind": graph.k if graph else F.lit(DEFAULT), "pk": p.k,
            }
            df = sol.df.select(*[c.alias(n) for n, c in cols.items()])
            out.append(df.where((F.col("pk") == IRI) & F.col("s_kind").isin(IRI, BNODE) & F.col("o").isNotNull() & F.col("g").isNotNull()).drop("pk"))
        return conform(reduce(DataFrame.unionByName, out)).dropDuplicates(KEY) if out else None

    def describe(self, q: A.Query, scope: Scope) -> DataFrame:
        """Quads of the resources as subjects, and of the blank nodes they lead to."""
        frames = []
        sol = self.group(q.where, scope)
        wanted = q.describe or [A.Var(v) for v in sol.vars if not v.startswith(".")]
        for x in wanted:
            if isinstance(x, Term):
                frames.append(self.spark.createDataFrame([(x.value, x.kind)], "s string, s_kind string"))
            elif x.name in sol.always:
                frames.append(sol.df.where(ref(x.name, "k").isin(IRI, BNODE)).select(ref(x.name, "v").alias("s"), ref(x.name, "k").alias("s_kind")))
        quads = self.scan(None, scope)
        found, at = None, reduce(DataFrame.unionByName, frames).distinct()
        seen = at
        while True:
            new = cut(quads.join(at, ["s", "s_kind"], "left_semi").select(*COLUMNS))
            found = new if found is None else found.unionByName(new)
            at = cut(new.where(F.col("o_kind") == BNODE).select(F.col("o").alias("s"), F.col("o_kind").alias("s_kind")).distinct().join(seen, ["s", "s_kind"], "left_anti"))
            if at.isEmpty():
                return found.dropDuplicates(KEY)
            seen = seen.unionByName(at)


def _order_key(x: X.Ex) -> list[Column]:
    """Unbound, blank nodes, IRIs, literals; then numbers and times by value; then the lexical form."""
    rank = F.when(x.v.isNull(), 0).when(x.k == BNODE, 1).when(x.k == IRI, 2).when(x.n.isNotNull(), 3).otherwise(4)
    return [rank.alias("r"), x.n.alias("m"), x.exact().alias("e"), X.instant(x).alias("t"), x.v.alias("w")]


def _python_number(value: str, datatype: str | None) -> float | None:
    if datatype not in X.NUMERIC:
        return None
    try:
        return float(value)
    except ValueError:
        return None

