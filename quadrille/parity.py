"""Checks that a session answers as its fixtures say, and as another session does."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from quadrille.functions.terms import XSD, XSD_STRING
from quadrille.session import GraphSession

REQUIRED, DECLARED = "required", "declared"


@dataclass
class SearchCase:
    name: str
    request: dict
    hits: int | None = None


@dataclass
class SparqlCase:
    """expected: a list of bindings, a boolean, or None to compare the sessions only."""

    name: str
    query: str
    expected: list | bool | None = None


@dataclass
class Fixture:
    """gate declared: failures are reported as notes and fail nothing."""

    name: str
    data: str
    graph_sizes: dict[str, int]
    search: list[SearchCase] = field(default_factory=list)
    sparql: list[SparqlCase] = field(default_factory=list)
    gate: str = REQUIRED


@dataclass
class ReplaceCase:
    name: str
    first: str
    second: str
    count: int


@dataclass
class CaseResult:
    fixture: str
    check: str
    passed: bool
    note: str = ""


@dataclass
class Report:
    cases: list[CaseResult]

    @property
    def passed(self) -> bool:
        return all(c.passed for c in self.cases)

    @property
    def notes(self) -> list[str]:
        return [f"{c.fixture}, {c.check}: {c.note}" for c in self.cases if c.note]


def binding_key(b: dict) -> tuple:
    """A solution to compare by: xsd:string is the plain literal."""
    return tuple(sorted((v, t["type"], t["value"], t.get("xml:lang", ""), "" if t.get("datatype") == XSD_STRING else t.get("datatype", "")) for v, t in b.items()))


def answer(session: GraphSession, query: str):
    r = session.sparql(query)
    return r.boolean if r.kind == "ask" else Counter(map(binding_key, r.bindings()))


def hits(session: GraphSession, request: dict) -> list[tuple]:
    return [(r.id, r.subject, r.predicate, r.graph, r.text) for r in session.search(**request).collect()]


def run_parity(make: Callable[[], GraphSession], reference: Callable[[], GraphSession] | None = None, fixtures: list[Fixture] | None = None, replace: list[ReplaceCase] | None = None, ordered: bool = False) -> Report:
    """Run the fixtures through new sessions. ordered: search hits must come in the same order from both."""
    cases: list[CaseResult] = []

    for f in CORPUS if fixtures is None else fixtures:

        def check(name: str, test: Callable[[], bool], f=f) -> None:
            try:
                passed, note = bool(test()), ""
            except Exception as e:
                passed, note = False, f"{type(e).__name__}: {e}"[:300]
            if not passed and f.gate == DECLARED:
                passed, note = True, note or "differs"
            cases.append(CaseResult(f.name, name, passed, note if passed else note or "differs"))

        source = {"kind": "serialized", "data": f.data}
        a, b = make(), reference() if reference else None
        loaded = True
        for s in (a, b):
            if s is not None:
                try:
                    s.import_(source)
                except Exception as e:
                    loaded = False
                    cases.append(CaseResult(f.name, "import", f.gate == DECLARED, str(e)[:300]))
        if not loaded:
            continue
        check("count", lambda: a.store.size() == sum(f.graph_sizes.values()))
        check("graph sizes", lambda: {r.g: r.n for r in a.store.graph_sizes().collect()} == {g: n for g, n in f.graph_sizes.items() if n})

        def round_trip() -> bool:
            text = a.export({"kind": "serialized"})["data"]
            c = make()
            c.import_({"kind": "serialized", "data": text})
            return c.export({"kind": "serialized"})["data"] == text

        check("round trip", round_trip)
        if b is not None:
            check("same export", lambda: a.export({"kind": "serialized"})["data"] == b.export({"kind": "serialized"})["data"])
        for s in f.search:
            order = (lambda x: x) if ordered else sorted
            check(f"search {s.name}", lambda s=s, order=order: (s.hits is None or len(hits(a, s.request)) == s.hits) and (b is None or order(hits(a, s.request)) == order(hits(b, s.request))))
        for q in f.sparql:

            def same(q=q) -> bool:
                got = answer(a, q.query)
                want = Counter(map(binding_key, q.expected)) if isinstance(q.expected, list) else q.expected
                return (want is None or got == want) and (b is None or got == answer(b, q.query))

            check(f"sparql {q.name}", same)
    for r in REPLACE if replace is None else replace:
        s = make()
        for text in (r.first, r.second):
            s.import_({"kind": "serialized", "data": text}, "replace")
        cases.append(CaseResult(r.name, "replace", s.store.size() == r.count))
    return Report(cases)


def _iri(v: str) -> dict:
    return {"type": "uri", "value": v}


def _lit(v: str, **more: str) -> dict:
    return {"type": "literal", "value": v, **more}


CORPUS = [
    Fixture(
        "graphs",
        f'<urn:ann> <urn:likes> "rowing"@en .\n<urn:ann> <urn:age> "42"^^<{XSD}integer> .\n<urn:ann> <urn:wrote> "ann: an open note" <urn:g:open> .\n<urn:ben> <urn:wrote> "ben is open too" <urn:g:open> .\n<urn:ann> <urn:keeps> "what ann hides" <urn:g:shut> .',
        {"": 2, "urn:g:open": 2, "urn:g:shut": 1},
        [SearchCase("everywhere", {"query": "ann"}, 2), SearchCase("in one graph", {"query": "hides", "top_k": 5}, 1), SearchCase("scoped", {"query": "open", "top_k": 10, "include": {"graphs": ["urn:g:open"]}}, 2)],
        [
            SparqlCase("named graph", "SELECT ?s { GRAPH <urn:g:shut> { ?s ?p ?o } }", [{"s": _iri("urn:ann")}]),
            SparqlCase("ask", "ASK { GRAPH <urn:g:open> { <urn:ben> ?p ?o } }", True),
            SparqlCase("across graphs", "SELECT ?s { GRAPH <urn:g:open> { ?s <urn:wrote> ?o } GRAPH <urn:g:shut> { ?s <urn:keeps> ?x } }", [{"s": _iri("urn:ann")}]),
            SparqlCase("count of all", "SELECT (COUNT(*) AS ?n) { { GRAPH ?where { ?a ?b ?c } } UNION { ?a ?b ?c } }", [{"n": _lit("5", datatype=XSD + "integer")}]),
        ],
    ),
    Fixture(
        "typed literals",
        f'<urn:i> <urn:label> "Gadget" .\n<urn:i> <urn:hello> "Hello"@en .\n<urn:i> <urn:hello> "Hola"@es .\n<urn:i> <urn:hello> "مرحبا"@ar .\n<urn:i> <urn:n> "42"^^<{XSD}integer> .\n<urn:i> <urn:w> "1.5"^^<{XSD}double> .\n<urn:i> <urn:day> "2024-02-29"^^<{XSD}date> .\n<urn:i> <urn:on> "true"^^<{XSD}boolean> .',
        {"": 8},
        [SearchCase("label", {"query": "gadget"}, 1), SearchCase("right to left", {"query": "مرحبا"}, 1), SearchCase("number", {"query": "42"}, 0)],
        [
            SparqlCase("by language", 'SELECT ?o { <urn:i> <urn:hello> ?o FILTER(LANGMATCHES(LANG(?o), "AR")) }', [{"o": _lit("مرحبا", **{"xml:lang": "ar"})}]),
            SparqlCase("datatype stays", "SELECT ?o { <urn:i> <urn:n> ?o }", [{"o": _lit("42", datatype=XSD + "integer")}]),
            SparqlCase("boolean term", "ASK { <urn:i> <urn:on> true }", True),
        ],
    ),
    Fixture(
        "reified triple",
        '<< <urn:ann> <urn:likes> <urn:rowing> >> <urn:claims> "yes" .\n<urn:ann> <urn:notes> "a diary" .',
        {"": 3},
        sparql=[SparqlCase("quoted pattern", "SELECT ?o { << <urn:ann> <urn:likes> <urn:rowing> >> <urn:claims> ?o }", [{"o": _lit("yes")}])],
        gate=DECLARED,
    ),
    Fixture("long literal", '<urn:long> <urn:body> "' + "turquoise water under a pale sky and more. " * 35 + '" .\n<urn:other> <urn:about> "needle" .', {"": 2}, [SearchCase("long", {"query": "turquoise"}), SearchCase("short", {"query": "needle", "top_k": 5}, 1)]),
    Fixture("empty", "", {"": 0}, [SearchCase("nothing", {"query": "anything"}, 0)], [SparqlCase("ask", "ASK { ?s ?p ?o }", False)]),
]
REPLACE = [ReplaceCase("replace twice", "<urn:a> <urn:p> 1 , 2 .", "<urn:b> <urn:p> 3 .", 1)]
