"""The whole session: import, search, SPARQL, export, on small graphs of every kind."""

import pytest

from quadrille.functions.terms import RDF, XSD, Quad, bnode, iri, literal
from quadrille.session import GraphSession
from quadrille.tools import create_tools

GRAPHS = f"""
<urn:ann> <urn:likes> "rowing"@en .
<urn:ann> <urn:age> "42"^^<{XSD}integer> .
<urn:ann> <urn:posted> "ann wrote an open note" <urn:g:open> .
<urn:ben> <urn:posted> "ben is open too" <urn:g:open> .
<urn:ann> <urn:keeps> "hidden key material of ann" <urn:g:closed> .
"""
PEOPLE = """
@prefix s: <http://schema.org/> .
<urn:ann> a s:Person ; s:name "Ann" ; s:knows <urn:ben> .
<urn:ben> a s:Person ; s:name "Ben" ; s:worksFor <urn:acme> .
<urn:acme> a s:Organization ; s:name "Acme Corp" .
"""


def load(spark, text, mode="merge"):
    s = GraphSession.in_memory(spark)
    s.import_({"kind": "serialized", "data": text}, mode)
    return s


def rows(result):
    return [{k: v["value"] for k, v in b.items()} for b in result.bindings()]


@pytest.fixture(scope="module")
def graphs(spark):
    return load(spark, GRAPHS)


@pytest.fixture(scope="module")
def people(spark):
    return load(spark, PEOPLE)


def test_graph_sizes(graphs):
    assert {r.g: r.n for r in graphs.store.graph_sizes().collect()} == {"": 2, "urn:g:open": 2, "urn:g:closed": 1}


@pytest.mark.parametrize(
    ("query", "options", "hits"),
    [
        ("ann", {}, 2),
        ("hidden", {"top_k": 10}, 1),
        ("OPEN", {"include": {"graphs": ["urn:g:open"]}}, 2),
        ("", {}, 4),
        ("42", {}, 0),
        ("note", {"exclude": {"predicates": ["urn:posted"]}}, 0),
        ("row", {"include": {"graphs": [""]}}, 1),
        ("%", {}, 0),
    ],
)
def test_scan(graphs, query, options, hits):
    found = graphs.search(query, **options).collect()
    assert len(found) == hits
    assert all(r.score == 1.0 and r.id.startswith("q2.") for r in found)


def test_graph_patterns(graphs):
    q = graphs.sparql
    assert rows(q("SELECT ?s WHERE { GRAPH <urn:g:closed> { ?s ?p ?o } }")) == [{"s": "urn:ann"}]
    assert q("ASK { GRAPH <urn:g:open> { <urn:ben> ?p ?o } }").boolean
    assert rows(q("SELECT ?s { GRAPH <urn:g:closed> { ?s <urn:keeps> ?kept } GRAPH <urn:g:open> { ?s <urn:posted> ?note } }")) == [{"s": "urn:ann"}]
    total = q("SELECT (COUNT(*) AS ?c) { { GRAPH ?where { ?a ?b ?d } } UNION { ?a ?b ?d } }").bindings()
    assert total == [{"c": {"type": "literal", "value": "5", "datatype": XSD + "integer"}}]
    assert sorted(r["g"] for r in rows(q("SELECT DISTINCT ?g { GRAPH ?g { } }"))) == ["urn:g:closed", "urn:g:open"]
    assert len(rows(q("SELECT * FROM <urn:g:open> FROM <urn:g:closed> { ?s ?p ?o }"))) == 3
    assert len(rows(q("SELECT * FROM NAMED <urn:g:open> { GRAPH ?g { ?s ?p ?o } }"))) == 2
    assert q("SELECT ?o { ?s <urn:likes> ?o FILTER(LANG(?o) = 'en') }").bindings() == [{"o": {"type": "literal", "value": "rowing", "xml:lang": "en"}}]


def test_people(people):
    q = people.sparql
    p = "PREFIX s: <http://schema.org/> "
    assert rows(q(p + 'SELECT ?n ?org { ?a s:name "Ann" ; s:knows ?b . ?b s:name ?n ; s:worksFor ?o . ?o s:name ?org }')) == [{"n": "Ben", "org": "Acme Corp"}]
    assert q(p + "ASK { <urn:ann> s:knows <urn:ben> }").boolean
    found = rows(q(p + 'SELECT ?n ?org { ?x a s:Person ; s:name ?n . OPTIONAL { ?x s:worksFor ?o . ?o s:name ?org } FILTER(CONTAINS(LCASE(?n), "n")) } ORDER BY ?n'))
    assert found == [{"n": "Ann"}, {"n": "Ben", "org": "Acme Corp"}]
    assert people.reindex() == {"processed_quad_count": 8, "chunk_row_count": 0}
    assert len(people.search("acme").collect()) == 1
    hit = people.search("Ann").select("subject")
    assert rows(q(f"SELECT ?k {{ <{hit.first().subject}> <http://schema.org/knows> ?k }}")) == [{"k": "urn:ben"}]


def test_empty(spark):
    s = GraphSession.in_memory(spark)
    assert not s.sparql("ASK { ?s ?p ?o }").boolean
    assert s.search("anything").collect() == []
    assert s.export({"kind": "serialized"}) == {"kind": "serialized", "data": "", "content_type": "application/n-quads"}
    assert rows(s.sparql("SELECT (COUNT(*) AS ?c) (SUM(?x) AS ?t) { ?s ?p ?x }")) == [{"c": "0", "t": "0"}]


def test_sessions_are_apart(spark, people):
    other = GraphSession.in_memory(spark)
    assert other.store.size() == 0


def test_not_configured():
    s = GraphSession()
    for call, text in ((lambda: s.import_({}), "Quad store"), (lambda: s.export(), "Quad store"), (lambda: s.sparql("ASK {}"), "SPARQL engine"), (lambda: s.search("x"), "Search index"), (lambda: s.reindex(), "Search index")):
        with pytest.raises(RuntimeError, match=f"{text} is not configured"):
            call()


def test_round_trip(spark):
    text = GRAPHS + '_:b <urn:says> "q\\tz \\"b\\" \\\\ w\\nd" _:g .\n<urn:x> <urn:y> "hello"@ar--rtl .\n'
    s = load(spark, text)
    for kind in ("application/n-quads", "text/turtle"):
        out = s.export({"kind": "serialized", "content_type": kind})["data"]
        again = load(spark, out)
        assert again.export({"kind": "serialized", "content_type": kind})["data"] == out
        assert again.store.size() == 7
    odd = s.export({"kind": "serialized", "content_type": "text/turtle; charset=utf-8"})
    assert odd["content_type"] == "text/turtle; charset=utf-8"
    assert odd["data"].count(" .\n") == 7
    with pytest.raises(ValueError, match="Invalid format requested"):
        s.export({"kind": "other"})


def test_modes(spark):
    one = {"kind": "quads", "quads": [Quad(iri("urn:a"), iri("urn:p"), literal("1"))]}
    two = {"kind": "dataset", "dataset": [Quad(bnode("b"), iri("urn:p"), bnode("c"), bnode("g"))]}
    s = GraphSession.in_memory(spark)
    s.import_(one)
    s.import_(one)
    assert s.store.size() == 1
    s.import_(two)
    assert s.store.size() == 2
    s.import_(two, "replace")
    assert s.store.size() == 1
    s.import_({"kind": "quads", "quads": []}, "replace")
    assert s.store.size() == 1  # replacing with nothing changes nothing
    with pytest.raises(ValueError):
        s.import_({"kind": "serialized", "data": "no rdf at all"}, "replace")
    assert s.store.size() == 1
    with pytest.raises(ValueError, match="Unsupported import source kind"):
        s.import_({"kind": "other"})
    s.store.clear()
    assert s.store.size() == 0


def test_reified(spark):
    s = load(spark, '<< <urn:ann> <urn:likes> <urn:rowing> >> <urn:claims> "yes" .\n<urn:ann> <urn:notes> "a diary" .')
    assert s.store.size() == 3
    assert rows(s.sparql("SELECT ?o { << <urn:ann> <urn:likes> <urn:rowing> >> <urn:claims> ?o }")) == [{"o": "yes"}]
    assert rows(s.sparql("SELECT ?who ?o { << ?who <urn:likes> <urn:rowing> >> <urn:claims> ?o }")) == [{"who": "urn:ann", "o": "yes"}]
    assert rows(s.sparql(f"SELECT (SUBJECT(?t) AS ?s) (isTRIPLE(?t) AS ?y) {{ ?r <{RDF}reifies> ?t }}")) == [{"s": "urn:ann", "y": "true"}]


def test_typed(spark):
    s = load(spark, f'<urn:i> <urn:l> "Gadget", "x"^^<{XSD}string> . <urn:i> <urn:c> 42 . <urn:i> <urn:w> 1.5e0 . <urn:i> <urn:d> "2024-02-29"^^<{XSD}date> . <urn:i> <urn:on> true . <urn:i> <urn:hi> "مرحبا"@ar .')
    assert s.sparql("SELECT ?o { <urn:i> <urn:c> ?o }").bindings() == [{"o": {"type": "literal", "value": "42", "datatype": XSD + "integer"}}]
    assert s.sparql("ASK { <urn:i> <urn:on> true }").boolean
    assert rows(s.sparql('SELECT ?o { <urn:i> <urn:hi> ?o FILTER(LANG(?o) = "ar") }')) == [{"o": "مرحبا"}]
    assert [r.text for r in s.search("مرحبا").collect()] == ["مرحبا"]
    assert s.search("42").collect() == []


def test_tools(spark):
    t = create_tools(GraphSession.in_memory(spark), allow_updates=False)
    assert t["import"](data=PEOPLE) == {"success": True}
    assert len(t["search"](query="acme")["results"]) == 1
    assert t["sparql"](query="ASK { ?s ?p ?o }") == {"success": True, "kind": "ask", "data": {"head": {}, "boolean": True}}
    assert "allowed" in t["sparql"](query="INSERT DATA { <urn:a> <urn:b> <urn:c> }")["error"]
    assert t["sparql"](query='SELECT ?s { ?s ?p "INSERT" }')["success"]
    assert "urn:acme" in t["export"]()["data"]
    assert not t["import"](data="nonsense")["success"]
