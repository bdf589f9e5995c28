"""Terms: canonical lines, content ids, textual literals, labels."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions import labels as L
from quadrille.functions import terms as Q
from quadrille.operators.filters import Criteria, QuadFilter, filter_quads, match
from quadrille.sources import rdf

E = "http://example.org/"


def lines(spark, *quads):
    return [r.value for r in Q.quads_from(spark, quads).select(Q.canonical_nquads().alias("value")).collect()]


def test_golden_id(spark):
    q = Q.Quad(Q.iri(E + "s"), Q.iri(E + "p"), Q.literal("hello"))
    row = Q.hash_quads(Q.quads_from(spark, [q])).select("quad_id", Q.result_id().alias("hit")).first()
    assert row.quad_id == "q2.Qadou5ZTTT9v7Qasbsrp2FBsAs9ydKVk3D4x_96G-W8"
    assert row.hit == row.quad_id and len(row.quad_id) == 46


def test_lines(spark):
    s, p = Q.iri("urn:s"), Q.iri("urn:p")
    got = lines(
        spark,
        Q.Quad(s, p, Q.literal('a"b\\c\n\t\r\x01\x7fé')),
        Q.Quad(s, p, Q.literal("x", lang="ar", dir="rtl")),
        Q.Quad(s, p, Q.literal("1", Q.XSD + "integer"), Q.iri("urn:g")),
        Q.Quad(Q.bnode("b"), Q.iri("urn:a b<c>\\"), Q.bnode("c"), Q.bnode("g")),
        Q.Quad(s, p, Q.literal("x", Q.XSD_STRING)),
        Q.Quad(s, p, Q.literal("x", Q.XSD + "token", lang=" ")),
    )
    assert got == [
        '<urn:s> <urn:p> "a\\"b\\\\c\\n\\t\\r\\u0001\\u007Fé" .\n',
        '<urn:s> <urn:p> "x"@ar--rtl .\n',
        f'<urn:s> <urn:p> "1"^^<{Q.XSD}integer> <urn:g> .\n',
        "_:b <urn:a b\\u003Cc\\u003E\\\\> _:c _:g .\n",
        '<urn:s> <urn:p> "x" .\n',
        f'<urn:s> <urn:p> "x"^^<{Q.XSD}token> .\n',
    ]


def test_bad_terms(spark):
    s, p, o = Q.iri("urn:s"), Q.iri("urn:p"), Q.literal("o")
    for q in (Q.Quad(o, p, o), Q.Quad(s, o, o), Q.Quad(s, p, Q.Term("Variable", "x")), Q.Quad(Q.Term(Q.TRIPLE, "t"), p, o)):
        with pytest.raises(ValueError):
            Q.row(q)
    t = rdf.triple_term(s, p, o)
    df = Q.quads_from(spark, [Q.Quad(s, p, t)])
    with pytest.raises(Exception, match="no N-Quads form"):
        Q.hash_quads(df).collect()
    assert df.select(Q.quad_id().alias("i")).first().i.startswith("q2.")


def test_round_trip_of_objects(spark):
    quads = [Q.Quad(Q.bnode("b"), Q.iri("urn:p"), o, g) for o in (Q.literal("x"), Q.literal("x", lang="en"), Q.literal("1", Q.XSD + "int"), Q.iri("urn:o"), Q.literal("x", lang="he", dir="rtl")) for g in (Q.DEFAULT_GRAPH, Q.iri("urn:g"))]
    assert set(Q.quads_of(Q.quads_from(spark, quads))) == set(quads)


def test_textual(spark):
    s, p = Q.iri("urn:s"), Q.iri("urn:p")
    objects = [(Q.literal("x"), True), (Q.literal("x", Q.XSD_STRING), True), (Q.literal("x", lang="en"), True), (Q.iri("x"), False), *((Q.literal("1", Q.XSD + d), False) for d in ("integer", "boolean", "dateTime", "date")), (Q.literal("x", lang="ar", dir="rtl"), False)]
    df = Q.quads_from(spark, [Q.Quad(s, p, o) for o, _ in objects])
    assert [r.t for r in df.select(Q.textual().alias("t")).collect()] == [t for _, t in objects]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=8))
def test_escapes_agree_and_parse_back(spark, texts):
    quads = [Q.Quad(Q.iri("urn:s"), Q.iri("urn:p"), Q.literal(t)) for t in texts if "\x00" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    if quads:
        got = lines(spark, *quads)
        assert got == [f"<urn:s> <urn:p> {q.o} .\n" for q in quads]
        assert rdf.parse("".join(got)) == quads


@pytest.mark.parametrize(
    ("iri", "label"),
    [("", "unknown entity"), ("http://e.org/vocab#firstName", "first Name"), ("http://e.org/a/big_red-car", "big red car"), ("http://e.org/a/", "http://e.org/a/"), ("http://e.org/x#", "x#"), ("urn:thing", "urn:thing"), ("http://e.org/---", "---"), ("  http://e.org/q  ", "q")],
)
def test_labels(spark, iri, label):
    r = spark.createDataFrame([(iri,)], "i string").select(L.local_label(F.col("i")).alias("l"), L.predicate_phrase(F.col("i")).alias("p")).first()
    assert (r.l, r.p) == (label, label.lower())


def test_index_text(spark):
    chunks = spark.createDataFrame([("http://e.org/annLee", "http://e.org/worksFor", "", "a text"), ("urn:x", "urn:y", "", "")], "subject string, predicate string, graph string, value string")
    labels = spark.createDataFrame([("http://e.org/annLee", ["Ann", "", "A. Lee"])], "s string, labels array<string>")
    assert sorted(r.fts_value for r in L.index_text(chunks, labels).collect()) == ["ann Lee works for a text Ann A. Lee", "urn:x urn:y"]
    assert L.resolve_label_predicates([L.RDFS + "label", "urn:l", "urn:l"]) == [*L.DEFAULT_LABEL_PREDICATES, "urn:l"]


def test_filters(spark):
    quads = Q.quads_from(spark, [Q.Quad(Q.iri(s), Q.iri(p), Q.literal("o"), g) for s in ("urn:a", "urn:b") for p in ("urn:p", "urn:q") for g in (Q.DEFAULT_GRAPH, Q.iri("urn:g"))])
    n = lambda i=None, e=None: filter_quads(quads, QuadFilter(Criteria(**(i or {})), Criteria(**(e or {})))).count()
    assert (n(), n({"subjects": ["urn:a"]}), n({"subjects": []}), n({"subjects": ["urn:a"], "predicates": ["urn:p"]})) == (8, 4, 8, 2)
    assert (n(e={"subjects": ["urn:a"], "predicates": ["urn:p"]}), n({"graphs": [""]}), n({"graphs": ["urn:g"]}, {"predicates": ["urn:q"]}), n({"subjects": ["urn:z"]})) == (2, 4, 2, 0)
    many = [f"urn:{i}" for i in range(1500)] + ["urn:a"]
    assert (n({"subjects": many}), n(e={"subjects": many})) == (4, 4)
    assert match(quads, s="urn:a", g="").count() == 2
    assert match(quads, o=Q.literal("o", lang="en")).count() == 0


def test_numbers(spark):
    rows = [("12", "integer", 12.0), ("1.5", "integer", None), ("1.50", "decimal", 1.5), ("1e3", "double", 1000.0), ("INF", "double", float("inf")), ("x", "double", None), ("5", "string", None), (" 7 ", "int", 7.0)]
    df = spark.createDataFrame([(v, Q.XSD + d) for v, d, _ in rows], "v string, d string")
    assert [r.n for r in df.select(Q.number(F.col("v"), F.col("d")).alias("n")).collect()] == [n for *_, n in rows]


def test_lines_read_in_sql_and_by_the_parser_alike(spark, tmp_path):
    from quadrille.functions import terms as Q
    from quadrille.sources import rdf

    lines = [
        '<urn:a> <urn:p> <urn:b> .', '_:x <urn:p> _:y <urn:g> .', '<urn:a> <urn:p> "plain" .', '<urn:a> <urn:p> "" .', '<urn:a> <urn:p> "x"@en-GB <urn:g> .', '<urn:a> <urn:p> "x"@ar--rtl .',
        '<urn:a> <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .', '<urn:a> <urn:p> "s"^^<http://www.w3.org/2001/XMLSchema#string> _:g.', '  <urn:a>  <urn:p>\t"é 漢 # no comment" . ', '<urn:a> <urn:p> "q\\"uote\\n" .', '<urn:a> <urn:p> "u\\u00e9" <urn:g> .',
        '# a comment', '', '_:a.b <urn:p> "1.5"^^<http://www.w3.org/2001/XMLSchema#decimal> .', '<urn:a> <urn:p> "$1 \\\\ $2" .', '<urn:a> <urn:p> "costs $1 and $2" .', '<urn:a> <urn:p> "x" . # behind',
    ]
    (tmp_path / "x.nq").write_text("\n".join(lines), encoding="utf-8")
    got = rdf.read_lines(spark, str(tmp_path / "x.nq"))
    assert got.columns == Q.COLUMNS
    want = [Q.row(x) for t in lines if t.strip() and not t.startswith("#") for x in rdf.Parser(t).parse()]
    key = lambda r: tuple(x or "" for x in r)
    assert sorted((tuple(r)[:10] for r in got.collect()), key=key) == sorted(want, key=key)
    assert sum(r.o_num is not None for r in got.collect()) == 2
    assert "PythonMapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
