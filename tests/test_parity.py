"""The harness passes a right session, and finds faults in wrong ones."""

import pytest

from quadrille.operators.search import fixed
from quadrille.parity import CORPUS, DECLARED, Fixture, run_parity
from quadrille.session import ChunkIndex, GraphSession


def test_two_sessions_agree(spark):
    r = run_parity(lambda: GraphSession.in_memory(spark), lambda: GraphSession.in_memory(spark), ordered=True)
    assert r.passed and not r.notes and len(r.cases) > 25


class Wrapped(GraphSession):
    pass


@pytest.mark.parametrize("fault", ["order", "extra"])
def test_faults_are_found(spark, fault):
    def wrong():
        s = GraphSession.in_memory(spark)
        w = Wrapped(s.store, s.engine, s.index)
        if fault == "order":
            w.search = lambda query, **k: s.search(query, **k).orderBy("id", ascending=query != "ann")
        else:
            w.import_ = lambda source, mode="merge": s.import_({**source, "data": source["data"] + "\n<urn:stray> <urn:p> <urn:q> ."}, mode)
        return w

    def right():
        s = GraphSession.in_memory(spark)
        w = Wrapped(s.store, s.engine, s.index)
        w.search = lambda query, **k: s.search(query, **k).orderBy("id")
        return w

    assert not run_parity(wrong, right, CORPUS[:1], [], ordered=True).passed


def test_declared_fixture_only_notes(spark):
    f = Fixture("broken", "not rdf", {"": 1}, gate=DECLARED)
    g = Fixture("wrong count", "<urn:a> <urn:b> <urn:c> .", {"": 2}, gate=DECLARED)
    r = run_parity(lambda: GraphSession.in_memory(spark), None, [f, g], [])
    assert r.passed and len(r.notes) == 3


def test_chunked_index_finds_the_same_subjects(spark):
    def chunked():
        s = GraphSession.in_memory(spark)
        return GraphSession(s.store, s.engine, ChunkIndex(s.store, splitter=fixed(1000)))

    f = next(f for f in CORPUS if f.name == "long literal")
    s = chunked()
    s.import_({"kind": "serialized", "data": f.data})
    assert {r.subject for r in s.search("turquoise").collect()} == {"urn:long"}
    assert s.search("needle").count() == 1
