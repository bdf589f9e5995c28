"""Stores and transactions."""

import pytest

from quadrille.functions.terms import KEY, Quad, bnode, iri, literal, quads_from
from quadrille.operators.store import ConcurrentCommit, Context, Patch, QuadStore, Transaction, TransactionalStore, cancel
from quadrille.streaming.ingest import ingest, read_stream


def q(i, g=""):
    from quadrille.functions.terms import DEFAULT_GRAPH

    return Quad(iri(f"urn:{i}"), iri("urn:p"), literal(str(i)), iri(g) if g else DEFAULT_GRAPH)


def ids(store):
    return sorted(r.s for r in store.quads().collect())


def test_cancel_is_one_for_one(spark):
    p = cancel(quads_from(spark, [q(1), q(1), q(2)]), quads_from(spark, [q(1), q(3)]))
    assert sorted(r.s for r in p.insertions.collect()) == ["urn:1", "urn:2"]
    assert [r.s for r in p.deletions.collect()] == ["urn:3"]


def test_same_quad_added_and_removed_is_neither(spark):
    s = QuadStore(spark)
    s.transaction().delete(q(1)).add(q(1)).commit()
    assert s.size() == 0
    s.transaction().add([q(1), q(2)]).commit()
    s.transaction().delete(q(1)).add(q(3)).commit()
    assert ids(s) == ["urn:2", "urn:3"]


def test_removal_sees_the_store_not_the_buffer(spark):
    s = QuadStore(spark)
    s.transaction().add([q(1, "urn:g"), q(2)]).commit()
    s.transaction().add(q(3, "urn:g")).delete_graph("urn:g").commit()
    assert ids(s) == ["urn:2", "urn:3"]


def test_unseen_until_commit(spark):
    s = QuadStore(spark)
    t = TransactionalStore(s).add(q(1))
    assert not t.has(q(1)) and t.size == 0
    t.commit()
    assert t.has(q(1)) and t.size == 1
    t.delete(q(1))
    t.rollback()
    t.commit()
    assert t.size == 1


def test_failed_commit_keeps_buffers(spark):
    calls = []

    def refuse(patch, context):
        calls.append(context)
        raise OSError("no")

    t = Transaction(spark, refuse).add(q(1))
    with pytest.raises(OSError):
        t.commit(Context("merge"))
    assert t.insertions is not None and calls[0].is_import() and not calls[0].is_replace()
    t.rollback()
    t.commit()
    assert len(calls) == 1  # nothing to commit


def test_override_gets_the_patch(spark):
    got = []
    s = QuadStore(spark, commit=lambda patch, context: got.append((patch, context)))
    s.import_({"kind": "quads", "quads": [q(1)]}, "replace")
    assert got[0][0].insertions.count() == 1 and got[0][1].is_replace()


def test_snapshots_stay_readable(spark):
    s = QuadStore(spark)
    s.transaction().add(q(1)).commit()
    old = s.quads()
    s.transaction().add(q(2)).commit()
    assert old.count() == 1 and s.size() == 2


def test_set_semantics_with_nulls_and_blank_nodes(spark):
    s = QuadStore(spark)
    quads = [Quad(bnode("b"), iri("urn:p"), bnode("c"), bnode("g")), q(1)]
    for _ in range(2):
        s.import_({"kind": "quads", "quads": quads + quads})
    assert s.size() == 2 and s.quads().select(*KEY).distinct().count() == 2
    s.transaction().delete(quads[0]).commit()
    assert s.size() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<urn:1> <urn:p> "a" .\n# note\n\n<urn:2> <urn:p> "b"@en <urn:g> .\n')
    (tmp_path / "a.ttl").write_text('@prefix x: <urn:> .\nx:3 x:p "a", [ x:q 1 ] .\n')
    s = QuadStore(spark)
    s.import_({"kind": "serialized", "path": str(tmp_path / "a.nq"), "content_type": "application/n-quads"})
    s.import_({"kind": "serialized", "path": str(tmp_path / "a.ttl"), "content_type": "text/turtle"})
    assert s.size() == 5


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.nq").write_text('<urn:1> <urn:p> "a" .\n<urn:2> <urn:p> "b" .\n')
    s = QuadStore(spark)
    for _ in range(2):
        ingest(read_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "check")).awaitTermination()
        (tmp_path / "in" / "2.nq").write_text('<urn:2> <urn:p> "b" .\n<urn:3> <urn:p> "c" .\n')
    assert ids(s) == ["urn:1", "urn:2", "urn:3"]


def test_a_small_commit_does_not_shuffle_the_base(spark, monkeypatch):
    s = QuadStore(spark)
    s.transaction().add([q(i) for i in range(50)]).commit()
    base = s.state()["base"]
    s.transaction().delete([q(3), q(99)]).add([q(5), q(60)]).commit()
    s.transaction().delete([q(60)]).add([q(3), q(61, "urn:g")]).commit()
    assert s.state()["base"] == base and s.state()["rows"] == 3
    assert ids(s) == sorted(f"urn:{i}" for i in [*range(50), 61])
    plan = s.quads()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    s.compact()
    assert s.state()["base"] != base and s.state()["rows"] == 0 and s.size() == 51
    monkeypatch.setattr("quadrille.operators.store.DELTA_ROWS", 2)
    base = s.state()["base"]
    s.transaction().add([q(i) for i in range(70, 75)]).commit()
    assert s.state()["base"] != base and s.size() == 56


def test_commits_equal_a_plain_set(spark):
    import random

    r, s, have = random.Random(2), QuadStore(spark), set()
    for _ in range(6):
        new, gone = ([q(i) for i in r.sample(range(12), 4)] for _ in range(2))
        s.apply(Patch(quads_from(spark, new), quads_from(spark, gone)))
        have = (have - {x.s.value for x in gone}) | {x.s.value for x in new}
        got = ids(s)
        assert got == sorted(have)


def test_the_second_of_two_writers_fails(spark):
    a = QuadStore(spark)
    a.transaction().add(q(1)).commit()
    b = QuadStore(spark, a.folder)
    old = b.state()
    a.transaction().add(q(2)).commit()
    with pytest.raises(ConcurrentCommit):
        b._commit(old, {"base": old["base"], "orderings": old["orderings"], "added": None, "removed": None, "rows": 0})
    assert ids(b) == ["urn:1", "urn:2"]
    # A pointer that lags behind is no harm
    a.files.write(a.pointer, __import__("json").dumps(old))
    assert ids(b) == ["urn:1", "urn:2"]


def test_orderings(spark):
    s = QuadStore(spark, orderings=("pso", "ospg", "gpso"))
    s.transaction().add([q(i, "urn:g" if i % 2 else "") for i in range(6)]).commit()
    state = s.state()
    assert [s._ordering(state, x) for x in ("p", "ps", "o", "os", "g", "gp", "")] == ["pso", "pso", "ospg", "ospg", "gpso", "gpso", "pso"]
    assert [r.s for r in s.match(o=literal("3")).collect()] == ["urn:3"]
    assert s.match(g="urn:g").count() == 3
    with pytest.raises(ValueError):
        QuadStore(spark, orderings=("xyz",))


def test_guard_stops_a_commit(spark):
    s = QuadStore(spark)

    def refuse():
        raise TimeoutError("late")

    s.guard = refuse
    with pytest.raises(TimeoutError):
        s.transaction().add(q(1)).commit()
    assert s.size() == 0


@pytest.mark.parametrize("format", ["json", "csv", "orc", "parquet"])
def test_tables_of_quads(spark, tmp_path, format):
    from quadrille.sources.tables import read_quads, write_quads

    quads = quads_from(spark, [q(1), q(2, "urn:g"), Quad(bnode("b"), iri("urn:p"), literal('a "b"\n, c\\', lang="en")), Quad(iri("urn:x"), iri("urn:p"), literal("")), Quad(iri("urn:x"), iri("urn:p"), literal("5", "http://www.w3.org/2001/XMLSchema#integer"))])
    write_quads(quads, format, f"{tmp_path}/t")
    got = read_quads(spark, format, f"{tmp_path}/t")
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(got) == rows(quads)
    s = QuadStore(spark)
    s.import_({"kind": "table", "format": format, "path": f"{tmp_path}/t"})
    assert s.size() == 5
