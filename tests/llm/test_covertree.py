import math

import numpy as np
import pytest

from quadrille.llm import covertree


def brute(rows, k, every=1):
    good = [(i, x) for i, x in dict.fromkeys((i, tuple(x)) for i, x in rows if i is not None and x and all(e is not None and np.isfinite(e) for e in x))]
    out = set()
    for i, x in [r for r in good if r[0] % every == 0]:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in good if j != i and len(y) == len(x))
        out |= {(i, r + 1, j, round(dist, 6)) for r, (dist, j) in enumerate(d[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id bigint, embedding array<double>, pivot string, id int")


@pytest.mark.parametrize(("n", "dim", "k", "group", "every"), [(300, 8, 10, 40, 1), (200, 2, 3, 20, 7), (150, 40, 5, 1000, 1), (3, 4, 10, 1024, 1), (900, 3, 10, 300, 100)])
def test_equals_brute_force(spark, n, dim, k, group, every):
    g = np.random.default_rng(n)
    centers = g.normal(size=(6, dim)) * 4
    x = centers[g.integers(0, 6, n)] + g.normal(size=(n, dim))
    x = np.round(x, 3)
    x[n // 3] = x[0]  # a tie at distance 0
    rows = [(int(i), x[i].tolist()) for i in range(n)]
    assert {tuple(r) for r in covertree.top_k(frame(spark, rows), k, every, group=group).collect()} == brute(rows, k, every)


def test_many_copies_and_a_line(spark):
    rows = [(i, [1.0, 2.0]) for i in range(80)] + [(100 + i, [float(i), 0.0]) for i in range(120)]
    assert {tuple(r) for r in covertree.top_k(frame(spark, rows), 4, 1, group=30).collect()} == brute(rows, 4)


@pytest.mark.parametrize("group", [25, 1000])
def test_an_id_with_many_vectors_takes_one_place(spark, group):
    g = np.random.default_rng(3)
    rows = [(0, [0.0, 0.0])] + [(1, [0.001 * (c + 1), 0.0]) for c in range(30)]
    rows += [(int(i), np.round(g.normal(size=2), 3).tolist()) for i in g.integers(2, 40, 120)]
    least = {}
    for i, x in rows:
        for j, y in rows:
            if i != j:
                least[i, j] = min(least.get((i, j), np.inf), float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())))
    want = set()
    for i in {i for i, _ in rows}:
        want |= {(i, r + 1, j, round(d, 6)) for r, (d, j) in enumerate(sorted((d, j) for (a, j), d in least.items() if a == i)[:10])}
    assert {tuple(r) for r in covertree.top_k(frame(spark, rows), 10, 1, group=group).collect()} == want


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [0.0, 0.0]), (6, [3.0, 4.0]), (6, [3.0, 4.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 4.0]), (10, [0.0])]
    got = {tuple(r) for r in covertree.top_k(frame(spark, rows), 3, 1).collect()}
    assert got == {(5, 1, 6, 5.0), (6, 1, 5, 5.0), (8, 1, 9, 1.0), (9, 1, 8, 1.0)} == brute(rows, 3)
    assert covertree.top_k(frame(spark, rows).limit(0), 3, 1).count() == 0


def test_parts_and_small_memory_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(covertree, "PART", 20)
    monkeypatch.setattr(covertree, "QUERIES", 7)
    monkeypatch.setattr(covertree, "HELD_BYTES", 1)
    g = np.random.default_rng(5)
    rows = [(int(i), np.round(g.normal(size=3), 2).tolist()) for i in range(260)] + [(1000 + i, [0.5, 0.5, 0.5]) for i in range(90)]
    assert {tuple(r) for r in covertree.top_k(frame(spark, rows), 6, 1, group=100).collect()} == brute(rows, 6)


def test_large_and_small_values(spark):
    g = np.random.default_rng(8)
    rows = [(int(i), (g.normal(size=4) * 1e160).tolist()) for i in range(60)] + [(100 + i, [1e-150 * i, 0.0, 0.0, 0.0]) for i in range(30)]
    got = {(r.query_id, r.rank): r.neighbor_id for r in covertree.top_k(frame(spark, rows), 3, 1, group=20).collect()}
    assert len(got) == 3 * 90
    for i, x in rows:
        d = sorted((math.hypot(*(a - b for a, b in zip(x, y, strict=True))), j) for j, y in rows if j != i)
        assert [got[i, r + 1] for r in range(3)] == [j for _, j in d[:3]]


def test_a_tree_of_nodes_and_pruned_pairs():
    g = np.random.default_rng(1)
    x = np.concatenate([c + 0.05 * g.normal(size=(80, 5)) for c in g.normal(size=(25, 5)) * 3])
    t = covertree.CoverTree(np.arange(len(x)), x, 1.0)
    assert sorted(t.ids.tolist()) == list(range(len(x))) and (t.x == x[t.ids]).all()
    leaves = 0
    for i in range(len(t.start)):
        own = np.sqrt(((t.x[t.start[i] : t.end[i]] - t.centers[i]) ** 2).sum(axis=1))
        assert abs(own.max() - t.radius[i]) < 1e-9
        kids = t.children(i)
        leaves += not len(kids)
        if len(kids):
            assert t.start[kids].min() == t.start[i] and t.end[kids].max() == t.end[i] and (t.end[kids] - t.start[kids]).sum() == t.end[i] - t.start[i]
    assert leaves > 25 and (t.number > 0).sum() > 5
    found = covertree.Search(covertree.CoverTree(np.arange(len(x)), x, 1.0, covertree.QUERY_LEAF), 5)
    found.meet(t)
    assert found.seen["pruned internal"] > 50 and found.seen["compared leaves"] < 0.3 * leaves * len(found.q.start)
    d = np.sqrt(covertree.distances2(x, x))
    np.fill_diagonal(d, np.inf)
    rows, ids, _ = found.rows()
    assert {(r, i) for r, i in zip(rows.tolist(), ids.tolist(), strict=True)} == {(r, int(i)) for r in range(len(x)) for i in np.argsort(d[r])[:5]}
