import collections
import re

import pytest

from quadrille.llm import substring

from .conftest import prose


def brute(rows, k):
    where, wins = collections.defaultdict(set), []
    for i, t in {r for r in rows if r[0] is not None and r[1]}:
        b = t.encode()
        m = list(re.finditer(rb"(?:[A-Za-z0-9]|[\x80-\xff])+", b))
        for x in range(len(m) - k + 1):
            key = tuple(y.group() for y in m[x : x + k])
            where[key].add(i)
            wins.append((i, m[x].start(), m[x + k - 1].end(), key))
    out = []
    for i, s, e, key in sorted(w for w in wins if len(where[w[3]]) > 1):
        n = len(where[key])
        if out and out[-1][0] == i and s <= out[-1][2]:
            o = out[-1]
            out[-1] = (i, o[1], max(o[2], e), o[3] + 1, max(o[4], n))
        else:
            out.append((i, s, e, 1, n))
    return sorted(out)


def corpus():
    shared = [prose(70 + i, 55 + i) for i in range(4)]
    rows = [(i, prose(i, 150)) for i in range(12)]
    rows += [(100 + i, f"{prose(200 + i, 30)} {shared[i % 4]} {prose(300 + i, 40)} {shared[(i + 1) % 3]}") for i in range(16)]
    return [*rows, (400, shared[0] + " " + shared[0]), (401, prose(90, 60) + ". " + prose(90, 60)), (402, " ".join(prose(0, 150).split()[:49]))]


@pytest.mark.parametrize(("depth", "bits", "flush"), [(1, None, None), (2, None, 50), (1, 1 << 23, 10), (4, None, None)])
def test_equals_brute_force(make, monkeypatch, depth, bits, flush):
    if flush:
        monkeypatch.setattr(substring, "FLUSH", flush)
    got = sorted(tuple(r) for r in substring.repeats(make(corpus()).repartition(5), 50, depth, bits).collect())
    assert got == brute(corpus(), 50)
    assert got


def test_rounds_give_the_same(make, monkeypatch):
    want = brute(corpus(), 50)
    assert sorted(tuple(r) for r in substring.repeats(make(corpus()), rounds=3).collect()) == want
    monkeypatch.setattr(substring, "MAX_BITS", 1 << 22)  # half of the least sketch, hence two rounds
    assert sorted(tuple(r) for r in substring.repeats(make(corpus())).collect()) == want


def test_a_crowded_sketch_loses_nothing(make, monkeypatch):
    """With far too few counters all windows look repeated, and the exact pass still decides."""
    monkeypatch.setattr(substring, "RANGE_BITS", 16)
    got = sorted(tuple(r) for r in substring.repeats(make(corpus()), 50, 1, 1 << 17).collect())
    assert got == brute(corpus(), 50)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in substring.repeats(odd).collect()) == brute(rows, 50)
    assert substring.repeats(odd.limit(0)).count() == 0
