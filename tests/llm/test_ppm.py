import pytest

from quadrille.llm import ppm

from .conftest import prose


@pytest.mark.parametrize(("order", "least"), [(4, 2), (2, 1), (4, 3), (1, 2)])
def test_equals_the_trie_read_byte_by_byte(make, order, least):
    rows = [(i, prose(i, 30)) for i in range(8)] + [(20, "abracadabra"), (21, "ÿþ\x00a"), (22, ""), (23, None), (24, "zq"), (25, prose(3, 30))]
    trie = ppm.ByteTrie(order)
    for _, t in rows:
        x = bytes(order) + (t or "").encode()
        for k in range(order, len(x)):
            trie.learn(x[k - order : k], x[k])
    trie.prune(least)
    got = {r.doc_id: r for r in ppm.score(make(rows).repartition(3), order, least).collect()}
    for i, t in rows:
        bits, escapes = trie.code((t or "").encode(), learn=False)
        assert abs(got[i].bits - bits) < 1e-3 * max(1, bits) and got[i].escapes == escapes
        assert got[i].n_bytes == len((t or "").encode())


def test_probabilities_add_up_to_one():
    trie = ppm.ByteTrie(3)
    text = prose(1, 60).encode()
    trie.code(text)
    for before in (text[:3], text[20:23], b"\x00\x00\x00", b"qqq", b"th "):
        assert abs(sum(2 ** -trie.cost(before, s)[0] for s in range(256)) - 1) < 1e-9


def test_adaptive(make):
    rows = [(1, "abababababababab"), (2, "the quick brown fx"), (3, "")]
    got = {r.doc_id: r.bits_per_byte for r in ppm.score(make(rows), adaptive=True).collect()}
    assert got[1] < got[2] and got[3] == 0.0


def test_fewer_nodes_still_score_all(make, monkeypatch):
    rows = [(i, prose(i, 40)) for i in range(6)]
    folder = ppm.train(make(rows), max_nodes=50)
    trie = ppm.Trie.load(ppm.local_path(folder), ppm.ORDER)
    assert 0 < len(trie.grams[ppm.ORDER]) <= 50
    assert ppm.train(make([(1, ""), (2, None)])) is None


def test_parts_score_as_one_trie(make, monkeypatch):
    rows = [(i, prose(i, 40)) for i in range(12)]
    want = {r.doc_id: (r.bits, r.escapes) for r in ppm.score(make(rows)).collect()}
    monkeypatch.setattr(ppm, "PART_NODES", 60)
    folder = ppm.local_path(ppm.train(make(rows)))
    parts = ppm.Parts(folder, ppm.ORDER)
    counts = {}
    for _, t in rows:
        for k in ppm.grams(*ppm.T.buffers(ppm.pa.array([t])), ppm.ORDER).tolist():
            counts[k] = counts.get(k, 0) + 1
    kept = [k for p in range(len(parts.sizes)) if parts.sizes[p] for k in parts.part(p).grams[ppm.ORDER].tolist()]
    assert len(parts.sizes) > 3 and sorted(kept) == sorted(k for k, n in counts.items() if n >= ppm.MIN_COUNT)
    assert {r.doc_id: (r.bits, r.escapes) for r in ppm.score(make(rows)).collect()} == want


def test_odd_rows(odd):
    got = ppm.score(odd).collect()
    assert len(got) == odd.count()
    same = {r.bits for r in got if r.doc_id in (5, 6)}
    assert len(same) == 1
    assert all(r.bits == 0 for r in got if r.doc_id in (1, 2))
    assert ppm.score(odd.limit(0)).count() == 0
