"""Long texts read in parts give what they give when read at once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import langid, ppm, substring
from quadrille.llm import text as T

from .conftest import prose


def buffers():
    r = random.Random(6)
    odd = ["é", "漢字", "  ", "\n", "...", "x1", "don't", "ǅ", "12.5", "🙂"]
    long = " ".join(w if r.random() < 0.8 else r.choice(odd) for w in prose(1, 4000).split())
    return T.buffers(pa.array(["short one", long, None, "z" * 3000, long[:300], long.replace(" ", "-"), "two words"], pa.large_string()))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BYTES", 100)


@pytest.mark.parametrize("k", [1, 3, 60, 100_000])
def test_shingles(monkeypatch, k):
    data, offs = buffers()
    at_once = [(h, o) for _, h, o in T.shingle_sets(data, offs, k)]
    want = [h[o[i] : o[i + 1]].tolist() for h, o in at_once for i in range(len(o) - 1)]
    monkeypatch.setattr(T, "CHUNK_BYTES", 100)
    got = [h[o[i] : o[i + 1]].tolist() for _, h, o in T.shingle_sets(data, offs, k) for i in range(len(o) - 1)]
    assert got == want and any(want)


@pytest.mark.parametrize("k", [1, 50, 100_000])
def test_windows(monkeypatch, k):
    data, offs = buffers()
    rows = lambda made: sorted((int(h), i + int(d), int(s), int(e)) for i, _, w in made for h, d, s, e in zip(*w, strict=True))
    want = rows([(0, 0, substring.windows(data, offs, k))])
    monkeypatch.setattr(T, "CHUNK_BYTES", 100)
    assert rows(substring.pieces(data, offs, k)) == want


def test_character_grams(monkeypatch):
    data, offs = buffers()
    got, ptr = langid.ngrams(data, offs, 1 << 12)
    want = [np.bincount(got[a:b], minlength=1 << 12) for a, b in zip(ptr, ptr[1:])]
    have = [np.zeros(1 << 12, int) for _ in want]
    parts = 0
    for sign, i, j, got, ptr in langid.gram_parts(data, offs, 1 << 12, 100):
        parts += 1
        for d in range(i, j):
            have[d] += sign * np.bincount(got[ptr[d - i] : ptr[d - i + 1]], minlength=1 << 12)
    assert all((a == b).all() for a, b in zip(have, want, strict=True)) and parts > 100
    logp, prior = np.log(np.random.default_rng(1).random((1 << 12, 3))).astype(np.float32), np.zeros(3)
    joint, n = langid.score(data, offs, logp, prior)
    monkeypatch.setattr(langid, "SCORE_CHUNK", 100)
    joint2, n2 = langid.score(data, offs, logp, prior)
    assert (n == n2).all() and np.allclose(joint, joint2, rtol=1e-9)


def test_byte_grams():
    data, offs = buffers()
    want = ppm.grams(data, offs, 5)
    got = np.zeros(len(want), np.uint64)
    at = offs.copy()
    for i, j, keys, o in ppm.gram_parts(data, offs, 5, 100):
        for d in range(i, j):
            n = o[d - i + 1] - o[d - i]
            got[at[d] : at[d] + n] = keys[o[d - i] : o[d - i + 1]]
            at[d] += n
    assert (got == want).all() and (at[:-1] == offs[1:]).all()


def test_whole_operators_in_parts(make, small, monkeypatch):
    from .test_jaccard import brute, corpus, result
    from .test_substring import brute as passages
    from .test_substring import corpus as repeated

    assert result(__import__("quadrille.llm.jaccard", fromlist=["similar"]).similar(make(corpus()))) == brute(corpus())
    assert sorted(tuple(r) for r in substring.repeats(make(repeated())).collect()) == passages(repeated(), 50)


def test_parts_begin_where_they_may():
    data, offs = buffers()
    own, first = T.parts(data, offs, T.between_words, 50)
    assert set(offs.tolist()) <= set(own.tolist()) and (own[first] == offs).all()
    inner = [x for x in own.tolist() if x not in set(offs.tolist())]
    assert len(inner) > 200 and not T.WORD[data[inner]].any()
    # Where a part may begin nowhere, a text stays whole
    assert 3000 in np.diff(own).tolist()
