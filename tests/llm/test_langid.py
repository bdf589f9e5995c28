import math
import os

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import langid
from quadrille.llm import text as T

from .conftest import prose

TONGUES = {
    "aa": "lumi kala vesi metsa talo ranta tuli kivi puu lintu saari jarvi".split(),
    "bb": "schnee wald haus feuer stein baum vogel insel strand wasser fisch berg".split(),
    "cc": "neige foret maison feu pierre arbre oiseau ile plage eau poisson mont".split(),
}


def rows(seed, n):
    return [(seed + 10 * i + k, prose(seed + 10 * i + k, 25, w), name, "s") for i in range(n) for k, (name, w) in enumerate(TONGUES.items())]


def test_held_out_accuracy(make):
    model = langid.fit(make(rows(0, 30)))
    assert model[0] == ["aa", "bb", "cc"]
    test = make(rows(5000, 30))
    got = {r.doc_id: r for r in langid.identify(test, model=model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows(5000, 30)]) > 0.98
    assert all(r.accepted for r in got.values())


def naive(text, logp, prior):
    """Scores by a loop over characters."""
    s, space = [], True
    for c in (text or "").lower():
        if c.isalpha():
            s.append(ord(c))
            space = False
        elif not space or not s:
            s.append(32)
            space = True
    out, n = np.zeros(logp.shape[1]), 0
    if not any(c != 32 for c in s):
        return out + prior, 0
    for k in langid.ORDERS:
        for i in range(len(s) - k + 1):
            h = k * 7919 + sum(c * int(m) for c, m in zip(s[i : i + k], langid._MUL, strict=False))
            h = h * 0xD6E8FEB86659FD93 & (1 << 64) - 1
            h ^= h >> 32
            out += logp[h % len(logp)]
            n += 1
    return out + prior, n


def test_batch_equals_loop(make):
    _, logp, prior = langid.fit(make(rows(0, 10)))
    texts = [r[1] for r in rows(700, 4)] + ["", None, "...", "a", "É é!  x", " b", "c\n\n\nd", "漢字"]
    got, n = langid.score(*T.buffers(pa.array(texts), lower=True), logp, prior)
    for i, t in enumerate(texts):
        want, m = naive(t, logp, prior)
        assert n[i] == m and np.allclose(got[i], want, atol=1e-3)


def test_sample_is_bounded_and_stable(make):
    docs = make(rows(0, 60))
    a, b = langid.fit(docs, max_rows=40), langid.fit(docs.repartition(7), max_rows=40)
    assert a[0] == b[0] and np.array_equal(a[1], b[1])


def test_odd_rows(spark, make, odd):
    model = langid.fit(make(rows(0, 10)))
    got = langid.identify(odd, model=model).collect()
    assert len(got) == odd.count()
    assert all(r.lang_pred == "und" and not r.accepted for r in got if r.doc_id in (1, 2, 3, 7))
    assert len({(r.lang_pred, r.posterior) for r in got if r.doc_id in (5, 6)}) == 1
    unlabelled = make([(1, "text", None, "s"), (2, "text", " ", "s")])
    assert langid.fit(unlabelled)[0] == [] and langid.identify(unlabelled).where("accepted").count() == 0
    assert langid.identify(odd.limit(0)).count() == 0
    kept = langid.stage(spark, make([*rows(0, 10), (9999, None, "aa", "s"), (9998, "!!", "aa", "s")]), "")
    assert kept.count() == 30 and "a.b" in kept.columns


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no tables here")
def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    r = langid.identify(rest, model=model).join(rest.select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang = lang_pred as int)) a", "avg(cast(accepted as int)) b").first()
    assert r.a > 0.98 and r.b > 0.99
    assert math.isclose(sum(np.exp(model[2])), 1, abs_tol=1e-6)
