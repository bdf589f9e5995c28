import numpy as np

from quadrille.llm import pii

from .conftest import prose

PRIVATE = {
    "EMAIL": "ann.lee+x@mail.example.com",
    "CARD": "4111111111111111",
    "IP": "192.168.17.45",
    "PHONE": "+1 (487) 555-7209",
    "SECRET": "04dbebab91ab85687d33eeaaf9ac699e1188f962",
    "SSN": "123-45-6789",
    "PERSON": "Maria Lopez",
}


def corpus():
    rows = [(i, prose(i, 60)) for i in range(20)]
    for k, (kind, span) in enumerate(PRIVATE.items()):
        for c in range(6):
            lead = 'token = "' if kind == "SECRET" else "write to "
            rows.append((100 + 10 * k + c, f"{prose(k + c, 20)} {lead}{span}{chr(34) if kind == 'SECRET' else ''} {prose(k, 20)}é"))
    return rows + [(500 + i, f"{prose(i, 20)} see page 1998-03-04 of version 12.345.678 {prose(i, 5)}") for i in range(12)]


def test_spans(make):
    rows = dict(corpus())
    got = pii.spans(make(corpus()), rejected=True).collect()
    found = {(r.doc_id, r.kind, rows[r.doc_id][r.start : r.end]) for r in got if r.is_pii}
    for k, (kind, span) in enumerate(PRIVATE.items()):
        for c in range(6):
            assert (100 + 10 * k + c, kind, span) in found
    assert not any(d < 100 or d >= 500 for d, _, _ in found)
    assert any(r.doc_id >= 500 for r in got)  # candidates that the classifier turned down
    assert {(r.doc_id, r.start) for r in pii.spans(make(corpus())).collect()} == {(r.doc_id, r.start) for r in got if r.is_pii}


def kinds(text):
    return [(k, raw[s:e].decode()) for _, raw, found in pii.candidates(*pii.T.buffers(pii.pa.array([text]))) for s, e, k in found]


def test_ordinary_forms_are_candidates():
    for kind, span in [("PHONE", "+33 1 23 45 67 89"), ("PHONE", "01 23 45 67 89"), ("PHONE", "612 345 678"), ("PHONE", "+33123456789"), ("PHONE", "612 34 56 78"), ("IP", "2001:db8::1"), ("IP", "fe80::1:2"), ("IBAN", "DE89 3704 0044 0532 0130 00"), ("IBAN", "FR76 3000 6000 0112 3456 7890 189"), ("PHONE", "5551234567"), ("PHONE", "612345678"), ("NUMBER", "12 3456 789")]:
        assert kinds(f"it is {span} so") == [(kind, span)]
    assert kinds('password = "correcthorse"') == [("SECRET", "correcthorse")]
    assert kinds("std::vector and abc::def in 1998") == []


def test_ordinary_forms_are_redacted(make):
    forms = {"PHONE": ["+33 1 23 45 67 89", "01 23 45 67 89", "612 345 678"], "IP": ["2001:db8::1"], "IBAN": ["DE89 3704 0044 0532 0130 00"]}
    rows = corpus() + [(1000 + c, f"write to {s} {prose(c, 10)}") for c, s in enumerate(s for k in forms for s in forms[k])]
    rows += [(1100, 'password = "correcthorse" there'), (1101, "call 5551234567 there"), (1102, "phone 612345678 there"), (1103, "serial 5551234568 there")]
    out = {r.doc_id: r.text for r in pii.redact(make(rows)).collect()}
    for c, k in enumerate(k for k in forms for _ in forms[k]):
        assert out[1000 + c].startswith(f"write to [{k}] ")
    assert out[1100] == 'password = "[SECRET]" there'
    assert [out[i].split()[1] for i in (1101, 1102, 1103)] == ["[PHONE]", "[PHONE]", "5551234568"]


def test_redaction(make):
    docs = make(corpus())
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    rows = dict(corpus())
    assert pii.redact(docs).columns == docs.columns and len(out) == len(rows)
    for i, t in rows.items():
        span = list(PRIVATE.values())[(i - 100) // 10] if 100 <= i < 500 else None
        want = t.replace(span, f"[{list(PRIVATE)[(i - 100) // 10]}]") if span else t
        assert out[i].text == want and out[i].n_chars == len(want)


def test_em_finds_reliabilities():
    g = np.random.default_rng(0)
    truth = g.random(4000) < 0.4
    right = np.array([0.95, 0.85, 0.75, 0.9])
    vote = np.where(g.random((4000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    vote[g.random((4000, 4)) < 0.3] = -1
    rows, n = np.unique(vote, axis=0, return_counts=True)
    post, rel, share = pii.expectation_maximisation(np.zeros(len(rows), int), rows, n.astype(float), 200)
    assert np.abs(rel[:, 1] - right).max() < 0.06 and np.abs(1 - rel[:, 0] - right).max() < 0.06
    assert abs(share[0] - 0.4) < 0.06
    where = {tuple(r): p for r, p in zip(rows, post, strict=True)}
    assert np.mean([(where[tuple(v)] > 0.5) == t for v, t in zip(vote, truth, strict=True)]) > 0.9


def test_logistic():
    x = np.array([[1, 0, 1], [1, 1, 0], [1, 1, 1]], float)
    w = pii.logistic(x, np.array([0.1, 0.9, 0.5]), np.array([500.0, 500.0, 500.0]))
    p = 1 / (1 + np.exp(-(x @ w)))
    assert p[0] < 0.2 and p[1] > 0.8


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_odd_rows(odd, make):
    assert pii.spans(odd).count() == 0
    assert pii.redact(odd).count() == odd.count()
    texts = lambda d: sorted((r.doc_id or 0, r.text or "", r.text is None) for r in d.collect())
    assert texts(pii.redact(odd)) == texts(odd)
    assert pii.spans(odd.limit(0)).count() == 0 and pii.redact(odd.limit(0)).count() == 0
    mixed = make([(1, None), (2, ""), (None, "mail ann@mail.example.com"), (3, "mail ann@mail.example.com"), (3, "mail ann@mail.example.com"), (4, "a" * 200_000 + " 4111111111111111 " + "@" * 500)])
    assert sorted((r.doc_id or 0, r.kind) for r in pii.spans(mixed).collect() if r.is_pii) == [(0, "EMAIL"), (3, "EMAIL"), (3, "EMAIL"), (4, "CARD")]


def test_long_local_parts_and_utf8(make):
    assert kinds("write to " + "a" * 90 + "@mail.example.com so") == [("EMAIL", "a" * 90 + "@mail.example.com")]
    assert kinds("x " + "é" * 70 + "@mail.example.com") == [("EMAIL", "é" * 70 + "@mail.example.com")]
    out = pii.redact(make(corpus() + [(900, "write to " + "é" * 70 + "@mail.example.com now")])).where("doc_id = 900").first()
    assert out.text == "write to [EMAIL] now"


def test_names_by_gazetteer_and_by_what_stands_before(make, spark):
    assert kinds("we met Priya Natarajan there") == [] and kinds("dear Priya Natarajan, so") == [("PERSON", "Priya Natarajan")]
    rows = corpus() + [(910 + c, f"we met Priya Natarajan and wrote {prose(c, 9)}") for c in range(4)]
    own = pii.spans(make(rows), names=spark.createDataFrame([("priya",), ("Maria",), (None,)], "given string"))
    assert {(r.doc_id, r.kind) for r in own.collect() if r.doc_id >= 910} == {(910 + c, "PERSON") for c in range(4)}
    assert pii.spans(make(rows)).where("doc_id >= 910").count() == 0


def test_iban_check_digits():
    assert pii.mod97(b"DE89 3704 0044 0532 0130 00") and not pii.mod97(b"DE88370400440532013000")


def test_parts_of_a_long_text_change_nothing(monkeypatch):
    text = " ".join(t for _, t in corpus()) + " password is correcthorse1 and mail ann@mail.example.com"
    want = kinds(text)
    assert len(want) > 40
    monkeypatch.setattr(pii, "PART", 100)
    assert kinds(text) == want


def test_equals_brute_force(make):
    """Votes, reliabilities, classifier and decisions once more, span by span and in plain Python."""
    import math

    rows = corpus()
    spans = []
    for i, t in rows:
        for _, raw, found in pii.candidates(*pii.T.buffers(pii.pa.array([t]))):
            spans += [(i, t, raw, s, e, k) for s, e, k in found]
    votes = [pii.votes(raw, s, e, k) for _, _, raw, s, e, k in spans]
    n = len(pii.LABELERS)
    rel, share = [[0.2, 0.8] for _ in range(n)], {k: 0.5 for k in pii.KINDS}
    for _ in range(50):
        post = []
        for x, v in zip(spans, votes, strict=True):
            pro, con = math.log(share[x[5]]), math.log(1 - share[x[5]])
            for j in range(n):
                if v[j] >= 0:
                    pro += math.log(rel[j][1] if v[j] else 1 - rel[j][1])
                    con += math.log(rel[j][0] if v[j] else 1 - rel[j][0])
            post.append(1 / (1 + math.exp(-max(-30, min(30, pro - con)))))
        for j in range(n):
            for c in (0, 1):
                w = [p if c else 1 - p for p in post]
                yes = sum(y for y, v in zip(w, votes, strict=True) if v[j] == 1)
                rel[j][c] = min(0.99, max(0.01, (yes + 4 * (0.8 if c else 0.2)) / (sum(y for y, v in zip(w, votes, strict=True) if v[j] >= 0) + 4)))
        for k in pii.KINDS:
            own = [p for p, x in zip(post, spans, strict=True) if x[5] == k]
            share[k] = min(0.99, max(0.01, (sum(own) + 2) / (len(own) + 4)))
    x = pii.unpack(np.array([pii.features(raw, s, e, k) for _, _, raw, s, e, k in spans]))
    w = np.zeros(x.shape[1])
    for _ in range(4000):  # gradient steps in place of Newton's
        w += 0.02 * (x.T @ (np.array(post) - 1 / (1 + np.exp(-(x @ w)))) - w) / 4
    score = 1 / (1 + np.exp(-(x @ w)))
    want = {(i, len(raw[:s].decode()), len(raw[:e].decode()), k): p for (i, _, raw, s, e, k), p in zip(spans, score, strict=True)}
    got = {(r.doc_id, r.start, r.end, r.kind): r for r in pii.spans(make(rows), rejected=True).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x].score - want[x]) < 2e-3 for x in want)
    assert all(got[x].is_pii == (want[x] >= 0.5) for x in want if abs(want[x] - 0.5) > 2e-3)


def test_the_threshold_itself_counts(make):
    got = pii.spans(make(corpus()), rejected=True).collect()
    at = sorted(r.score for r in got)[len(got) // 2]
    shown = pii.spans(make(corpus()), threshold=at, rejected=True).collect()
    assert all(r.is_pii for r in shown if r.score > at) and not any(r.is_pii for r in shown if r.score < at)
    none = pii.spans(make(corpus()), threshold=0.0).collect()
    assert len(none) == len(got) and all(r.is_pii for r in none)
