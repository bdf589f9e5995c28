import itertools
import random

from quadrille.functions.pieces import SPACE, PieceTokenizer, pieces

RESERVED = [("?", 0.0)] + [(f"<{i}>", 0.0) for i in range(5)]
VOCABULARY = [*RESERVED, (SPACE, -2.0), (SPACE + "a", -1.0), ("a", -1.5), ("b", -1.7), ("ab", -2.0), ("abc", -9.0), ("c", -1.0), (SPACE + "bb", -2.5)]


def best_score(text, vocabulary):
    s = PieceTokenizer.normalize(text)
    ids = {p: sc for p, sc in vocabulary[6:]}
    top = None
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(s)), k) for k in range(len(s))):
        parts = [s[a:b] for a, b in zip((0, *cuts), (*cuts, len(s)), strict=True)]
        if all(p in ids for p in parts):
            score = sum(ids[p] for p in parts)
            top = score if top is None else max(top, score)
    return top


def test_best_cut():
    r, t = random.Random(1), PieceTokenizer(VOCABULARY)
    for _ in range(60):
        text = "".join(r.choice("abc ") for _ in range(r.randint(1, 9)))
        ids = t.encode(text)
        assert "".join(VOCABULARY[i][0] for i in ids) == t.normalize(text)
        assert abs(sum(VOCABULARY[i][1] for i in ids) - best_score(text, VOCABULARY)) < 1e-9


def test_unknowns_and_empties(spark):
    t = PieceTokenizer(VOCABULARY)
    assert t.encode("") == t.encode(None) == []
    assert t.encode("xyz") == [6, 0]
    assert t.encode("ａ") == t.encode("a") == [7]
    df = spark.createDataFrame([("a",), (None,), ("xbx",)], "t string")
    assert [list(r.p) for r in df.select(pieces(spark, df.t, VOCABULARY).alias("p")).collect()] == [[7], [], [6, 0, 9, 0]]
