import random

import pytest

WORDS = "the of and stone river walks under bright quiet morning green letters carry over distant hills while seven people wait near old bridge before rain comes down softly again without any warning today".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(words) + r.choice(["", "", "x", "er", "ing", "y"])
        out.append(w.capitalize() if i % 9 == 0 else w)
        if i % 9 == 8:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def make(spark):
    """make(rows) of (doc_id, text, lang, source): documents with extra columns, named as the operators name their own."""
    extra = ["node", "key", "comp", "part", "size", "h", "s", "e", "g", "shard", "keys", "counts", "draw", "whole", "bands", "slice", "i", "j", "text_id", "file", "start", "a.b"]

    def documents(rows):
        rows = [(*r, *["x"] * (4 - len(r))) if len(r) < 4 else r for r in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in extra)
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *["clash"] * len(extra)) for i, t, lang, src in rows], schema)

    return documents


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empties, a very long text, repeated rows and ties."""
    long = prose(5, 60_000)
    return make([(1, None), (None, prose(1, 80)), (2, ""), (3, "  \n"), (4, long), (5, prose(1, 80)), (5, prose(1, 80)), (6, prose(1, 80)), (7, "?!"), (8, "x"), (None, None), (9, "é ß 漢字 🙂")])
