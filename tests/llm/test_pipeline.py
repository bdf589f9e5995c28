"""The pipeline against the same five steps done one by one in plain Python."""

import re

import tiktoken

import corpus_pipeline
from quadrille.llm import bpe, langid

from .conftest import prose
from .test_jaccard import brute as similar
from .test_jaccard import edited
from .test_langid import TONGUES, naive

ITEM = "The quiet engine of the northern mill turns slowly while the old keeper counts every grain of rye by candle light"


def corpus():
    rows = [(10 * i + k, prose(10 * i + k, 40 + i, w), name, "s") for i in range(12) for k, (name, w) in enumerate(TONGUES.items())]
    rows += [(500 + i, edited(rows[i][1], i, 0.03), rows[i][2], "s") for i in range(6)] + [(520 + i, rows[7][1], rows[7][2], "s") for i in range(4)]
    rows += [(600 + i, f"{prose(900 + i, 30, TONGUES['aa'])} mail me at ann{i}@mail.example.com or {4929348385146300 + i} now", "aa", "s") for i in range(5)]
    rows += [(700 + i, f"{prose(950 + i, 20, TONGUES['bb'])}. {ITEM} {prose(970 + i, 20, TONGUES['bb'])}", "bb", "s") for i in range(3)]
    return [*rows, (800, "", "aa", "s"), (801, None, "bb", "s"), (802, "1234 5678 !!", "cc", "s"), (None, prose(55, 40, TONGUES["cc"]), "cc", "s")]


def in_python(rows, docs):
    names, logp, prior = langid.fit(docs)

    def known(text):
        joint, n = naive(text, logp, prior)
        best = joint.argmax()
        share = 1 / sum(2.718281828459045 ** (joint - joint[best]))
        return n > 0 and share >= langid.MIN_POSTERIOR and (joint[best] - prior[best]) / n > -(len(logp) and __import__("math").log(len(logp)))

    rows = [r for r in rows if known(r[1])]
    found = similar([(i, t) for i, t, *_ in rows])
    rows = [r for r in rows if r[0] not in found or found[r[0]][0] == r[0]]
    rows = [r for r in rows if ITEM not in r[1]]
    rows = [(i, re.sub(r"\b\d{16}\b", "[CARD]", re.sub(r"\S+@mail\.example\.com", "[EMAIL]", t))) for i, t, *_ in rows]
    own = tiktoken.Encoding("own", pat_str=bpe.PIECE, mergeable_ranks=bpe.codec().ranks, special_tokens={})
    return sorted((i if i is not None else -1, own.encode_ordinary(t)) for i, t in rows)


def test_equals_plain_python(spark, make, tmp_path):
    docs = make(corpus())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, prose(3000, 40))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = in_python(corpus(), docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.tokens)) for r in got) == want
    ids = {i for i, _ in want}
    assert not ids & {700, 701, 702, 800, 801, 802, 520, 521, 522, 523} and {600, 601, 602, 603, 604, -1} <= ids


def test_empty_tables(spark, make, tmp_path):
    make(corpus()).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontaminate", "pii", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
