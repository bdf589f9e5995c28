import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from quadrille.llm import bpe
from quadrille.llm import text as T


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=bpe.PIECE, mergeable_ranks=bpe.codec().ranks, special_tokens={})


def texts():
    r = random.Random(3)
    alphabet = "aé'sstmdrevl ' \n\t 1²٣!?🙂漢字 the'll 're \r\x1c\x85　"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["", None, "a" * 4000, " " * 300, "'s", "x's", "'", " 's", "\n's", "don't've", "''ll", "'llama", "'re", "'r", "'l", " \n a", "<|endoftext|>", "ab" * 30_000]


def test_encodes_as_the_library_does(reference):
    tx = texts()
    for native in (False, True):
        tokens, offs = bpe.codec(native=native).encode(*T.buffers(pa.array(tx)))
        for i, t in enumerate(tx):
            assert tokens[offs[i] : offs[i + 1]].tolist() == reference.encode_ordinary(t or ""), repr(t)


def slow_merge(piece, ranks):
    parts = [bytes([c]) for c in piece]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_queue_equals_rescanning():
    r, ranks = random.Random(1), bpe.codec().ranks
    for _ in range(400):
        piece = "".join(r.choice("abetinors") for _ in range(r.randint(2, 24))).encode()
        assert bpe.merge(piece, {k: v for k, v in ranks.items() if k != piece}) == slow_merge(piece, {k: v for k, v in ranks.items() if k != piece})


def test_rows(odd, reference):
    rows = odd.collect()
    got = bpe.encode(odd).collect()
    assert sorted((r.doc_id or 0, list(r.tokens)) for r in got) == sorted((r.doc_id or 0, reference.encode_ordinary(r.text or "")) for r in rows)
    assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in got)
    back = bpe.decode(bpe.encode(odd)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, r.text or "") for r in rows)
    assert bpe.encode(odd.limit(0)).count() == 0


def test_forgetting_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "CHUNK", 10)
    c, tx = bpe.Codec(), texts()[:200]
    data, offs = T.buffers(pa.array(tx))
    for i, j in T.chunks(offs, bpe.CHUNK):
        tokens, to = c.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for k in range(i, j):
            assert tokens[to[k - i] : to[k - i + 1]].tolist() == reference.encode_ordinary(tx[k] or "")


def test_a_piece_of_more_than_24_bits_of_tokens(monkeypatch):
    c = bpe.Codec()
    n = (1 << 24) + 3
    c.merge = lambda p: [5] * n if p == b"zq" * 9 else bpe.merge(p, c.ranks)
    monkeypatch.setattr(bpe, "CHUNK", 1 << 30)
    tokens, offs = c.encode(*T.buffers(pa.array(["zq" * 9, "a word"])))
    assert np.diff(offs).tolist() == [n, 2] and (tokens[:n] == 5).all()


@pytest.mark.parametrize("native", [False, True])
def test_long_texts_in_parts(monkeypatch, reference, native):
    monkeypatch.setattr(T.parts, "__defaults__", (200,))
    monkeypatch.setattr(bpe, "CHUNK", 300)
    r = random.Random(5)
    long = " ".join(r.choice(["it's", "they'll", "x", "漢字", "12 3", "\n\n", "", "don't", "stone"]) for _ in range(3000))
    tx = ["a b", long, None, "q" * 5000, long[::-1], ""]
    data, offs = T.buffers(pa.array(tx))
    tokens, to = bpe.codec(native=native).encode(data, offs)
    for i, t in enumerate(tx):
        assert tokens[to[i] : to[i + 1]].tolist() == reference.encode_ordinary(t or "")
    assert bytes(bpe.codec().decode(tokens, to)[0]) == data.tobytes()
    c = bpe.codec()
    assert c.gives_back(tokens, to, data, offs).all() and len(tokens) > 2 * bpe.CHUNK
    broken = tokens.copy()
    broken[to[1] + 5] = 0
    assert c.gives_back(broken, to, data, offs).tolist() == [True, False, True, True, True, True]


def test_giant_piece(reference):
    p = "abcab" * 20_000
    assert bpe.merge(p.encode(), bpe.codec().ranks) == reference.encode_ordinary(p)


def test_decode_of_odd_tokens(spark):
    c = bpe.codec()
    a = c.ranks[b"a"]
    rows = spark.createDataFrame([(1, [a, c.size, a]), (2, [a, None, -3]), (3, None), (4, []), (None, [a])], "doc_id bigint, tokens array<int>")
    assert sorted(((r.doc_id or 0), r.text) for r in bpe.decode(rows).collect() if r.doc_id != 3) == [(0, "a"), (1, "a\ufffda"), (2, "a\ufffd\ufffd"), (4, "")]
    assert [r.text for r in bpe.decode(rows).where("doc_id = 3").collect()] == [None]
