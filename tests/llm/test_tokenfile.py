import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from quadrille.llm import bpe, tokenfile
from quadrille.llm import text as T


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=bpe.PIECE, mergeable_ranks=bpe.codec().ranks, special_tokens={})


def test_token_files(spark, odd, reference):
    rows = tokenfile.write(odd.repartition(3)).collect()
    folder = rows[0].folder
    reader = tokenfile.TokenReader(spark, folder)
    want = sorted((r.doc_id or 0, reference.encode_ordinary(r.text or "")) for r in odd.collect())
    assert sorted((r.doc_id or 0, reader.document(r.file, r.doc_in_part).tolist()) for r in rows) == want
    assert reader.kind == np.dtype("<u2")
    total = sum(r.n_tokens for r in rows)
    whole = reader.span(0, total)
    assert len(whole) == total
    for r in rows:  # offsets in the whole lead to the same tokens
        assert whole[r.token_start : r.token_start + r.n_tokens].tolist() == reader.document(r.file, r.doc_in_part).tolist()
    starts = sorted((r.token_start, r.n_tokens) for r in rows)
    assert all(a + n == b or n == 0 or a + n <= b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert tokenfile.write(odd.limit(0)).count() == 0


def test_lost_tokens_are_seen():
    c, (data, offs) = bpe.codec(native=True), T.buffers(pa.array(["some words here", None, "and more"]))
    tokens, to = c.encode(data, offs)
    assert c.gives_back(tokens, to, data, offs).all()
    assert not c.gives_back(tokens[:-1], np.minimum(to, len(tokens) - 1), data, offs).all()
    assert not c.gives_back(tokens, np.where(to == to[1], to[1] - 1, to), data, offs).all()
