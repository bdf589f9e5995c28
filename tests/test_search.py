"""Chunks, keyword index, vectors and fusion."""

import math

import pytest

from quadrille.functions.terms import XSD, Quad, iri, literal, quads_from
from quadrille.operators import search as S
from quadrille.operators.filters import Criteria, QuadFilter
from quadrille.operators.store import QuadStore
from quadrille.session import ChunkIndex, GraphSession


def lit(s, p, text, **k):
    return Quad(iri(f"urn:{s}"), iri(f"urn:{p}"), literal(text, **k))


def test_chunk_counts(spark):
    def n(quads, splitter):
        return S.chunk_quads(quads_from(spark, quads), splitter).count()

    short = [lit("a", "p", "one line")]
    assert n(short, S.recursive(1000, 200)) == 1
    assert n([lit("a", "p", "first line\nsecond one")], S.recursive(10, 0)) > 1
    assert n([Quad(iri("urn:a"), iri("urn:p"), iri("urn:b"))], S.recursive(1000, 0)) == 0
    assert n([lit("a", "p", "1", datatype=XSD + "integer"), lit("a", "p", "true", datatype=XSD + "boolean"), lit("a", "p", "2024-01-01", datatype=XSD + "date")], S.fixed()) == 0
    assert n([lit("a", "p", "x", datatype=XSD + "string"), lit("a", "q", "y", lang="en")], S.fixed()) == 2
    assert n([lit("a", "p", "")], S.fixed()) == 0
    assert [r.value for r in S.chunk_quads(quads_from(spark, [lit("a", "p", "abcdefg")]), S.fixed(3)).orderBy("position").collect()] == ["abc", "def", "g"]


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (25, 5), (1000, 200), (7, 3)])
def test_recursive_pieces(size, overlap):
    text = "alpha beta gamma\n\ndelta epsilon zeta eta\ntheta " + "x" * 40 + " iota kappa"
    pieces = S.split_recursive(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    assert all(any(w in p for p in pieces) for w in ("alpha", "delta", "iota") if len(w) <= size)
    if overlap == 0:
        assert "".join("".join(pieces).split()) == "".join(text.split())


def test_computed_ids_and_order(spark):
    from pyspark.sql import functions as F

    q = quads_from(spark, [lit("a", "p", "x"), lit("b", "p", "y")])
    assert {r.quad_id for r in S.chunk_quads(q, ids=F.col("s")).collect()} == {"urn:a", "urn:b"}


def test_embeddings(spark):
    e = S.ConstantEmbedding()
    assert e.embed([]) == [] and len(e.embed(["a", "b"])[1]) == 32 and sum(e.embed(["x"])[0]) == 1.0
    calls = []

    def flaky(texts):
        calls.append(list(texts))
        if len(calls) == 1:
            raise OSError("once")
        return [[float(len(t))] for t in texts]

    assert S.CallableEmbedding(flaky, batch=2).embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]
    assert calls == [["a", "bb"], ["a", "bb"], ["ccc"]]
    assert S.CallableEmbedding(flaky).embed([]) == []
    with pytest.raises(OSError):
        S.CallableEmbedding(lambda t: (_ for _ in ()).throw(OSError()), max_retries=1).embed(["x"])
    with pytest.raises(InterruptedError):
        S.CallableEmbedding(flaky, aborted=lambda: True).embed(["x"])
    h = S.HashedEmbedding(64)
    a, b, c = h.embed(["red apple tree", "red apple trees", "quantum flux"])
    assert sum(x * y for x, y in zip(a, b, strict=True)) > sum(x * y for x, y in zip(a, c, strict=True))


def test_rrf(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 1.0)], "id string, score double")
    b = spark.createDataFrame([("y", 9.0), ("x", 8.0)], "id string, score double")
    got = {r.id: r.score for r in S.rrf([a, b], ["id"]).collect()}
    assert math.isclose(got["x"], (1 / 61 + 1 / 62) * 61 / 2) and math.isclose(got["x"], got["y"]) and got["z"] < got["x"]


def test_ranks_of_whole_lists(spark):
    rows = [(i, (i * 7919) % 1000 // 3 / 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, score double").repartition(7)
    want = {i: r + 1 for r, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert {r.id: r.rank for r in S.ranked(df, ["id"]).collect()} == want


def test_fusion_sees_hits_deep_in_a_list(spark):
    at = lambda a: [math.cos(a), math.sin(a)]
    rows = [(f"k{i:03}", ["w"] + ["x"] * i, at(0.011 * 101) if i == 12 else [-1.0, 0.0]) for i in range(1, 13)]
    rows += [(f"v{i:03}", ["y"], at(0.011 * i)) for i in range(1, 101)]
    index = spark.createDataFrame([(q, 0, q, "p", "", q, " ".join(t), t, e) for q, t, e in rows], "quad_id string, position int, subject string, predicate string, graph string, value string, fts_value string, terms array<string>, embedding array<double>")
    best = S.search_index(index, "w", "hybrid", S.ConstantEmbedding(2), top_k=1).collect()
    assert [r.subject for r in best] == ["k012"] and math.isclose(best[0].score, (1 / 72 + 1 / 161) * 61 / 2)


@pytest.fixture(scope="module")
def indexed(spark):
    store = QuadStore(spark)
    index = ChunkIndex(store, S.HashedEmbedding(128))
    s = GraphSession(store, None, index)
    s.import_({"kind": "quads", "quads": [lit("apple", "text", "a red fruit from a tree"), lit("pear", "text", "a green fruit"), lit("car", "text", "a red machine on wheels"), lit("car", "notes", "long " * 600 + "needle"), lit("n", "age", "42", datatype=XSD + "integer")]})
    return s


def test_hybrid(indexed):
    got = indexed.search("red fruit", top_k=3).collect()
    assert got[0].subject == "urn:apple" and len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert [r.subject for r in indexed.search("needle", top_k=1).collect()] == ["urn:car"]
    assert {r.subject for r in indexed.search("red", include={"subjects": ["urn:car"]}).collect()} == {"urn:car"}
    assert indexed.search("red fruit", min_score=1.1).collect() == []
    assert indexed.search("unheard").where("score >= 0.9").count() == 0


def test_reindex(indexed):
    all_ = indexed.reindex()
    assert all_["processed_quad_count"] == 5 and all_["chunk_row_count"] > 5
    assert indexed.reindex() == all_
    some = indexed.reindex(filter=QuadFilter(Criteria(predicates=["urn:text"])), read_page_size=10)
    assert some == {"processed_quad_count": 3, "chunk_row_count": 3}


def test_keyword_only(spark):
    store = QuadStore(spark)
    s = GraphSession(store, None, ChunkIndex(store, on_import="incremental"))
    s.import_({"kind": "quads", "quads": [lit("a", "p", "blue sky"), lit("b", "p", "blue blue sea")]})
    got = s.search("blue sea").collect()
    assert [r.subject for r in got] == ["urn:b", "urn:a"] and got[0].score == 1.0
    with pytest.raises(ValueError):
        ChunkIndex(store, on_import="sometimes")
    with pytest.raises(ValueError):
        S.search_index(s.index.table, "x", "semantic")


def test_postings_are_pruned_and_score_alike(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = ["the red fox", "red red wine", "a fox and a fox", "nothing here", "", "wine of the fox " * 5]
    index = spark.createDataFrame([(f"q{i}", 0, t) for i, t in enumerate(texts)], "quad_id string, position int, value string")
    index = index.select("quad_id", "position", F.lit("s").alias("subject"), F.lit("p").alias("predicate"), F.lit("").alias("graph"), "value", S.words(F.col("value")).alias("terms"))
    S.write_postings(index.where("quad_id < 'q3'"), f"{tmp_path}/a")
    S.write_postings(index.where("quad_id >= 'q3'"), f"{tmp_path}/b")
    for query in ("red fox", "wine", "missing", ""):
        got = S.bm25_postings(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], query)
        assert {(r.quad_id, round(r.bm25, 9)) for r in got.collect()} == {(r.quad_id, round(r.bm25, 9)) for r in S.bm25(index, query).collect()}
    plan = S.bm25_postings(spark, [f"{tmp_path}/a"], "red fox")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan


def test_incremental_index_adds_only_new_chunks(spark):
    from quadrille.operators.store import QuadStore
    from quadrille.session import ChunkIndex, GraphSession
    from quadrille.sparql.engine import SparqlEngine

    store = QuadStore(spark)
    s = GraphSession(store, SparqlEngine(spark, store=store), ChunkIndex(store, on_import="incremental"))
    add = lambda text, mode="merge": s.import_({"kind": "serialized", "data": text}, mode)
    add('<urn:a> <urn:p> "red fox" .')
    assert len(s.index.parts) == 1
    add('<urn:a> <urn:p> "red fox" . <urn:b> <urn:p> "blue fox" .')
    assert len(s.index.parts) == 2 and s.index.table.count() == 2
    assert [r.subject for r in s.search("blue").collect()] == ["urn:b"]
    assert sorted(r.subject for r in s.search("fox").collect()) == ["urn:a", "urn:b"]
    assert [r.subject for r in s.search("fox", include={"subjects": ["urn:b"]}).collect()] == ["urn:b"]
    add('<urn:c> <urn:p> "green" .', "replace")
    assert len(s.index.parts) == 1 and s.search("fox").count() == 0 and s.search("green").count() == 1


def test_ids_of_texts_are_computed_before_they_are_cut(spark):
    plan = S.chunk_quads(quads_from(spark, [lit("a", "p", "abcdefg")]), S.fixed(3))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan.split("Generate")[0] and "sha2" in plan.split("Generate")[1]


def test_fixed_pieces_of_wide_letters(spark):
    text = "a\n𝄞b𝄞𝄞\r\néß" * 41 + "z"
    got = [r.value for r in S.chunk_quads(quads_from(spark, [lit("a", "p", text)]), S.fixed(7)).orderBy("position").collect()]
    assert got == [text[i : i + 7] for i in range(0, len(text), 7)]


def test_hashes_of_many_texts_at_a_time():
    from zlib import crc32

    def counts(text):
        v = [0] * 32
        for w in text.lower().split():
            for g in [w, *(f"^{w}$"[i : i + 3] for i in range(len(w)))]:
                h = crc32(g.encode())
                v[h % 32] += 1 if h >> 31 else -1
        return v

    texts = ["", " \n", "a", "Ab cd\tab", "Straße ÉÎ 日本語 x𝄞\U0010ffff", "\0 ^$ $^"] + [f"n{i} " * (i % 5) for i in range(200)]
    for t, v in zip(texts, S.HashedEmbedding(32).embed(texts), strict=True):
        n = math.sqrt(sum(x * x for x in counts(t))) or 1.0
        assert v == [x / n for x in counts(t)]


def test_best_of_fused_lists_without_ranking_them(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(f"r{(i * 7919) % 2003:04}", i % 3, (i * 31) % 400 / 8, (i * 17) % 250 / 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "q string, p int, a double, b double").repartition(5)
    pick = lambda c, which: df.where(which).select("q", "p", F.col(c).alias("score"))
    top = lambda d: [(r.q, r.p, round(r.score, 12)) for r in d.orderBy(F.desc(F.round("score", 12)), "q", "p").limit(3).collect()]
    pairs = [[pick("a", "true"), pick("b", "true")], [pick("a", "p = 0"), pick("b", "p <> 0")], [pick("a", "a > 49.8"), pick("b", "b < 9")], [pick("a", "false"), pick("b", "true")]]
    want = [top(S.rrf(x, ["q", "p"])) for x in pairs]
    twice = [pick("a", "true").unionByName(pick("b", "p = 1")), pick("b", "true")]
    assert top(S.rrf_best(twice, ["q", "p"], 3)) == top(S.rrf(twice, ["q", "p"]))
    monkeypatch.setattr(S, "ranked", None)
    assert [top(S.rrf_best(x, ["q", "p"], 3)) for x in pairs] == want


def test_similarity_in_python_as_in_sql(spark):
    rows = spark.createDataFrame([(t,) for t in ("red fox", "a fox", "", None, "wine of the fox " * 9)], "fts_value string")
    service = S.HashedEmbedding(16)
    q = service.embed(["red fox"])[0]
    made = S.embedded(rows, service)
    got = rows.select(S.similarity(rows, service, q).alias("c")).collect()
    assert got == made.select(S.similarity(made, service, q).alias("c")).collect() and [r.c is None for r in got] == [False, False, True, True, False]


def test_postings_are_written_from_one_reading_with_repeated_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    texts = ["the red fox", "the red fox", "red red wine", "wine " * 700 + "red", "", None, None, "nothing here"]
    rows = spark.createDataFrame([(f"q{min(i, 6)}" if i > 1 else "q1", 0, t) for i, t in enumerate(texts)], "quad_id string, position int, value string")
    index = rows.select("quad_id", "position", F.lit("s").alias("subject"), F.lit("p").alias("predicate"), F.lit("").alias("graph"), "value", S.words(counted("value")).alias("terms"))
    S.write_postings(index, f"{tmp_path}/a", buckets=3)
    assert read.value == len(texts)
    for query in ("red fox", "wine", "here the"):
        got = {r.quad_id: round(r.bm25, 9) for r in S.bm25_postings(spark, [f"{tmp_path}/a"], query).collect()}
        assert got == {r.quad_id: round(r.x, 9) for r in S.bm25(index, query).groupBy("quad_id").agg(F.sum("bm25").alias("x")).collect()}
