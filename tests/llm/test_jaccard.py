import itertools
import random
import re

import numpy as np
import pytest

from quadrille.llm import jaccard
from quadrille.llm.groups import components

from .conftest import prose


def grams(text, n=3):
    w = re.findall(rb"(?:[A-Za-z0-9]|[\x80-\xff])+", (text or "").lower().encode())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.5, n=3):
    """doc_id to (class, n-grams, links) by comparing all texts; a text is an id and a set."""
    texts = list(dict.fromkeys((i, frozenset(grams(t, n))) for i, t in rows if i is not None and grams(t)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(texts)
    for (x, (_, a)), (y, (_, b)) in itertools.combinations(enumerate(texts), 2):
        if len(a & b) / len(a | b) >= threshold:
            links[x] += 1
            links[y] += 1
            parent[find(y)] = find(x)
    classes = {}
    for x, (i, _) in enumerate(texts):
        classes[find(x)] = min(i, classes.get(find(x), i))
    out = {}
    for x, (i, a) in enumerate(texts):
        if links[x]:
            c, n, k = out.get(i, (classes[find(x)], 0, 0))
            out[i] = (min(c, classes[find(x)]), max(n, len(a)), k + links[x])
    return out


def result(df):
    return {r.doc_id: (r.class_id, r.n_grams, r.n_links) for r in df.collect()}


def edited(text, seed, share):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), int(share * len(w))):
        w[i] = "edit" + str(r.random())
    return " ".join(w)


def corpus():
    rows, i = [], 0
    passage = prose(999, 60)
    for base in range(25):
        text = prose(base, 40 + 15 * base)
        for copy in range(base % 5):
            rows.append((i, edited(text, i, 0.04 * copy) if copy else text))
            i += 1
        rows.append((i, f"{prose(base + 500, 200)} {passage} {prose(base + 700, 200)}"))
        i += 1
    return rows + [(1000 + k, rows[0][1]) for k in range(30)]


def test_equals_brute_force(make):
    assert result(jaccard.similar(make(corpus()))) == brute(corpus())


@pytest.mark.parametrize(("chunk", "docs", "bucket", "share"), [(500, 60_000, 200, 400), (1 << 20, 3, 1 << 20, 3000), (1, 1, 50, 1 << 21)])
def test_chunks_buckets_and_shards_change_nothing(make, monkeypatch, chunk, docs, bucket, share):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", docs)
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "SLICE", share)
    rows = corpus()
    assert result(jaccard.similar(make(rows).repartition(3))) == brute(rows)


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_other_thresholds(make, threshold):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdef") for _ in range(r.randint(1, 9)))) for i in range(120)]
    assert result(jaccard.similar(make(rows), 2, threshold)) == brute(rows, threshold, 2)


@pytest.mark.parametrize("seed", range(6))
def test_t_occurrence(seed, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 2)
    r = random.Random(seed)
    lists = [np.array(sorted(r.sample(range(40), r.randint(1, 30 if k % 4 == 0 else 4))), np.int64) for k in range(20)]
    count = np.bincount(np.concatenate(lists), minlength=40)
    for least in range(1, 12):
        ids, n = jaccard.t_occurrence(lists, least)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {i: c for i, c in enumerate(count) if c >= least}


def test_heap_and_sort_merge_alike(monkeypatch):
    lists = [np.array(x, np.int64) for x in ([1, 5, 9], [1, 2], [9], [1, 9, 12])]
    a = jaccard.merge_short(lists)
    monkeypatch.setattr(jaccard, "HEAP", 0)
    b = jaccard.merge_short(lists)
    assert a[0].tolist() == b[0].tolist() == [1, 2, 5, 9, 12] and a[1].tolist() == b[1].tolist() == [3, 1, 1, 3, 1]


def test_odd_rows(odd):
    assert {i: (c, k) for i, (c, _, k) in result(jaccard.similar(odd)).items()} == {5: (5, 1), 6: (5, 1)}
    assert jaccard.similar(odd.limit(0)).count() == 0


def test_one_id_with_two_texts(make):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(1, 50)), (3, edited(prose(2, 50), 1, 0.04))]
    got = result(jaccard.similar(make(rows)))
    assert got == brute(rows) and {i: c for i, (c, _, _) in got.items()} == {1: 1, 2: 1, 3: 1}


def test_stage_keeps_one_of_each_group(make, odd):
    docs = make(corpus())
    kept = jaccard.stage(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns
    found = brute(corpus())
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in corpus() if i not in found or found[i][0] == i}
    assert jaccard.stage(docs.sparkSession, odd, "").count() == odd.count() - 1  # only doc 6 goes


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
