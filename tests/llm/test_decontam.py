import random
import re

import pyarrow as pa
import pytest

from quadrille.llm import decontam
from quadrille.llm import text as T

from .conftest import prose

ITEM = "A train leaves at 9:30 and travels 120 km in two hours with Maria Lopez on board, so how fast does the train of Maria Lopez go over 120 km today?"
OTHER = ITEM.replace("9:30", "10:45").replace("120", "350").replace("two", "seven").replace("Maria Lopez", "John")
BROKEN = ITEM.replace("120 km in", "350 km in").replace("Maria Lopez on", "John on")


@pytest.fixture
def bench(spark):
    rows = [(1, ITEM), (2, "What is the capital of the country that lies north of the great river"), (3, "short and plain item"), (4, ""), (5, None), (6, "9 8 7 6 5")]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id bigint, text string, doc_id string")


def kinds(text):
    t = decontam.templates(*T.buffers(pa.array([text])))
    return t.kind.tolist()


def test_templates():
    L, N, U, P = decontam.LITERAL, decontam.NUMBER, decontam.UNIT, decontam.NAME
    assert kinds("we met Ann Lee in Paris. Then 3.5 km, 1,000 people km") == [L, L, P, L, P, L, N, U, N, U, L]
    assert kinds("ALL CAPS HERE and two hours é") == [L, L, L, L, N, U, L]
    assert kinds("") == [] and kinds("...") == []
    same = decontam.templates(*T.buffers(pa.array(["say É Then Él", "SAY é Then él"])))
    assert same.token[0] == same.token[3] and same.token[1] == same.token[4] and same.kind[:3].tolist() == [L, L, P]


def test_reparameterised_is_caught_and_inconsistent_is_told_apart(bench, make):
    docs = make([(1, prose(1, 60) + ". " + ITEM + " " + prose(2, 40)), (2, prose(3, 60) + ".\n" + OTHER), (3, prose(4, 30) + ". " + BROKEN), (4, prose(5, 200)), (5, "x. What is the capital of the country that lies north of the great river"), (6, "here: short and plain item"), (7, ITEM.upper())])
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench, all_matches=True).collect()}
    assert set(got) >= {(1, 1), (2, 1), (3, 1), (5, 2), (6, 3)} and not any(d == 4 for d, _ in got)
    assert got[1, 1].contaminated and got[1, 1].same_values and got[1, 1].coverage == 1.0
    assert got[2, 1].contaminated and not got[2, 1].same_values and got[2, 1].slots >= 6
    assert not got[3, 1].consistent and not got[3, 1].contaminated
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {k for k, r in got.items() if r.contaminated}
    kept = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert kept >= {3, 4} and not kept & {1, 2, 5, 6}


def test_one_changed_value_leaves_the_rest_of_a_copy(bench, make, spark, tmp_path):
    docs = make([(3, prose(4, 30) + ". " + BROKEN), (2, OTHER), (4, prose(5, 200))])
    got = {r.doc_id: r for r in decontam.leaks(docs, bench, runs=True).collect()}
    assert set(got) == {2, 3} and got[3].coverage > 0.5 and got[2].coverage == 1.0
    assert {r.doc_id for r in decontam.clean(docs, bench, runs=True).collect()} == {4}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in decontam.op2_decontaminate(spark, str(tmp_path)).collect()} == {2, 3}
    assert {r.doc_id for r in decontam.stage(spark, docs, str(tmp_path)).collect()} == {4}


def test_windows_of_few_ordinary_words_match_word_for_word(spark, make):
    items = [(1, "What is 12 times 7?"), (2, "Compute 345 + 678"), (3, "9 8 7 6 5"), (4, "add 11 12 13 14 15 16 17 18 19 and 20")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make([(10 + i, f"{prose(i, 30)}. {t} {prose(50 + i, 30)}") for i, t in items] + [(21, "What is 13 times 7?"), (22, "Compute 345 + 679"), (23, "9 8 7 6 4"), (24, "add 12 11 13 14 15 16 18 17 19 and 20")])
    assert {(r.doc_id, r.item_id, r.coverage) for r in decontam.leaks(docs, bench).collect()} == {(10 + i, i, 1.0) for i in range(1, 5)}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {21, 22, 23, 24}


def test_longest_consistent_run():
    g = __import__("random").Random(5)
    for _ in range(300):
        slot = {i: (g.randrange(1, 3), g.randrange(3), g.randrange(3)) for i in range(30) if g.random() < 0.4}
        at = [(p, 4) for p in range(27) if g.random() < 0.7]
        tokens = lambda ws: {x for p, w in ws for x in range(p, p + w)}
        pairs = lambda ws: {slot[x] for x in tokens(ws) if x in slot}
        most = max((len(tokens(at[i:j])) for i in range(len(at)) for j in range(i + 1, len(at) + 1) if decontam._one_to_one(pairs(at[i:j]))), default=0)
        same = [w for w in at if all(u == v for _, u, v in pairs([w]))]
        got = decontam._consistent_part(at, slot)
        assert set(same) <= set(got) and len(tokens(got)) >= most
        best = [at[i:j] for i in range(len(at)) for j in range(i, len(at) + 1) if len(tokens(at[i:j])) == most and decontam._one_to_one(pairs(at[i:j]))]
        assert any(set(got) == set(same) | set(r) for r in best)


NUMBER = re.compile(r"[0-9]")


def plain_tokens(text):
    """(kind, value) of each template token, by a walk over the words."""
    words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text or "")]
    kinds = []
    for i, (s, _, w) in enumerate(words):
        before = text[:s].rstrip(" \t")
        opens = i == 0 or before[-1] in ".!?:;\n\r\"([{|"
        if w[0].isdigit() and w[0].isascii() or w.lower() in decontam.NUMBER_WORDS:
            kinds.append("number")
        elif i and kinds[-1] == "number" and w.lower() in decontam.UNITS:
            kinds.append("unit")
        elif "A" <= w[0] <= "Z" and not (len(w) > 1 and ("A" <= w[1] <= "Z" or w[1].isdigit())) and len(w) > 1 and not opens:
            kinds.append("name")
        else:
            kinds.append("word")
    out = []
    for i, (s, e, w) in enumerate(words):
        between = text[words[i - 1][1] : s] if i else ""
        digits = i and w[0].isdigit() and words[i - 1][2][0].isdigit() and len(between) == 1 and between in ".,:/-"
        if digits or i and kinds[i] == kinds[i - 1] == "name" and between == " ":
            out[-1][1] = text[out[-1][2] : e].lower()
        else:
            out.append([kinds[i], w.lower(), s])
    return [(k, v) for k, v, _ in out]


def brute(rows, items, k=decontam.K, coverage=decontam.MIN_COVERAGE, runs=True):
    """(document, item): windows, coverage, slots, consistent, same; by comparing all windows of token lists."""
    out = {}
    for i, text in rows:
        d = plain_tokens(text)
        for j, u in items:
            q = plain_tokens(u)
            w, lines, hits = min(len(q), k), {}, 0
            for x in range(len(q) - w + 1) if q else ():
                few = sum(kind == "word" for kind, _ in q[x : x + w]) < decontam.MIN_LITERALS
                form = lambda ts, few=few: [t if few or t[0] == "word" else (t[0], "") for t in ts]
                for y in range(len(d) - w + 1):
                    if form(d[y : y + w]) == form(q[x : x + w]) and few == (sum(kind == "word" for kind, _ in d[y : y + w]) < decontam.MIN_LITERALS):
                        lines.setdefault(y - x, []).append((x, few))
                        hits += 1
            if not hits:
                continue
            good, every, slots, same = set(), set(), 0, True
            for diagonal, found in lines.items():
                at = [x for x, few in found if not few]
                pairs = lambda ws, diagonal=diagonal: {(q[x + n][0], q[x + n][1], d[x + n + diagonal][1]) for x in ws for n in range(w) if q[x + n][0] != "word"}
                fits = lambda ws, pairs=pairs: len(pairs(ws)) == len({p[:2] for p in pairs(ws)}) == len({p[::2] for p in pairs(ws)})
                tokens = lambda ws: {x + n for x in ws for n in range(w)}
                own = tokens(at) if fits(at) else set()
                if not fits(at) and runs:
                    run = max((at[a:b] for a in range(len(at)) for b in range(a + 1, len(at) + 1) if fits(at[a:b])), key=lambda ws: len(tokens(ws)), default=[])
                    own = tokens(run) | tokens(x for x in at if all(p[1] == p[2] for p in pairs([x])))
                exact = tokens(x for x, few in found if few)
                own |= exact
                every |= tokens(at) | exact
                good |= own
                inner = [x for x in own if q[x][0] != "word"]
                slots = max(slots, len(inner))
                same &= all(q[x][1] == d[x + diagonal][1] for x in inner)
            out[i, j] = (hits, round(len(good or every) / len(q), 6), slots, bool(good), bool(good) and same)
    return out


def test_plain_tokens_are_the_templates():
    for text in [ITEM, OTHER, "we met Ann Lee in Paris. Then 3.5 km, 1,000 people km", "x. The Two km and 5 A B", ""]:
        t = decontam.templates(*T.buffers(pa.array([text])))
        assert [["word", "number", "unit", "name"][k] for k in t.kind] == [k for k, _ in plain_tokens(text)]


@pytest.mark.parametrize("runs", [False, True])
def test_equals_brute_force(spark, make, runs):
    g = random.Random(4)

    def varied(text):
        swap = {w: str(g.randint(1, 400)) for w in ("120", "9", "30")} | {"Maria Lopez": g.choice(["John", "Ann Lee", "Maria Lopez"]), "two": g.choice(["two", "seven"])}
        for a, b in swap.items():
            text = text.replace(a, b, 1 if g.random() < 0.4 else -1)
        w = text.split()
        cut = g.randint(0, len(w) // 2)
        return " ".join(w[cut : cut + g.randint(min(6, len(w)), len(w))])

    items = [(1, ITEM), (2, OTHER), (3, BROKEN), (50, prose(3, 5)), (51, "What is 12 times 7?"), *((10 + i, prose(i, 12 + i)) for i in range(8))]
    rows = [(i, f"{prose(100 + i, 15)}. {varied(g.choice(items)[1])} {prose(200 + i, 10)}") for i in range(60)]
    got = {(r.doc_id, r.item_id): (r.windows, r.coverage, r.slots, r.consistent, r.same_values) for r in decontam.leaks(make(rows), spark.createDataFrame(items, "item_id bigint, text string"), all_matches=True, runs=runs).collect()}
    want = brute(rows, items, runs=runs)
    assert got == want and len(want) > 40 and any(not x[3] for x in want.values()) != runs


def test_many_items_of_one_template(spark, make):
    items = [(i, ITEM.replace("120", str(200 + i))) for i in range(300)]
    docs = make([(i, ITEM.replace("120", str(900 + i))) for i in range(40)])
    assert decontam.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).count() == 300 * 40


def test_long_texts_in_parts_change_nothing(monkeypatch):
    text = " ".join(f"{prose(i, 40)}. {OTHER if i % 3 else BROKEN} The 7 km\nmiles. Two. km and Ann. Lee ran" for i in range(40))
    data, offs = T.buffers(pa.array([text, "short", text[:5000]]))
    want = decontam.templates(data, offs)
    monkeypatch.setattr(T, "CHUNK_BYTES", 300)
    monkeypatch.setattr(decontam, "WINDOWS", 50)
    own, _ = T.parts(data, offs, decontam._after_sentence)
    assert len(own) > 30
    got = decontam.templates(data, offs)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_slices_of_the_benchmark(spark, make, bench, monkeypatch):
    docs = make([(1, ITEM), (2, "here: short and plain item"), (3, prose(9, 50))])
    want = sorted(tuple(r) for r in decontam.leaks(docs, bench).collect())
    monkeypatch.setattr(decontam, "SLICE_BYTES", 60)
    assert sorted(tuple(r) for r in decontam.leaks(docs, bench).collect()) == want
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {3}


def test_odd_rows(odd, bench):
    assert decontam.leaks(odd, bench).count() == 0
    assert decontam.clean(odd, bench).count() == odd.count()
    assert decontam.clean(odd, bench).columns == odd.columns
    assert decontam.leaks(odd, bench.limit(0)).count() == 0 and decontam.leaks(odd.limit(0), bench).count() == 0
    assert decontam.clean(odd, bench.limit(0)).count() == odd.count()
