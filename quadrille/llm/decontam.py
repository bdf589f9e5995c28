"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so that a question asked again with other parameters has
the same template. Windows of K template tokens of the benchmark form a hash table; windows of the documents are
joined with it. Matches of a document with an item on one diagonal (document position minus item position) are an
alignment; within it each slot value of the item must stand for one value in the document and the other way round,
else the slots are inconsistent. With `runs`, as the query and the pipeline ask for, an inconsistent alignment still
counts by its longest run of windows that is consistent, and by all windows whose slot values are the item's own;
without, it counts for nothing. A document is contaminated by an item when consistent alignments cover at least
MIN_COVERAGE of the item's tokens.

Number: a word that begins with a digit (with what follows after . , : / or - before another digit), or a number
word. Unit: a unit word right after a number. Name: capitalised words that do not begin a sentence, neighbours taken
together; words in capitals throughout are ordinary words. Other words count without case.

A window of fewer than MIN_LITERALS ordinary words says too little as a template and is joined on its exact values.

The hash table is made in slices of some SLICE_BYTES of benchmark text, by tasks, as files in the shared folder. A task
reads its documents once and holds one slice at a time, so that neither a task nor the driver holds what grows with the
benchmark. All that is done for a pair of document and item is done for all pairs of a chunk at once; only alignments
with inconsistent slots are looked at one by one.

Defined results: a null or empty text matches nothing and is kept; an item without a word matches nothing; an item of
fewer than K tokens is one window of all its tokens, so that one of few ordinary words is found where it stands word for
word, be it a single word; texts of any length are used whole, long ones read in parts that begin at the end of a sentence; repeated rows are judged alike; equal items are reported each; an empty table on either
side gives no rows; a null doc_id or item_id stays null; other columns are not touched.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import files
from quadrille.llm import text as T
from quadrille.shared import cut, fresh_path

K = 8
MIN_LITERALS = 4
MIN_COVERAGE = 0.3
SLICE_BYTES = 32 << 20
#: Windows looked up at a time.
WINDOWS = 1 << 20
LITERAL, NUMBER, UNIT, NAME = range(4)
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles g kg mg lb lbs pound pounds oz ounce ounces ton tons tonne
tonnes l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month
months year years percent usd eur dollar dollars euro euros cent cents hz khz mhz ghz kb mb gb tb byte bytes bit bits w kw mw watt watts
v volt volts a amp amps k degree degrees celsius fahrenheit mph kmh people times meter meters metre metres kilometer kilometers gram
grams kilogram kilograms""".split()
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
_SLOT = T.mix(np.arange(11, 15, dtype=np.uint64) * T.U(0x9E3779B97F4A7C15))
_EXACT = T.U(0xD6E8FEB86659FD93)
_DIGIT = np.array([48 <= i < 58 for i in range(256)])
_UPPER = np.array([65 <= i < 91 for i in range(256)])
_JOINS = np.isin(np.arange(256), list(b".,:/-"))
_STOPS = np.isin(np.arange(256), list(b".!?:;\n\r\"([{|"))
_ENDS = np.isin(np.arange(256), list(b".!?\n"))
_BLANK = np.isin(np.arange(256), list(b" \t"))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals lowered, at the same places."""
    out = data.copy()
    out[_UPPER[data]] += 32
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 32
    return out


def _hashes(words: list[str]) -> np.ndarray:
    data, offs = T.buffers(pa.array(words))
    return np.sort(T.span_hash(data, offs[:-1], offs[1:]))


_unit_hashes = _hashes(UNITS)
_number_hashes = _hashes(NUMBER_WORDS)


class Templates(NamedTuple):
    token: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    offs: np.ndarray


def _after_sentence(data: np.ndarray) -> np.ndarray:
    """Where a part may begin: behind a word that is no number, if the last sign before the next word ends a sentence."""
    at = np.zeros(len(data), bool)
    s, e, _ = T.words(data, np.array([0, len(data)]))
    if len(s) < 4:
        return at
    s, e, after = s[1:-2], e[1:-2], s[2:-1]  # the outer words may be cut off
    number = _DIGIT[data[s]] | np.isin(T.span_hash(lowered(data), s, e), _number_hashes)
    seen = np.maximum.accumulate(np.where(_BLANK[data], -1, np.arange(len(data))))
    at[e[~number & _ENDS[data[np.maximum(seen[after - 1], 0)]] & (seen[after - 1] >= e)]] = True
    return at


def templates(data: np.ndarray, offs: np.ndarray) -> Templates:
    """Template tokens of a chunk of documents: hash, hash of what stood there, kind, and n + 1 offsets."""
    own, first = T.parts(data, offs, _after_sentence)
    if len(own) == len(offs):
        return _templates(data, offs)
    made = [_templates(data[own[i] : own[j]], own[i : j + 1] - own[i]) for i, j in T.chunks(own)]
    total = np.zeros(len(own), np.int64)
    np.cumsum(np.concatenate([np.diff(t.offs) for t in made]), out=total[1:])
    return Templates(*(np.concatenate([t[c] for t in made]) for c in range(3)), total[first])


def _templates(data: np.ndarray, offs: np.ndarray) -> Templates:
    low = lowered(data)
    s, e, wo = T.words(data, offs)
    n = len(s)
    if not n:
        return Templates(np.zeros(0, T.U), np.zeros(0, T.U), np.zeros(0, np.int8), wo)
    first = T.doc_starts(n, wo)
    h = T.span_hash(low, s, e)
    digit = _DIGIT[data[s]]
    number = digit | np.isin(h, _number_hashes)
    b0 = data[s]
    b1 = np.where(e - s > 1, data[np.minimum(s + 1, len(data) - 1)], 65)
    latin = (b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E) & (b1 != 0x97)
    capital = (_UPPER[b0] & ~_UPPER[b1] & ~_DIGIT[b1]) | (latin & (e - s > 2))
    # What stands last before a word, blanks left out
    seen = np.maximum.accumulate(np.where(_BLANK[data], -1, np.arange(len(data))))
    before = np.where(s > 0, seen[np.maximum(s - 1, 0)], -1)
    opens = first | (before < 0) | _STOPS[data[np.maximum(before, 0)]]
    name = capital & ~opens & ~number
    unit = np.zeros(n, bool)
    unit[1:] = np.isin(h[1:], _unit_hashes) & number[:-1] & ~first[1:]
    unit &= ~number
    name &= ~unit
    gap = np.zeros(n, np.int64)
    gap[1:] = s[1:] - e[:-1]
    between = data[np.maximum(s - 1, 0)]
    inner = np.zeros(n, bool)
    inner[1:] = ~first[1:] & (gap[1:] == 1) & ((digit[1:] & digit[:-1] & _JOINS[between[1:]]) | (name[1:] & name[:-1] & (between[1:] == 32)))
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, LITERAL))).astype(np.int8)
    lead = np.flatnonzero(~inner)
    last = np.append(lead[1:], n) - 1
    value = T.span_hash(low, s[lead], e[last])
    kind = kind[lead]
    return Templates(np.where(kind == LITERAL, value, _SLOT[kind]), value, kind, np.searchsorted(lead, wo))


class Benchmark(NamedTuple):
    ids: list
    tokens: Templates
    widths: dict  # window width -> (sorted hashes, item of each, position of each)


def _windows(t: Templates, width: int, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and first token of the windows of the documents in `of`, some at a time: of the template where it holds enough
    ordinary words, else of the exact values."""
    n = np.maximum(np.diff(t.offs)[of] - width + 1, 0)
    at = T.ragged(t.offs[:-1][of], n)
    for x in range(0, len(at), WINDOWS):
        own = at[x : x + WINDOWS]
        a, b = int(own[0]), int(own[-1]) + width
        token, value, kind, own = t.token[a:b], t.value[a:b], t.kind[a:b], own - a
        words = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(kind == LITERAL, out=words[1:])
        h = T.window_hash(token, width)[own]
        few = words[own + width] - words[own] < MIN_LITERALS
        if few.any():
            exact = np.where(kind == LITERAL, value, T.mix(value ^ _SLOT[kind]))
            h[few] = T.mix(T.window_hash(exact, width)[own[few]] ^ _EXACT)
        yield h, own + a


def prepare(items: list[tuple]) -> Benchmark:
    """The hash table of a benchmark's (item_id, text) rows."""
    data, offs = T.buffers(pa.array([x for _, x in items], pa.large_string()))
    t = templates(data, offs)
    n = np.diff(t.offs)
    widths = {}
    for w in sorted({min(int(x), K) for x in n if x}):
        h, at = (np.concatenate(x) for x in zip(*_windows(t, w, np.flatnonzero(np.minimum(n, K) == w)), strict=True))
        order = np.argsort(h, kind="stable")
        if len(h):
            widths[w] = (h[order], np.searchsorted(t.offs, at[order], "right") - 1, at[order])
    return Benchmark([i for i, _ in items], t, widths)


def _one_to_one(pairs: set[tuple[int, int, int]]) -> bool:
    return len(pairs) == len({(k, u) for k, u, _ in pairs}) == len({(k, v) for k, _, v in pairs})


def _consistent_part(at: list[tuple[int, int]], slot: dict[int, tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of windows (first token, width) in order: the run with one value for each value that covers most tokens, and all
    windows with equal values. slot gives kind, the item's value and the document's of the tokens that are slots."""
    inside = [[slot[x] for x in range(p, p + w) if x in slot] for p, w in at]
    pairs: Counter = Counter()
    left: Counter = Counter()
    right: Counter = Counter()
    best, most, i = (0, 0), 0, 0

    def add(x: tuple[int, int, int]) -> None:
        pairs[x] += 1
        if pairs[x] == 1:
            left[x[0], x[1]] += 1
            right[x[0], x[2]] += 1

    def drop(x: tuple[int, int, int]) -> None:
        pairs[x] -= 1
        if not pairs[x]:
            left[x[0], x[1]] -= 1
            right[x[0], x[2]] -= 1

    covered = 0  # tokens of windows i to j
    for j, (p, w) in enumerate(at):
        for x in inside[j]:
            add(x)
        covered += w - max(0, at[j - 1][0] + at[j - 1][1] - p) if j > i else w
        while i <= j and any(left[k, u] > 1 or right[k, v] > 1 for k, u, v in inside[j]):
            for x in inside[i]:
                drop(x)
            covered -= min(at[i][1], at[i + 1][0] - at[i][0]) if i < j else at[i][1]
            i += 1
        if covered > most:
            best, most = (i, j + 1), covered
    return [x for n, x in enumerate(at) if best[0] <= n < best[1] or all(u == v for _, u, v in inside[n])]


class Matches(NamedTuple):
    """A row for each document and item that share a window."""

    doc: np.ndarray
    item: np.ndarray
    windows: np.ndarray
    coverage: np.ndarray
    slots: np.ndarray
    consistent: np.ndarray
    same: np.ndarray


def _hits(t: Templates, bench: Benchmark) -> np.ndarray:
    """Document, item, diagonal, item token and width of each shared window, in order."""
    found = [np.zeros((0, 5), np.int64)]
    for w, (table, item, at) in bench.widths.items():
        for h, pos in _windows(t, w, np.arange(len(t.offs) - 1)):
            lo = np.searchsorted(table, h)
            ok = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == h)
            if len(ok):
                lo, hi = lo[ok], np.searchsorted(table, h[ok], "right")
                rows, p = T.ragged(lo, hi - lo), np.repeat(pos[ok], hi - lo)
                found.append(np.stack([np.searchsorted(t.offs, p, "right") - 1, item[rows], p - at[rows], at[rows], np.full(len(p), w)], axis=1))
    x = np.concatenate(found)
    return x[np.lexsort(x.T[::-1])]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row, of rows in order, differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _tokens(group: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, token) that windows cover, in order."""
    g, x = np.repeat(group, width), T.ragged(at, width)
    order = np.lexsort((x, g))
    g, x = g[order], x[order]
    keep = _starts(g, x)
    return g[keep], x[keep]


def _distinct(group: np.ndarray, n: int, *columns: np.ndarray) -> np.ndarray:
    """For each of n groups, how many distinct rows it has."""
    order = np.lexsort((*columns, group))
    return np.bincount(group[order][_starts(group[order], *(c[order] for c in columns))], minlength=n)


def match(t: Templates, bench: Benchmark, runs: bool = False) -> Matches:
    """What documents share with items."""
    x = _hits(t, bench)
    b = bench.tokens
    new_pair, new_line = _starts(x[:, 0], x[:, 1]), _starts(x[:, 0], x[:, 1], x[:, 2])
    pair, line = np.cumsum(new_pair) - 1, np.cumsum(new_line) - 1  # a line is an alignment: a pair's diagonal
    lines = int(new_line.sum())
    doc, item = x[new_pair, 0], x[new_pair, 1]
    diagonal, of = x[new_line, 2], pair[new_line]
    ordinary = np.zeros(len(b.kind) + 1, np.int64)
    np.cumsum(b.kind == LITERAL, out=ordinary[1:])
    exact = ordinary[x[:, 3] + x[:, 4]] - ordinary[x[:, 3]] < MIN_LITERALS
    g, y = _tokens(line[~exact], x[~exact, 3], x[~exact, 4])
    slot = b.kind[y] != LITERAL
    sg, kind, u, v = g[slot], b.kind[y[slot]], b.value[y[slot]], t.value[y[slot] + diagonal[g[slot]]]
    both = _distinct(sg, lines, kind, u, v)
    broken = (both != _distinct(sg, lines, kind, u)) | (both != _distinct(sg, lines, kind, v))
    every_g, every_y = g, y
    keep = ~broken[g]
    good_g, good_y = g[keep], y[keep]
    if runs and broken.any():
        more: list[tuple[int, int, int]] = []
        rows, bounds = np.flatnonzero(~exact), np.arange(lines + 1)
        first, slot_first = np.searchsorted(line[rows], bounds), np.searchsorted(sg, bounds)
        for n in np.flatnonzero(broken):
            own, own_slots = rows[first[n] : first[n + 1]], slice(slot_first[n], slot_first[n + 1])
            values = dict(zip(y[slot][own_slots].tolist(), zip(kind[own_slots].tolist(), u[own_slots].tolist(), v[own_slots].tolist(), strict=True), strict=True))
            more += [(n, p, w) for p, w in _consistent_part(list(map(tuple, x[own, 3:].tolist())), values)]
        if more:
            extra = _tokens(*np.array(more).T)
            good_g, good_y = np.concatenate([good_g, extra[0]]), np.concatenate([good_y, extra[1]])
    # Exact windows are equal by their hash, whatever the other slots are
    exact_g, exact_y = _tokens(line[exact], x[exact, 3], x[exact, 4])
    one = np.ones(len(exact_g) + len(good_g), np.int64)
    good_g, good_y = _tokens(np.concatenate([good_g, exact_g]), np.concatenate([good_y, exact_y]), one)
    every_g, every_y = _tokens(np.concatenate([every_g, exact_g]), np.concatenate([every_y, exact_y]), np.ones(len(every_g) + len(exact_g), np.int64))
    n = len(doc)
    consistent = np.bincount(of[good_g], minlength=n) > 0
    covered = np.where(consistent, _distinct(of[good_g], n, good_y), _distinct(of[every_g], n, every_y))
    slot = b.kind[good_y] != LITERAL
    sg, sy = good_g[slot], good_y[slot]
    slots = np.zeros(n, np.int64)
    np.maximum.at(slots, of, np.bincount(sg, minlength=lines))
    differs = np.bincount(of[sg], b.value[sy] != t.value[sy + diagonal[sg]], minlength=n) > 0
    return Matches(doc, item, np.bincount(pair, minlength=n), covered / np.diff(b.offs)[item] if n else np.zeros(0), slots, consistent, consistent & ~differs)


def _slices(benchmark: DataFrame) -> list[str]:
    """Files of the benchmark's hash table."""
    items = T.keyed(benchmark, {"item_id": "bigint", "text": "string"}).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // SLICE_BYTES))
    folder = fresh_path(benchmark.sparkSession, "benchmark")
    files.make_dir(folder)

    def build(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("item_id").to_pylist(), t.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0], r[1]))
        uri = f"{folder}/{uuid.uuid4().hex}"
        files.write(uri, pickle.dumps(prepare(rows)))
        return pa.table({"file": [uri]})

    made = cut(items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).groupBy("slice").applyInArrow(build, "file string"))
    return sorted(r.file for r in made.collect())


_held: dict[str, Benchmark] = {}


def _load(uri: str) -> Benchmark:
    """A slice, from this worker's memory if it was the last."""
    if uri not in _held:
        _held.clear()
        _held[uri] = pickle.loads(files.read(uri))
    return _held[uri]


def matches(column: pa.Array, slices: list[str], runs: bool) -> Iterator[tuple[Benchmark, Matches]]:
    """By slice and chunk, what a batch's documents (by row) share with items."""
    data, offs = T.buffers(column)
    made = [(i, templates(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in T.chunks(offs)]
    for uri in slices:
        bench = _load(uri)
        for i, t in made:
            m = match(t, bench, runs)
            yield bench, m._replace(doc=m.doc + i)


def leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, all_matches: bool = False, runs: bool = False) -> DataFrame:
    """doc_id, item_id, windows, coverage, slots, consistent, same_values, contaminated for every document and item that
    contaminates it; with all_matches, for every two that share a template window."""
    names = ["doc_id", "item_id", "windows", "coverage", "slots", "consistent", "same_values", "contaminated"]
    slices = _slices(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.small(batches):
            for bench, m in matches(b.column("text"), slices, runs):
                bad = m.consistent & (m.coverage >= min_coverage)
                take = np.arange(len(m.doc)) if all_matches else np.flatnonzero(bad)
                if len(take):
                    items = pa.array([bench.ids[i] for i in m.item[take]], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(m.doc[take])), items, *(pa.array(c[take]) for c in (m.windows, np.round(m.coverage, 6), m.slots, m.consistent, m.same, bad))], names)

    schema = "doc_id bigint, item_id bigint, windows bigint, coverage double, slots bigint, consistent boolean, same_values boolean, contaminated boolean"
    return T.keyed(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, runs: bool = False) -> DataFrame:
    """The rows of docs that no item contaminates, with their own columns."""
    slices = _slices(benchmark)

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        out, at = np.ones(len(texts), bool), 0
        for part in T.slices(texts):
            for _, m in matches(part, slices, runs):
                out[at + m.doc[m.consistent & (m.coverage >= min_coverage)]] = False
            at += len(part)
        return pa.array(out)

    return T.modest(docs).where(kept(F.col("text")))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), runs=True)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), runs=True)
