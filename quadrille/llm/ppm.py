"""Language-model scoring by prediction by partial matching.

A trie of byte contexts up to ORDER bytes long predicts each byte; a byte that a context has not been followed by
costs an escape to the next shorter context (method C: an escape counts as many times as the context has distinct
followers), where the followers of the longer context are excluded. The sum of -log2 of these probabilities is the
document's code length.

Pretrained (the default): the followers of all contexts are counted over all documents, and a node of the trie is kept
if it was seen MIN_COUNT times. Each task counts the byte (ORDER + 1)-grams of its partition; tables of all
partitions are summed by shards, where a shard holds all paths that end in the same bytes, so that the counts of
shorter paths come from the same shard. What is kept of them is dealt to parts of some PART_NODES longest paths, where a
part holds all contexts that end in the same two bytes with all their followers. A part, held as sorted arrays and a
hash table of the costs of its longest paths, is written by the task that sums it and looked up by tasks that map it
into memory. Only orders 0 and 1 (256 and 65,536 paths at most) are gathered. The trie has no cap.

Adaptive: each document starts an empty trie that learns as it is read. This walks bytes one by one in Python.

Defined results: a null or empty text has no bytes, 0 bits and 0 bits a byte; texts of any length are scored whole;
repeated rows score alike; a null doc_id stays null; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as T
from quadrille.shared import cut, fresh_path, local_path

ORDER = 5
MIN_COUNT = 2
PART_NODES = 1_000_000
#: Bytes counted or scored at a time; a dozen 8-byte arrays of that length are held.
COUNT_CHUNK, SCORE_CHUNK = 1 << 21, 1 << 19
SHARD_BYTES, MAX_SHARDS = 64 << 20, 1 << 14


def grams(data: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """At each byte, that byte in the low 8 bits and the bytes before it above; 0 before a document's start."""
    x = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    key = x.copy()
    for s in range(1, order + 1):
        part = x[:-s] << T.U(8 * s)
        part[place[s:] < s] = 0
        key[s:] |= part
    return key


def gram_parts(data: np.ndarray, offs: np.ndarray, order: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of documents, and for parts of a long one: first document, the next one, grams() and their offsets."""
    for i, j in T.chunks(offs, size):
        a, b = int(offs[i]), int(offs[j])
        if j - i == 1 and b - a > 2 * size:
            for x in range(a, b, size):
                lead = min(order, x - a)
                keys = grams(data[x - lead : min(b, x + size)], np.array([0, min(b, x + size) - x + lead]), order)[lead:]
                yield i, j, keys, np.array([0, len(keys)])
        else:
            yield i, j, grams(data[a:b], offs[i : j + 1] - a, order), offs[i : j + 1] - a


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[lead], np.add.reduceat(counts, lead)


def low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & T.U((1 << 8 * n) - 1)


class Trie:
    """Followers of contexts by order, with what escapes and exclusion need of each context."""

    def __init__(self, by_order: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(by_order) - 1
        self.grams, self.counts, self.contexts, self.total, self.distinct, self.parent = [], [], [], [], [], []
        for k, (g, c) in enumerate(by_order):
            ctx = g >> T.U(8)
            order = np.lexsort((g, ctx))
            lead = np.flatnonzero(np.concatenate([[True], ctx[order][1:] != ctx[order][:-1]])) if len(g) else np.zeros(0, np.int64)
            self.grams.append(g)
            self.counts.append(c.astype(np.float64))
            self.contexts.append(ctx[order][lead])
            self.total.append(np.add.reduceat(c[order].astype(np.float64), lead) if len(g) else np.zeros(0))
            self.distinct.append(np.diff(np.append(lead, len(g))).astype(np.float64))
            up = np.zeros(len(g))
            if k and len(g):
                at, has = find(self.grams[k - 1], low(g, k))
                up = np.where(has, self.counts[k - 1][at], 0.0)
            #: The shorter context's counts of all followers of this one.
            self.parent.append(np.add.reduceat(up[order], lead) if len(g) else np.zeros(0))

    def cost(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits and escapes of each gram."""
        n = len(keys)
        bits, escapes, open_ = np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool)
        gone_t, gone_d = np.zeros(n), np.zeros(n)
        for k in range(self.order, -1, -1):
            at, known = find(self.contexts[k], low(keys >> T.U(8), k) if k else np.zeros(n, T.U))
            if not len(self.contexts[k]):
                continue
            g, follows = find(self.grams[k], low(keys, k + 1))
            left, kinds = self.total[k][at] - gone_t, self.distinct[k][at] - gone_d
            hit = open_ & known & follows
            bits[hit] += np.log2((left[hit] + kinds[hit]) / self.counts[k][g[hit]])
            out = open_ & known & ~follows & (kinds > 0)
            bits[out] += np.log2((left[out] + kinds[out]) / kinds[out])
            escapes[open_ & known & ~follows] += 1
            open_ &= ~hit
            gone_t, gone_d = np.where(known, self.parent[k][at], 0.0), np.where(known, self.distinct[k][at], 0.0)
        bits[open_] += np.log2(np.maximum(256 - gone_d[open_], 1))
        return bits, escapes

    def save(self, folder: str, least: int = 0) -> None:
        """Writes the orders from least on."""
        os.makedirs(folder, exist_ok=True)
        for name in ("grams", "counts", "contexts", "total", "distinct", "parent"):
            for k in range(least, self.order + 1):
                np.save(f"{folder}/{name}{k}.npy", getattr(self, name)[k])
        top = self.grams[self.order]
        bits = max(4, int(2 * len(top)).bit_length())
        key, value = np.zeros(1 << bits, T.U), np.zeros(1 << bits, np.float32)
        taken = np.zeros(1 << bits, bool)
        cost = np.concatenate([np.zeros(0, np.float32), *(self.cost(top[i : i + SCORE_CHUNK])[0].astype(np.float32) for i in range(0, len(top), SCORE_CHUNK))])
        rest = top + T.U(1)  # 0 marks an empty place
        at = slot(top, bits)
        while len(rest):
            free = ~taken[at]
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            key[at[won]], value[at[won]], taken[at[won]] = rest[won], cost[won], True
            keep = np.ones(len(rest), bool)
            keep[won] = False
            rest, cost, at = rest[keep], cost[keep], (at[keep] + 1) & ((1 << bits) - 1)
        np.save(f"{folder}/key.npy", key)
        np.save(f"{folder}/value.npy", value)

    @classmethod
    def load(cls, folder: str, order: int, base: Trie | None = None) -> Trie:
        """The trie of a folder; its orders 0 and 1 from base, if given."""
        t = cls.__new__(cls)
        t.order = order
        for name in ("grams", "counts", "contexts", "total", "distinct", "parent"):
            setattr(t, name, [getattr(base, name)[k] if base and k < 2 else np.load(f"{folder}/{name}{k}.npy", mmap_mode="r") for k in range(order + 1)])
        t.key, t.value = np.load(f"{folder}/key.npy", mmap_mode="r"), np.load(f"{folder}/value.npy", mmap_mode="r")
        return t

    def bits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As cost(), by way of the hash table."""
        n, size = len(keys), len(self.key)
        out, escapes = np.zeros(n), np.zeros(n, np.int64)
        want, at, who = keys + T.U(1), slot(keys, size.bit_length() - 1), np.arange(n)
        missed = []
        while len(who):
            got = self.key[at]
            hit = got == want
            out[who[hit]] = self.value[at[hit]]
            empty = got == 0
            missed.append(who[empty])
            go = ~hit & ~empty
            want, at, who = want[go], (at[go] + 1) & (size - 1), who[go]
        m = np.concatenate(missed) if missed else np.zeros(0, np.int64)
        if len(m):
            own, back = np.unique(keys[m], return_inverse=True)
            b, e = self.cost(own)
            out[m], escapes[m] = b[back], e[back]
        return out, escapes


def part_of(keys: np.ndarray, order: int, parts: int) -> np.ndarray:
    """The part of each gram, by the last two bytes of its context."""
    return (T.mix(low(keys >> T.U(8), min(2, order))) % T.U(parts)).astype(np.int64)


class Parts:
    """A trie in parts, each loaded when first asked for; grams of a part without paths are left to orders 0 and 1."""

    def __init__(self, folder: str, order: int):
        self.folder, self.order, self.base = folder, order, Trie.load(folder, order)
        self.sizes = np.load(f"{folder}/parts.npy")
        self.held: dict[int, Trie] = {}

    def part(self, p: int) -> Trie:
        if not self.sizes[p]:
            return self.base
        if p not in self.held:
            self.held[p] = Trie.load(f"{self.folder}/{p}", self.order, self.base)
        return self.held[p]

    def bits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits and escapes of each gram."""
        n = len(self.sizes)
        if n == 1:
            return self.part(0).bits(keys)
        of = part_of(keys, self.order, n)
        by = np.argsort(of, kind="stable")
        at = np.searchsorted(of[by], np.arange(n + 1))
        out, escapes = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        for p in np.flatnonzero(np.diff(at)):
            own = by[at[p] : at[p + 1]]
            out[own], escapes[own] = self.part(int(p)).bits(keys[own])
        return out, escapes


def slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (T.mix(keys) >> T.U(64 - bits)).astype(np.int64)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def train(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, max_nodes: int | None = None) -> str | None:
    """Folder of the trie of all documents; None without any text.

    With max_nodes, the trie is one part of at most so many longest paths, from the most frequent, gathered here.
    """
    texts = T.keyed(docs, {"text": "string"}).where("text IS NOT NULL AND text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return None
    shards = min(MAX_SHARDS, max(32, size // SHARD_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, T.U), np.zeros(0, np.int64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        for b in T.small(batches):
            data, offs = T.buffers(b.column("text"))
            for _, _, made, _ in gram_parts(data, offs, order, COUNT_CHUNK):
                fresh.append(np.unique(made, return_counts=True))
                if sum(len(k) for k, _ in fresh) > len(keys) + 2_000_000:
                    keys, counts = summed(np.concatenate([keys, *(k for k, _ in fresh)]), np.concatenate([counts, *(c for _, c in fresh)]))
                    fresh.clear()
        keys, counts = summed(np.concatenate([keys, *(k for k, _ in fresh)]), np.concatenate([counts, *(c for _, c in fresh)]))
        if not len(keys):
            return
        shard = (T.mix(low(keys, min(3, order + 1))) % T.U(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cut_at = np.searchsorted(shard[by], np.arange(shards + 1))
        own = [s for s in range(shards) if cut_at[s] < cut_at[s + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(pa.array([T.blob(a[by[cut_at[s] : cut_at[s + 1]]]) for s in own], pa.binary()) for a in (keys, counts))], ["shard", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of shard: a shard's tables are summed as they come, so that only distinct paths are held."""
        now, k, c = None, np.zeros(0, T.U), np.zeros(0, np.int64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            nonlocal k, c
            k, c = summed(np.concatenate([k, *(x for x, _ in fresh)]), np.concatenate([c, *(x for _, x in fresh)]))
            fresh.clear()

        for b in batches:
            for shard, keys, counts in zip(*(b.column(n).to_pylist() for n in ("shard", "keys", "counts")), strict=True):
                if shard != now and now is not None:
                    fold()
                    yield orders(k, c)
                    k, c = np.zeros(0, T.U), np.zeros(0, np.int64)
                now = shard
                fresh.append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)))
                if sum(len(x) for x, _ in fresh) > len(k) + 1_000_000:
                    fold()
        if now is not None:
            fold()
            yield orders(k, c)

    def orders(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        rows = []
        for n in range(order, -1, -1):
            k, c = summed(low(k, n + 1), c)
            keep = c >= min_count if n >= 2 or n == order else np.ones(len(c), bool)
            rows.append((n, T.blob(k[keep]), T.blob(c[keep]), [int(x) for x in np.bincount(np.minimum(np.log2(np.maximum(c[keep], 1)).astype(int), 40), minlength=41)]))
        x = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_pydict({"n": pa.array(x[0], pa.int32()), "keys": pa.array(x[1], pa.binary()), "counts": pa.array(x[2], pa.binary()), "hist": pa.array(x[3], pa.list_(pa.int64()))})

    tables = cut(texts.mapInArrow(count, "shard bigint, keys binary, counts binary").repartition("shard").sortWithinPartitions("shard").mapInArrow(add, "n int, keys binary, counts binary, hist array<bigint>"))
    hist = np.zeros(41, np.int64)
    for r in tables.where(F.col("n") == order).select(F.posexplode("hist").alias("b", "x")).groupBy("b").agg(F.sum("x").alias("x")).collect():
        hist[r.b] = r.x
    folder = fresh_path(docs.sparkSession, "ppm")
    place = local_path(folder)
    if max_nodes is not None:
        _one_part(tables, order, min_count, max_nodes, hist).save(place)
        np.save(f"{place}/parts.npy", np.zeros(1, np.int64))
        return folder
    base = []
    for n in range(min(2, order + 1)):
        sums = np.zeros(256 ** (n + 1), np.int64)
        for r in tables.where(F.col("n") == n).select("keys", "counts").toLocalIterator():
            sums[np.frombuffer(r["keys"], np.uint64).astype(np.int64)] += np.frombuffer(r["counts"], np.int64)
        k = np.flatnonzero(sums >= max(1, min_count))
        base.append((k.astype(np.uint64), sums[k]))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    Trie(base + [none] * (order + 1 - len(base))).save(place)
    parts = max(1, -(-int(hist.sum()) // PART_NODES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, keys, counts in zip(*(b.column(c).to_pylist() for c in ("n", "keys", "counts")), strict=True):
                k, c = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                of = part_of(k, order, parts)
                by = np.argsort(of, kind="stable")
                at = np.searchsorted(of[by], np.arange(parts + 1))
                own = [p for p in range(parts) if at[p] < at[p + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([n] * len(own), pa.int32()), *(pa.array([T.blob(a[by[at[p] : at[p + 1]]]) for p in own], pa.binary()) for a in (k, c))], ["part", "n", "keys", "counts"])

    def build(t: pa.Table) -> pa.Table:
        p, made = t.column("part")[0].as_py(), list(base)
        for n in range(2, order + 1):
            own = t.filter(pc.equal(t.column("n"), n))
            k, c = (np.frombuffer(b"".join(own.column(x).to_pylist()), kind) for x, kind in (("keys", np.uint64), ("counts", np.int64)))
            made.append(summed(k, c))
        Trie(made).save(f"{place}/{p}", 2)
        return pa.table({"part": pa.array([p], pa.int64()), "size": pa.array([sum(len(k) for k, _ in made[2:])], pa.int64())})

    sizes = np.zeros(parts, np.int64)
    for r in tables.where("n >= 2").select("n", "keys", "counts").mapInArrow(deal, "part bigint, n int, keys binary, counts binary").groupBy("part").applyInArrow(build, "part bigint, size bigint").collect():
        sizes[r.part] = r["size"]
    np.save(f"{place}/parts.npy", sizes)
    return folder


def _one_part(tables: DataFrame, order: int, min_count: int, max_nodes: int, hist: np.ndarray) -> Trie:
    # Longest paths by power of two of their count, from the most frequent, as many as fit
    at_least = np.cumsum(hist[::-1])[::-1]
    floor = 1 << int(np.argmax(at_least <= max_nodes)) if at_least[0] > max_nodes else 0
    by_order: list[tuple[list, list]] = [([], []) for _ in range(order + 1)]
    for r in tables.select("n", "keys", "counts").toLocalIterator():
        k, c = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)
        keep = c >= floor if r.n >= 2 else np.ones(len(c), bool)
        by_order[r.n][0].append(k[keep])
        by_order[r.n][1].append(c[keep])
    made = []
    for n, (k, c) in enumerate(by_order):
        k, c = summed(np.concatenate(k), np.concatenate(c))
        keep = c >= max(min_count, floor if n >= 2 else 0)
        made.append((k[keep], c[keep]))
    return Trie(made)


class ByteTrie:
    """The same model, byte by byte: for adaptive scoring, and to check the arrays against."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.nodes: dict[bytes, dict[int, int]] = {}

    def learn(self, before: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            ctx = before[len(before) - k :]
            followers = self.nodes.setdefault(ctx, {})
            followers[symbol] = followers.get(symbol, 0) + 1

    def prune(self, least: int) -> None:
        self.nodes = {c: kept for c, f in self.nodes.items() if (kept := {s: n for s, n in f.items() if n >= least})}

    def cost(self, before: bytes, symbol: int) -> tuple[float, int]:
        bits, escapes, gone = 0.0, 0, set()
        for k in range(self.order, -1, -1):
            f = self.nodes.get(before[len(before) - k :])
            if f is None:
                continue
            left = {s: n for s, n in f.items() if s not in gone}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return bits + math.log2(total / left[symbol]), escapes
            if left:
                bits += math.log2(total / len(left))
            escapes += 1
            gone |= f.keys()
        return bits + math.log2(max(1, 256 - len(gone))), escapes

    def code(self, text: bytes, learn: bool = True) -> tuple[float, int]:
        """Bits and escapes of a text; context before its start is zero bytes."""
        padded, bits, escapes = bytes(self.order) + text, 0.0, 0
        for i in range(self.order, len(padded)):
            b, e = self.cost(padded[i - self.order : i], padded[i])
            bits, escapes = bits + b, escapes + e
            if learn:
                self.learn(padded[i - self.order : i], padded[i])
        return bits, escapes


SCHEMA = "doc_id bigint, n_bytes bigint, bits double, bits_per_byte double, escapes bigint"


def score(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, adaptive: bool = False) -> DataFrame:
    """doc_id, n_bytes, bits, bits_per_byte and escapes of each document."""
    folder = None if adaptive else train(docs, order, min_count)
    place = folder and local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Parts(place, order) if place else None
        for b in T.small(batches):
            data, offs = T.buffers(b.column("text"))
            n = np.diff(offs)
            bits, escapes = np.zeros(len(n)), np.zeros(len(n), np.int64)
            if trie is None:
                for d in range(len(n)):
                    bits[d], escapes[d] = ByteTrie(order).code(data[offs[d] : offs[d + 1]].tobytes())
            else:
                for i, j, keys, o in gram_parts(data, offs, order, SCORE_CHUNK):
                    full = np.flatnonzero(np.diff(o))
                    if len(full):
                        x, e = trie.bits(keys)
                        bits[i + full] += np.add.reduceat(x, o[full])
                        escapes[i + full] += np.add.reduceat(e, o[full])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(np.round(bits, 4)), pa.array(np.round(bits / np.maximum(n, 1), 6)), pa.array(escapes)], ["doc_id", "n_bytes", "bits", "bits_per_byte", "escapes"])

    return T.keyed(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, SCHEMA)


def op6_ppm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
