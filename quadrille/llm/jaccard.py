"""N-gram Jaccard join by T-occurrence search over a partitioned inverted index.

A document is the set of its word n-grams; documents with equal sets are one set, named by a hash of it and shown by its
smallest doc_id. No step is approximate:

1. One pass over the texts counts which n-grams occur in two sets or more. A task takes its documents in chunks, drops
   what repeats within a chunk and sends each n-gram of a chunk once, as 32 bits of its hash and its owner, to the bucket
   of the hash; a bucket answers each chunk with the number of n-grams that others have as well, by owner. Colliding
   hashes only count too many. A set of n n-grams with fewer than threshold * n of them shared is in no pair and goes.
2. The sets that stay, a small part, get the exact frequency of their n-grams in the same way (in 64 bits, each with its
   number of sets in the chunk) and keep those of two sets or more, rarest first. With T = ceil(threshold * n), two similar sets share an n-gram among the first (shared - T + 1) of
   each: these are the short lists of DivideSkip, the rest its long ones.
3. Sets are dealt to shards of at most about SLICE n-grams, by the smallest hash of their n-grams, so that near copies
   lie together; what exceeds a shard is dealt on by the set's hash. A set goes to its own shard and to the later ones
   that hold a set with one of its short lists.
4. Each shard is an inverted index, sets in order of size. A query's lists are cut to the sizes that can reach the
   threshold; the short ones are heap-merged, the long ones binary-probed for sets that can still reach T, and those
   whose similarity reaches the threshold are links. A task adds links up and connects sets; it does not emit them.

Result: one row for each document with a link: doc_id, class_id (the smallest doc_id of the documents connected with it),
n_grams (in its set) and n_links (texts similar to it: copies with the same set and all texts of similar sets).

Defined results: a null or empty text, or one without a word, has no n-grams and no row; a text of fewer words than n is
one n-gram of all its words; a text of any length is used whole; rows with a null doc_id have no row; repeated rows (same
id, same set) count once; an id with several texts has the links of all of them (one with another included), the smallest
of their classes and the largest of their sizes; an empty table gives no rows; columns other than doc_id and text are not
touched.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as T
from quadrille.llm.groups import by_id, components
from quadrille.shared import cut

N = 3
THRESHOLD = 0.5
#: N-grams of a chunk, and documents, whose place in it has 16 bits.
CHUNK, CHUNK_DOCS = 1 << 20, 60_000
#: N-grams of a bucket, about; and buckets at most, beyond which they grow.
BUCKET, MAX_BUCKETS = 1 << 20, 1 << 19
#: N-grams of a shard, and of the queries that a task puts to it.
SLICE = 1 << 21
#: Lists of up to so many sets are always merged.
SHORT = 16
MU = 0.0085
#: Postings merged by a heap; more are merged by one sort, which gives the same.
HEAP = 128
NOBODY = 0xFFFF


def wholes(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """A hash of each set of n-grams."""
    at = np.zeros(len(h) + 1, T.U)
    np.cumsum(T.mix(h), out=at[1:])
    return T.mix((at[o[1:]] - at[o[:-1]]) ^ (np.diff(o).astype(T.U) << T.U(40))).view(np.int64)


def _buckets(grams: int) -> int:
    """A power of two."""
    return min(MAX_BUCKETS, 1 << (grams // BUCKET).bit_length())


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For hashes in order: the buckets, named by the highest bits, and where each begins and ends."""
    of = (h >> T.U(65 - buckets.bit_length())).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return of[at], at, np.append(at[1:], len(of))


class _Chunk:
    """The sets of some documents of a task, each set once."""

    def __init__(self):
        self.docs: list[int] = []
        self.doc_set: list[int] = []
        self.sets: dict[int, int] = {}
        self.size: list[int] = []
        self.grams: list[np.ndarray] = []
        self.load = 0

    def add(self, doc: int, whole: int, grams: np.ndarray) -> None:
        at = self.sets.get(whole)
        if at is None:
            at = self.sets[whole] = len(self.size)
            self.size.append(len(grams))
            self.grams.append(grams)
            self.load += len(grams)
        self.docs.append(doc)
        self.doc_set.append(at)

    def full(self) -> bool:
        return self.load >= CHUNK or len(self.docs) >= CHUNK_DOCS

    def rows(self, chunk: int, buckets: int) -> pa.RecordBatch:
        """One row a bucket with the n-grams it has to count, and one with the documents."""
        h = np.concatenate(self.grams)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(lead, len(h)))
        here = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(self.size))
        h, owner = h[lead], np.where(times > 1, NOBODY, owner[lead]).astype(np.uint16)
        own, cut_at, ends = _by_bucket(h, buckets)
        low = h.astype(np.uint32)
        meta = [np.array(self.docs), np.array(self.doc_set, np.int32), np.array(list(self.sets)), np.array(self.size), here]
        cols = [
            pa.array(np.append(own, -1 - (chunk + (chunk >> 32)) % buckets)),
            pa.array(np.full(len(cut_at) + 1, chunk)),
            pa.array([*(T.blob(low[a:b]) for a, b in zip(cut_at, ends, strict=True)), None], pa.binary()),
            pa.array([*(T.blob(owner[a:b]) for a, b in zip(cut_at, ends, strict=True)), None], pa.binary()),
            pa.array([None] * len(cut_at) + [[T.blob(m) for m in meta]], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", "grams", "owners", "meta"])


def _answers(t: pa.Table) -> pa.Table:
    """A bucket's answer to each chunk: how many of its n-grams others have too, by owner. Rows of documents pass."""
    if t.column("bucket")[0].as_py() < 0:
        return pa.table({"chunk": t.column("chunk"), "owners": pa.array([None] * len(t), pa.binary()), "counts": pa.array([None] * len(t), pa.binary()), "meta": t.column("meta")})
    grams = [np.frombuffer(x, np.uint32) for x in t.column("grams").to_pylist()]
    both = np.sort(np.concatenate(grams))
    known = np.unique(both[1:][both[1:] == both[:-1]])
    del both
    chunk, own, counts = [], [], []
    for c, g, o in zip(t.column("chunk").to_pylist(), grams, t.column("owners").to_pylist(), strict=True):
        o = np.frombuffer(o, np.uint16)
        if len(known):
            at = np.searchsorted(known, g)
            o = o[(known[np.minimum(at, len(known) - 1)] == g) & (o != NOBODY)]
            if len(o):
                n = np.bincount(o)
                who = np.flatnonzero(n)
                chunk.append(c)
                own.append(T.blob(who.astype(np.uint16)))
                counts.append(T.blob(n[who].astype(np.uint32)))
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "owners": pa.array(own, pa.binary()), "counts": pa.array(counts, pa.binary()), "meta": pa.array([None] * len(chunk), pa.list_(pa.binary()))})


def signatures(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, size, whole (hash of the set) and near (whether the set may have a similar one), for documents with n-grams."""
    docs = T.keyed(docs, {"doc_id": "bigint", "text": "string"}).where("doc_id IS NOT NULL AND text IS NOT NULL")
    buckets = _buckets((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, done = TaskContext.get().partitionId() << 32, _Chunk(), 0
        for b in T.small(batches):
            ids = T.id_array(b.column("doc_id")).tolist()
            for first, h, o in T.shingle_sets(*T.buffers(b.column("text"), lower=True), n):
                whole = wholes(h, o).tolist()
                for x in np.flatnonzero(np.diff(o)).tolist():
                    held.add(ids[first + x], whole[x], h[o[x] : o[x + 1]])
                    if held.full():
                        yield held.rows(base + done, buckets)
                        held, done = _Chunk(), done + 1
        if held.docs:
            yield held.rows(base + done, buckets)

    def judge(t: pa.Table) -> pa.Table:
        meta = next(m for m in t.column("meta").to_pylist() if m is not None)
        doc, of, whole, size, have = (np.frombuffer(m, k) for m, k in zip(meta, (np.int64, np.int32, np.int64, np.int64, np.int64), strict=True))
        have = have.copy()
        for o, c in zip(t.column("owners").to_pylist(), t.column("counts").to_pylist(), strict=True):
            if o is not None:
                have[np.frombuffer(o, np.uint16)] += np.frombuffer(c, np.uint32)
        T.release()
        near = have >= np.ceil(threshold * size - 1e-9)
        return pa.table({"doc_id": pa.array(doc), "size": pa.array(size[of]), "whole": pa.array(whole[of]), "near": pa.array(near[of])})

    sent = docs.mapInArrow(chunks, "bucket bigint, chunk bigint, grams binary, owners binary, meta array<binary>")
    back = sent.groupBy("bucket").applyInArrow(_answers, "chunk bigint, owners binary, counts binary, meta array<binary>")
    return back.groupBy("chunk").applyInArrow(judge, "doc_id bigint, size bigint, whole bigint, near boolean")


def merge_short(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sets in sorted lists, and how many lists hold each. Few postings go through a heap, many through one sort."""
    total = sum(map(len, lists))
    if total > HEAP:
        x = np.sort(np.concatenate(lists))
        lead = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return x[lead], np.diff(np.append(lead, len(x)))
    ids, counts = [], []
    for x in heapq.merge(*(y.tolist() for y in lists)):
        if ids and ids[-1] == x:
            counts[-1] += 1
        else:
            ids.append(x)
            counts.append(1)
    return np.array(ids, np.int64), np.array(counts, np.int64)


def t_occurrence(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least `least` of the sorted lists, and of how many (DivideSkip)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(lists) < least:
        return none
    lists = sorted(lists, key=len, reverse=True)
    longest = len(lists[0])
    n_long = min(least - 1, int(least / (MU * math.log2(max(2, longest)) + 1)), sum(len(x) > SHORT for x in lists))
    long, short = lists[:n_long], lists[n_long:]
    ids, counts = merge_short(short)
    keep = counts >= least - n_long
    ids, counts = ids[keep], counts[keep]
    for k, x in enumerate(reversed(long)):
        if not len(ids):
            return none
        at = np.searchsorted(x, ids)
        counts = counts + (x[np.minimum(at, len(x) - 1)] == ids)
        keep = counts >= least - (n_long - k - 1)
        ids, counts = ids[keep], counts[keep]
    return ids, counts


class Index:
    """Inverted lists of a shard's sets. Sets are numbered by size, then name."""

    def __init__(self, node: np.ndarray, size: np.ndarray, grams: list[np.ndarray]):
        order = np.lexsort((node, size))
        self.node, self.size = node[order], size[order]
        self.grams = [grams[i] for i in order]
        tok = np.concatenate(self.grams)
        owner = np.repeat(np.arange(len(order)), [len(g) for g in self.grams])
        by = np.argsort(tok, kind="stable")
        tok, self.post = tok[by], owner[by]
        lead = np.concatenate([[True], tok[1:] != tok[:-1]])
        self.tokens = tok[lead]
        #: List and set of each posting as one number, in order.
        self.place = (np.cumsum(lead) - 1) * len(order) + self.post
        self.at = {x: i for i, x in enumerate(self.node.tolist())}

    def similar(self, grams: np.ndarray, size: int, threshold: float, before: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and overlaps of the sets, of those before a number if given, that are similar to a query."""
        n = len(self.node)
        least = max(1, math.ceil(threshold * size - 1e-9))
        lo = int(np.searchsorted(self.size, least))
        hi = int(np.searchsorted(self.size, math.floor(size / threshold + 1e-9), "right")) if before is None else before
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if lo >= hi:
            return none
        at = np.searchsorted(self.tokens, grams)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == grams]
        a, b = np.searchsorted(self.place, at * n + lo), np.searchsorted(self.place, at * n + hi)
        some = np.flatnonzero(b > a)
        if len(some) < least:
            return none
        ids, both = t_occurrence([self.post[x:y] for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)], least)
        keep = both >= threshold * (size + self.size[ids] - both) - 1e-9
        return ids[keep], both[keep]


class Shard:
    """A shard's index, with the links of its sets added up and the sets connected."""

    def __init__(self, node: np.ndarray, size: np.ndarray, docs: np.ndarray, grams: list[np.ndarray], turn: np.ndarray, threshold: float):
        self.index, self.threshold = Index(node, size, grams), threshold
        order = np.lexsort((node, size))
        self.docs, n = docs[order], len(order)
        self.total, self.label, self.parent = np.zeros(n, np.int64), np.arange(n), list(range(n))
        self.asked: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(turn[order]).tolist():
            ids, _ = self.index.similar(self.index.grams[i], int(self.index.size[i]), threshold, i)
            self.total[i] += self._meet(ids, int(self.docs[i]), i)
        self.index.grams = []

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _meet(self, ids: np.ndarray, docs: int, own: int | None = None) -> int:
        if not len(ids):
            return 0
        self.total[ids] += docs
        labels = np.unique(self.label[ids]).tolist() + ([] if own is None else [int(self.label[own])])
        roots = {self._root(x) for x in labels}
        low = min(roots)
        for x in roots:
            self.parent[x] = low
        self.label[ids] = low
        return int(self.docs[ids].sum())

    def ask(self, node: int, size: int, docs: int, grams: np.ndarray) -> None:
        """A query of another shard."""
        ids, _ = self.index.similar(grams, size, self.threshold)
        if len(ids):
            self.asked.append((node, self._meet(ids, docs), int(self.index.node[ids[0]])))

    def batch(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.total)
        roots = self.index.node[[self._root(int(x)) for x in self.label[some]]] if len(some) else np.zeros(0, np.int64)
        node, links, root = (np.array([x[c] for x in self.asked], np.int64) for c in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((self.index.node[some], node), (self.total[some], links), (roots, root))], ["node", "links", "root"])


def candidates(docs: DataFrame, rep: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, size, docs, need (T) and grams, rarest first, of the sets that may have a similar one."""
    near = cut(rep.where("near").select("doc_id", F.col("whole").alias("node")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen, made = TaskContext.get().partitionId() << 32, set(), 0  # a repeated row counts once
        names, sets, load = [], [], 0

        def flush() -> pa.RecordBatch:
            cols = [pa.array([base + made]), *(pa.array([T.blob(np.array(x))], pa.binary()) for x in (names, [len(x) for x in sets])), pa.array([T.blob(np.concatenate(sets))], pa.binary())]
            names.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays(cols, ["chunk", "nodes", "sizes", "grams"])

        for b in T.small(batches):
            node = b.column("node").to_numpy()
            for first, h, o in T.shingle_sets(*T.buffers(b.column("text"), lower=True), n):
                whole, size = wholes(h, o), np.diff(o)
                for x in np.flatnonzero((whole == node[first : first + len(size)]) & (size > 0)).tolist():  # not another text of the same doc_id
                    if whole[x] not in seen:
                        seen.add(whole[x])
                        names.append(whole[x])
                        sets.append(h[o[x] : o[x + 1]])
                        load += int(size[x])
                        if load >= CHUNK:
                            yield flush()
                            load, made = 0, made + 1
        if names:
            yield flush()

    texts = by_id(T.keyed(docs, {"doc_id": "bigint", "text": "string"}), near, "inner").where("text IS NOT NULL")
    chunks = cut(texts.mapInArrow(shingled, "chunk bigint, nodes binary, sizes binary, grams binary"))
    buckets = _buckets((chunks.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) // 8)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, grams in zip(b.column("chunk").to_pylist(), b.column("grams").to_pylist(), strict=True):
                tok, times = np.unique(np.frombuffer(grams, np.uint64), return_counts=True)
                own, at, ends = _by_bucket(tok, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), chunk)), *(pa.array([T.blob(a[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary()) for a in (tok, np.minimum(times, 0xFFFF).astype(np.uint16)))], ["bucket", "chunk", "tokens", "times"])

    def frequency(t: pa.Table) -> pa.Table:
        tok = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
        times = np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("times").to_pylist()])
        _, back = np.unique(np.concatenate(tok), return_inverse=True)
        df = np.minimum(np.bincount(back, times), 0xFFFF).astype(np.uint16)[back]
        ends = np.cumsum([len(x) for x in tok])
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "df": pa.array([T.blob(x) for x in np.split(df, ends[:-1])], pa.binary())})

    def ordered(left: pa.Table, right: pa.Table) -> pa.Table:
        names, sets = [], []
        if len(left) and len(right):
            right = right.sort_by("bucket")
            node, size, grams = (np.frombuffer(left.column(c)[0].as_py(), k) for c, k in (("nodes", np.int64), ("sizes", np.int64), ("grams", np.uint64)))
            tok, back = np.unique(grams, return_inverse=True)
            df = np.frombuffer(b"".join(right.column("df").to_pylist()), np.uint16)[back]
            owner = np.repeat(np.arange(len(node)), size)
            keep = df > 1
            df, grams, owner = df[keep], grams[keep], owner[keep]
            order = np.lexsort((grams, df, owner))
            grams, at = grams[order], np.searchsorted(owner[order], np.arange(len(node) + 1))
            names = node.tolist()
            sets = [T.blob(grams[i:j]) for i, j in zip(at, at[1:])]
        return pa.table({"node": pa.array(names, pa.int64()), "grams": pa.array(sets, pa.binary())})

    asked = chunks.mapInArrow(ask, "bucket bigint, chunk bigint, tokens binary, times binary")
    df = asked.groupBy("bucket").applyInArrow(frequency, "chunk bigint, bucket bigint, df binary")
    sets = chunks.groupBy("chunk").cogroup(df.groupBy("chunk")).applyInArrow(ordered, "node bigint, grams binary").dropDuplicates(["node"])  # a set that two tasks met
    sets = sets.join(rep.where("near").select(F.col("whole").alias("node"), "size", "docs"), "node")
    need = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("size") - 1e-9)).cast("bigint")
    return sets.withColumn("need", need).where(F.octet_length("grams") / 8 >= F.col("need"))


def _sharded(sets: DataFrame) -> DataFrame:
    """The sets with their shards: the bucket of their smallest hash, dealt on where that is over SLICE n-grams."""

    @F.arrow_udf("bigint")
    def smallest(grams: pa.Array) -> pa.Array:
        return pa.array([int(T.mix(np.frombuffer(g.as_buffer(), np.uint64)).min() >> T.U(1)) for g in grams], pa.int64())

    sets = cut(sets.withColumn("load", F.octet_length("grams") / 8).withColumn("home", smallest("grams")))
    buckets = max(1, math.ceil((sets.agg(F.sum("load")).first()[0] or 0) / SLICE))
    sets = sets.withColumn("home", F.pmod("home", F.lit(buckets)))
    parts = sets.groupBy("home").agg(F.ceil(F.sum("load") / SLICE).cast("bigint").alias("parts"))
    return sets.join(parts, "home").withColumn("shard", F.col("home") * F.lit(1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts")))


def links(sets: DataFrame, threshold: float) -> DataFrame:
    """node, links and root for sets with a similar one: partial sums of links, and nodes connected with a root."""
    sets = cut(_sharded(sets).select("node", "size", "docs", "need", "grams", "shard"))

    def short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, shard, need, g in zip(*(b.column(c).to_pylist() for c in ("node", "shard", "need", "grams")), strict=True):
                tok = np.frombuffer(g, np.int64)
                tok = tok[: len(tok) - need + 1]
                yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(np.full(len(tok), node)), pa.array(np.full(len(tok), shard))], ["token", "node", "shard"])

    posts = sets.mapInArrow(short_lists, "token bigint, node bigint, shard bigint")
    spread = posts.groupBy("token").agg(F.collect_set("shard").alias("shards")).where(F.size("shards") > 1)
    routes = posts.join(spread, "token").select("node", "shard", F.explode("shards").alias("to")).where("to > shard").select("node", F.col("to").alias("shard")).distinct()
    visits = cut(routes.join(sets.drop("shard"), "node").select("shard", "node", "size", "docs", "grams"))
    # Queries of a shard are dealt to parts of SLICE n-grams, each with the shard's sets
    load = sets.select("shard", F.octet_length("grams").alias("x")).unionByName(visits.select("shard", F.octet_length("grams").alias("x"))).groupBy("shard").agg(F.ceil(F.sum("x") / (8 * 2 * SLICE)).cast("int").alias("parts"))
    own = sets.select("shard", "node", "size", "docs", "grams").join(load, "shard")
    data = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(0))
    asked = visits.join(load, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("kind", F.lit(1))
    tasks = data.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "node").withColumn("turn", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int") == F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None

        def build() -> Shard:
            node, size, docs, grams, turn = zip(*held, strict=True)
            held.clear()
            return Shard(np.array(node), np.array(size), np.array(docs), [np.frombuffer(g, np.uint64) for g in grams], np.array(turn), threshold)

        for b in T.small(batches):
            for place, part, kind, node, size, docs, g, turn in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "kind", "node", "size", "docs", "grams", "turn")), strict=True):
                if (place, part) != now:
                    if now is not None:
                        yield (shard or build()).batch()
                    now, shard = (place, part), None
                if kind == 0:
                    held.append((node, size, docs, g, turn))
                    continue
                shard = shard or build()
                shard.ask(node, size, docs, np.frombuffer(g, np.uint64))
        if now is not None:
            yield (shard or build()).batch()
        shard = None
        T.release()

    return tasks.mapInArrow(run, "node bigint, links bigint, root bigint")


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_grams and n_links of the documents whose n-gram sets have a copy or a similar set."""
    sig = cut(signatures(docs, n, threshold))
    texts = sig.select("doc_id", "whole", "size").distinct()
    rep = sig.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.bool_or("near").alias("near"))
    rep = cut(rep.join(texts.groupBy("whole").agg(F.count("*").alias("docs")), "whole"))
    found = cut(links(candidates(docs, rep, n, threshold), threshold))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    ids = rep.select(F.col("whole").alias("node"), "doc_id", "docs")
    named = comps.join(ids, "node")
    named = named.join(named.groupBy("comp").agg(F.min("doc_id").alias("class_id")), "comp").select("node", "class_id")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    sets = ids.join(total, "node", "left").join(named, "node", "left").where("docs > 1 OR links > 0")
    sets = sets.select(F.col("node").alias("whole"), F.coalesce("class_id", "doc_id").alias("class_id"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return texts.join(sets, "whole").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("size").alias("n_grams"), F.sum("n_links").alias("n_links"))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs by brute force; a set is the sorted list of its n-grams, and classes spread along links.
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct([array_to_string(w[i:i + {N - 1}], ' ') FOR i IN range(1, greatest(len(w) - {N - 1}, 1) + 1)])) AS g FROM w WHERE len(w) > 0),
sets AS MATERIALIZED (SELECT g, min(doc_id) AS id, len(g) AS n, count(*) AS docs, row_number() OVER (ORDER BY min(doc_id), g) AS node FROM g GROUP BY g),
item AS (SELECT node, n, unnest(g) AS x FROM sets),
met AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM item a JOIN item b ON a.x = b.x AND a.node <> b.node GROUP BY 1, 2, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= {THRESHOLD}),
walk AS (SELECT node AS a, node AS b FROM sets WHERE node IN (SELECT a FROM met) UNION SELECT walk.a, met.b FROM walk JOIN met ON walk.b = met.a),
class AS (SELECT walk.a AS node, min(sets.id) AS class_id FROM walk JOIN sets ON walk.b = sets.node GROUP BY 1),
links AS (SELECT met.a AS node, sum(sets.docs) AS links FROM met JOIN sets ON met.b = sets.node GROUP BY 1),
s AS (SELECT g, n, coalesce(class_id, id) AS class_id, docs - 1 + coalesce(links, 0) AS n_links FROM sets LEFT JOIN class USING (node) LEFT JOIN links USING (node) WHERE docs > 1 OR links > 0)
SELECT doc_id, min(class_id) AS class_id, max(n)::BIGINT AS n_grams, sum(n_links)::BIGINT AS n_links FROM g JOIN s USING (g) GROUP BY doc_id
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of documents connected by similarity."""
    gone = cut(similar(docs).where("doc_id <> class_id").select("doc_id"))
    return by_id(docs, gone, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
