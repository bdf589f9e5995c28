"""Exact top-k search by two cover trees, one of queries and one of data, descended together.

A node of a cover tree is a vector (its center), the vectors below it and its covering radius, the largest distance from
the center to any of them. Its children's centers, of which its own is one, lie more than half its radius apart and cover
it at half its radius; a node of up to LEAF vectors, or of equal ones, is a leaf, and so are, LEAF at a time, a node's children
of one or two vectors, of which a net in many dimensions has most. Data is dealt to its nearest one of
some pivots, and a pivot's vectors, in parts of at most PART, become one tree each, a file in the shared folder; the trees'
roots are the children of one root. The queries of a pivot become a tree of queries.

A task descends a tree of queries and the trees of data together, nearest roots first. A pair of nodes is pruned, with all
pairs below it, when the distance of their centers less both covering radii exceeds the worst kth distance among the
queries of the query node. Of other pairs the node of the larger radius is replaced by its children, nearest first; a pair
of leaves is compared in one matrix product, and what it may add is confirmed from the vectors as given.

Queries are the vectors whose id is divisible by `every` (all with 1), data are all vectors. Result: query_id, rank (from
1), neighbor_id and Euclidean distance, k rows for each query if there are as many other ids.

Defined results: vectors that are null or empty or hold a null, NaN or infinity, and rows with a null vec_id, are
neither queries nor data; only vectors of the same length are compared; a repeated row (same id and vector) counts
once; an id with several vectors is a query with each, and a neighbour with its nearest, so that it takes one rank; a
vector is not a neighbour of its own id; ties go to the smaller id; bounds are compared on vectors divided by a common power
of two, so that large finite values don't overflow (a distance beyond the largest double is Infinity); an empty table gives
no rows; columns other than these two are not touched.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import files
from quadrille.shared import cut, fresh_path

TOP = 10
EVERY = 100
#: Vectors a pivot aims at, pivots at most, and vectors of a tree at most.
GROUP, MAX_PIVOTS, PART = 1024, 4096, 16384
#: Queries of a task at most.
QUERIES = 16384
LEAF, QUERY_LEAF = 32, 8
#: Bytes of trees that a task keeps.
HELD_BYTES = 64 << 20
SCHEMA = "query_id bigint, rank int, neighbor_id bigint, distance double"


def distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, from a matrix product."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0)


def exact(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """Distances of rows as given, also where squares would overflow or vanish."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        diff = a - b
        d = np.sqrt((diff * diff).sum(axis=1))
        for i in np.flatnonzero(~np.isfinite(d) | (d < 1e-140)):
            one, unit = (diff[i], 1.0) if np.isfinite(diff[i]).all() else (a[i] / scale - b[i] / scale, scale)
            m = np.abs(one).max()
            d[i] = 0.0 if m == 0 else m * np.sqrt(((one / m) ** 2).sum()) * unit
    return d


class CoverTree:
    """Nodes in arrays. A node's vectors are rows start to end; its children are nodes first to first + number."""

    ARRAYS = ("ids", "x", "start", "end", "center", "radius", "first", "number")

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: float, leaf: int = LEAF):
        xs = x / scale
        order: list[np.ndarray] = []
        nodes: list[list] = []  # start, end, center's row, radius, first child, children
        done = 0
        # A node is split when its turn comes, depth first; its children get their numbers at once
        mid = int(((xs - xs.mean(axis=0)) ** 2).sum(axis=1).argmin())
        todo = [(0, np.arange(len(x)), mid)]
        nodes.append([0, 0, mid, 0.0, 0, 0])
        while todo:
            node, rows, center = todo.pop()
            d = np.sqrt(((xs[rows] - xs[center]) ** 2).sum(axis=1))
            radius = float(d.max())
            nodes[node][:4] = [done, done + len(rows), center, radius]
            if len(rows) <= leaf or radius <= 1e-12:
                order.append(rows)
                done += len(rows)
                continue
            net, owner, near = [center], np.zeros(len(rows), np.int64), d
            while near.max() > radius / 2:
                far = int(near.argmax())
                own = np.sqrt(((xs[rows] - xs[rows[far]]) ** 2).sum(axis=1))
                closer = own < near
                closer[far] = True
                owner[closer] = len(net)
                near = np.where(closer, own, near)
                near[far] = 0.0
                net.append(int(rows[far]))
            # Children of one or two vectors are put together: a node of its own for each would cost more than comparing it
            by = np.argsort(owner, kind="stable")
            sizes = np.bincount(owner, minlength=len(net))
            groups, at, loose = [], 0, []
            for c, n in enumerate(sizes.tolist()):
                own = by[at : at + n]
                at += n
                if n > 2:
                    groups.append((rows[own], net[c]))
                elif n:
                    loose.append(own)
            for i in range(0, len(loose), leaf):
                own = np.concatenate(loose[i : i + leaf])
                groups.append((rows[own], int(rows[own[0]])))
            if len(groups) == 1:  # no split came of it
                order.append(rows)
                done += len(rows)
                continue
            nodes[node][4:] = [len(nodes), len(groups)]
            for own, c in groups:
                todo.append((len(nodes), own, c))
                nodes.append([0, 0, c, 0.0, 0, 0])
        # All below a node are placed before its neighbours, so that its rows are one range
        rows = np.concatenate(order)
        self.ids, self.x = ids[rows], x[rows]
        self.start, self.end, self.first, self.number = np.array([n[:2] + n[4:] for n in nodes]).T
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        self.center, self.radius = place[[n[2] for n in nodes]], np.array([n[3] for n in nodes])
        self._scaled(scale)

    def _scaled(self, scale: float) -> None:
        self.scale, self.xs = scale, self.x / scale
        self.centers = self.xs[self.center]

    def save(self, uri: str) -> None:
        files.save_arrays(uri, **{n: getattr(self, n) for n in self.ARRAYS})

    @classmethod
    def load(cls, uri: str, scale: float) -> CoverTree:
        t = cls.__new__(cls)
        t.__dict__ |= files.load_arrays(uri)
        t._scaled(scale)
        return t

    def bytes(self) -> int:
        return 3 * self.x.nbytes

    def children(self, node: int) -> np.ndarray:
        return np.arange(self.first[node], self.first[node] + self.number[node])


class Search:
    """The k nearest ids of each query of a tree, while trees of data are met."""

    def __init__(self, queries: CoverTree, k: int):
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.ids, self.dist = [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
        self.worst = np.full(n, np.inf)
        self.seen: Counter = Counter()  # pairs compared or pruned, by kind
        self.slack = 1e-7 * max(1e-300, float(np.abs(queries.xs).max()) if n else 0.0, 1.0) * math.sqrt(max(1, queries.x.shape[1]))

    def bound(self, node: int) -> float:
        return float(self.worst[self.q.start[node] : self.q.end[node]].max())

    def meet(self, data: CoverTree) -> None:
        q, stack = self.q, [(0.0, 0, 0)]
        while stack:
            lower, a, b = stack.pop()
            if lower > self.bound(a) + self.slack:
                self.seen["pruned internal" if q.number[a] or data.number[b] else "pruned leaves"] += 1
                continue
            if not q.number[a] and not data.number[b]:
                self.seen["compared leaves"] += 1
                self._compare(a, data, b)
                continue
            self.seen["descended"] += 1
            split_data = not q.number[a] or (data.number[b] and data.radius[b] >= q.radius[a])
            own = data.children(b) if split_data else q.children(a)
            one, many = (q.centers[a], data.centers[own]) if split_data else (data.centers[b], q.centers[own])
            far = np.sqrt(((many - one) ** 2).sum(axis=1))
            low = far - (q.radius[a] + data.radius[own] if split_data else data.radius[b] + q.radius[own])
            near = np.argsort(-far, kind="stable")
            stack += [(float(low[i]), a, int(own[i])) if split_data else (float(low[i]), int(own[i]), b) for i in near]

    def _compare(self, a: int, data: CoverTree, b: int) -> None:
        s, e, u, v = self.q.start[a], self.q.end[a], data.start[b], data.end[b]
        d2 = distances2(self.q.xs[s:e], data.xs[u:v])
        d2[self.q.ids[s:e, None] == data.ids[None, u:v]] = np.inf
        hit = d2 <= ((self.worst[s:e] + self.slack) ** 2)[:, None]
        for i in np.flatnonzero(hit.any(axis=1)):
            cols = np.flatnonzero(hit[i] & np.isfinite(d2[i]))
            if len(cols) > 4 * self.k:  # the vectors of one id may be many, so that the bound is by ids
                least = np.sort(_nearest_by_id(d2[i, cols], data.ids[u + cols]))
                if len(least) >= self.k:
                    cols = cols[np.sqrt(d2[i, cols]) <= math.sqrt(least[self.k - 1]) + 2 * self.slack]
            if not len(cols):
                continue
            dist = exact(np.broadcast_to(self.q.x[s + i], (len(cols), self.q.x.shape[1])), data.x[u + cols], self.q.scale)
            ids, dist = np.concatenate([self.ids[s + i], data.ids[u + cols]]), np.concatenate([self.dist[s + i], dist])
            order = np.lexsort((dist, ids))
            order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
            order = order[np.lexsort((ids[order], dist[order]))][: self.k]
            self.ids[s + i], self.dist[s + i] = ids[order], dist[order]
            if len(order) == self.k:
                self.worst[s + i] = dist[order[-1]] / self.q.scale

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(self.q.ids, [len(x) for x in self.ids]), np.concatenate([np.zeros(0, np.int64), *self.ids]), np.concatenate([np.zeros(0), *self.dist])


def _nearest_by_id(d: np.ndarray, ids: np.ndarray) -> np.ndarray:
    order = np.argsort(ids, kind="stable")
    return np.minimum.reduceat(d[order], np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]])))


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", group: int = GROUP) -> DataFrame:
    """query_id, rank, neighbor_id and distance of the k nearest others of each query."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    v = v.where("id IS NOT NULL AND size(x) > 0 AND NOT exists(x, e -> e IS NULL OR isnan(e) OR abs(e) = double('Infinity'))")
    folder = fresh_path(spark, "covertree")
    files.make_dir(folder)
    found = None
    stats = v.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.count_if(F.col("id") % every == 0).alias("asked")).orderBy("d").collect()
    for r in stats:
        if r.asked:
            part = _one_length(v.where(F.size("x") == r.d), r, k, every, group, folder)
            found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def _one_length(v: DataFrame, stats, k: int, every: int, group: int, folder: str) -> DataFrame:
    spark, size, n = v.sparkSession, stats.d, stats.n
    scale = 2.0 ** math.floor(math.log2(stats.most)) if stats.most > 0 else 1.0
    pivots = min(MAX_PIVOTS, max(1, n // group))
    draw = F.pmod(F.xxhash64("id", "x"), F.lit(1 << 40))
    share = -int(-min(1.0, (1.5 * pivots + 100) / n) * (1 << 40) // 1)
    chosen = np.array([r.x for r in v.withColumn("draw", draw).where(F.col("draw") < share).orderBy("draw", "id").limit(pivots).select("x").collect()])
    shared = spark.sparkContext.broadcast(chosen / scale)
    cores = spark.sparkContext.defaultParallelism

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    @F.arrow_udf("int")
    def nearest(x: pa.Array) -> pa.Array:
        a = matrix(x) / scale
        return pa.array(np.concatenate([np.zeros(0, np.int32), *(distances2(a[i : i + 1024], shared.value).argmin(axis=1).astype(np.int32) for i in range(0, len(a), 1024))]))

    def dealt(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
        """The rows with their pivot and, where that has over `most` rows, their part of it; and how many groups that gives."""
        rows = cut(rows.withColumn("pivot", nearest("x")))
        counts = rows.groupBy("pivot").agg(F.ceil(F.count("*") / most).cast("bigint").alias("parts"))  # a row a pivot
        total = counts.agg(F.sum("parts")).first()[0]
        rows = rows.join(F.broadcast(counts), "pivot").withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("parts")))
        return rows.select("pivot", "part", "id", "x").repartition(max(1, min(total, 4 * cores)), "pivot", "part"), total

    def tree(t: pa.Table, leaf: int) -> CoverTree:
        t = t.combine_chunks()
        ids, x = t.column("id").to_numpy(), matrix(t.column("x").combine_chunks())
        order = np.lexsort((*x.T, ids))
        ids, x = ids[order], x[order]
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
        return CoverTree(ids[keep], x[keep], scale, leaf)

    def build(t: pa.Table) -> pa.Table:
        made = tree(t, LEAF)
        name = f"{folder}/{size}-{uuid.uuid4().hex}.npz"
        made.save(name)
        return pa.table({"file": pa.array([name]), "center": pa.array([made.centers[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([float(made.radius[0])])})

    roots = cut(dealt(v, PART)[0].groupBy("pivot", "part").applyInArrow(build, "file string, center array<double>, radius double")).collect()
    top = f"{folder}/{size}-top.npz"
    files.save_arrays(top, center=np.array([r.center for r in roots]), radius=np.array([r.radius for r in roots]), tree=np.array([r.file for r in roots]))

    def search(t: pa.Table) -> pa.Table:
        q, whole = tree(t, QUERY_LEAF), files.load_arrays(top)
        found = Search(q, k)
        low = np.sqrt(((whole["center"] - q.centers[0]) ** 2).sum(axis=1)) - whole["radius"] - q.radius[0]
        for g in np.argsort(low, kind="stable"):
            if low[g] > found.bound(0) + found.slack:
                break
            found.meet(_load(str(whole["tree"][g]), scale))
        rows, ids, dist = found.rows()
        return pa.table({"query_id": rows, "neighbor_id": ids, "distance": dist})

    asked, _ = dealt(v.where(F.col("id") % every == 0), QUERIES)
    pairs = asked.groupBy("pivot", "part").applyInArrow(search, "query_id bigint, neighbor_id bigint, distance double")
    # The vectors of a query id keep its least distances.
    best = pairs.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.round("distance", 6).alias("distance"))


_held: OrderedDict[str, CoverTree] = OrderedDict()


def _load(uri: str, scale: float) -> CoverTree:
    """A tree, from this worker's memory if it is among the last HELD_BYTES."""
    if uri not in _held:
        _held[uri] = CoverTree.load(uri, scale)
        while len(_held) > 1 and sum(t.bytes() for t in _held.values()) > HELD_BYTES:
            _held.popitem(last=False)
    _held.move_to_end(uri)
    return _held[uri]


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.x, b.x) AS distance FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= {TOP}
"""
