"""Search over textual literals: scan, keyword index, vectors, and their fusion.

The scan matches substrings and gives every hit the score 1. The index cuts literals to chunks and scores them by BM25
over index text, from an inverted index laid out by term or by a scan of the chunks; vectors score by cosine; reciprocal
rank fusion joins both. All of it is joins, aggregates and windows, and no index is held by one process.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions import labels as L
from quadrille.functions.terms import quad_id, result_id, textual
from quadrille.operators.filters import QuadFilter, filter_quads
from quadrille.shared import cut, fresh_path

CHUNK_SIZE = 1000
RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
#: Folders that postings are dealt to by a hash of the term.
POSTING_BUCKETS = 64
POSTINGS = "quad_id string, position int, n int, term string, tf bigint, bucket int"
#: Hits that may be broadcast.
BROADCAST_HITS = 100_000
#: Texts that are hashed together.
HASHED_TEXTS = 64
#: Best hits up to which fused lists are ranked at the candidates alone.
FEW_HITS = 100
#: What an import does to the index.
ON_IMPORT = ("incremental", "deferred", "disabled")


def search_scan(quads: DataFrame, query: str, filter: QuadFilter | None = None) -> DataFrame:
    """id, subject, predicate, graph, text and score 1 of textual literals that hold the query, whatever the case.

    An empty query is in every literal. top_k and min_score mean nothing to a scan.
    """
    hits = filter_quads(quads, filter).where(textual() & F.contains(F.lower("o"), F.lower(F.lit(query))))
    return hits.select(result_id().alias("id"), F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("g").alias("graph"), F.col("o").alias("text"), F.lit(1.0).alias("score"))


# Chunks
def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = 0, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most size characters, cut at the first separator that the text has, and within pieces at later ones."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s == "" or s in text))
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        nonlocal held, length
        if held:
            piece = sep.join(held).strip()
            if piece:
                out.append(piece)
            while held and (length > overlap or (length and overlap == 0)):
                length -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held = held[1:]

    for p in parts:
        if len(p) > size:
            flush()
            held, length = [], 0
            out += split_recursive(p, size, overlap, rest)
            continue
        if held and length + len(sep) + len(p) > size:
            flush()
            while held and length + len(sep) + len(p) > size:
                length -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held = held[1:]
        length += len(p) + (len(sep) if held else 0)
        held.append(p)
    piece = sep.join(held).strip()
    if piece:
        out.append(piece)
    return out


def recursive(size: int = CHUNK_SIZE, overlap: int = 0) -> Callable[[Column], Column]:
    """A splitter by split_recursive."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t, size, overlap))

    return split


def fixed(size: int = CHUNK_SIZE) -> Callable[[Column], Column]:
    """A splitter into pieces of size characters, in SQL alone."""

    def split(c: Column) -> Column:  # substr() would count from the text's start for each piece
        return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    return split


def chunk_quads(quads: DataFrame, splitter: Callable[[Column], Column] | None = None, ids: Column | None = None) -> DataFrame:
    """quad_id, subject, predicate, graph, position and value of each chunk of each textual literal.

    splitter turns a column of text to one of lists; ids is a column that holds ids computed before.
    """
    splitter = splitter or fixed()
    # The pieces are a column of their own: beside posexplode() in one select, the id of the whole text would be computed for each chunk.
    rows = quads.where(textual()).select((quad_id() if ids is None else ids).alias("quad_id"), F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("g").alias("graph"), splitter(F.col("o")).alias("pieces"))
    return rows.select("quad_id", "subject", "predicate", "graph", F.posexplode("pieces").alias("position", "value"))


def build_index(quads: DataFrame, filter: QuadFilter | None = None, splitter: Callable[[Column], Column] | None = None, label_predicates: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with fts_value and terms, the words of that."""
    q = filter_quads(quads, filter)
    chunks = L.index_text(chunk_quads(q, splitter), L.labels_per_subject(quads, label_predicates))
    return chunks.withColumn("terms", words(F.col("fts_value")))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def query_words(spark: SparkSession, query: str) -> list[str]:
    return [r.t for r in spark.range(1).select(F.explode(F.array_distinct(words(F.lit(query)))).alias("t")).collect()]


def term_counts(index: DataFrame, terms: list[str]) -> DataFrame:
    """index with n, the number of a row's terms, and tf0, tf1 and so on, how often it holds each of these.

    Where the index has no terms, they are the words of fts_value.
    """
    if "terms" not in index.columns:
        index = index.withColumn("terms", words(F.col("fts_value")))
    count = lambda t: F.size(F.filter("terms", lambda x: x == t))
    return index.select("*", F.size("terms").alias("n"), *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)]).drop("terms")


def bm25_of_counts(rows: DataFrame, terms: list[str], k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """The rows of term_counts() that hold one of the terms, with bm25. One aggregate gives the corpus figures."""
    tf = [f"tf{i}" for i in range(len(terms))]
    if not tf:
        return rows.withColumn("bm25", F.lit(0.0)).limit(0)
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(c) > 0).alias("d" + c) for c in tf])
    score = F.lit(0.0)
    for c in tf:
        idf = F.log(1 + (F.col("docs") - F.col("d" + c) + 0.5) / (F.col("d" + c) + 0.5))
        score += idf * F.col(c) * (k1 + 1) / (F.col(c) + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    hit = F.lit(False)
    for c in tf:
        hit |= F.col(c) > 0
    return rows.where(hit).crossJoin(F.broadcast(stats)).withColumn("bm25", score)


def bm25(index: DataFrame, query: str, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """index rows that hold a word of the query, with bm25.

    Each row counts the query's words in its own terms; one aggregate gives the corpus figures. No row is shuffled.
    """
    keep = ["quad_id", "position", "subject", "predicate", "graph", "value"]
    terms = query_words(index.sparkSession, query)
    rows = term_counts(index, terms).select(*keep, "n", *[f"tf{i}" for i in range(len(terms))])
    return bm25_of_counts(rows, terms, k1, b).select(*keep, "bm25")


def _postings_of_rows(index: DataFrame) -> DataFrame:
    """quad_id, position, n, term and tf of each word of each row, and of each row one with the term '' and tf n.

    A row's words are sorted and counted within the row, so that no row is shuffled for it.
    """
    rows = index.select("quad_id", "position", F.size("terms").alias("n"), F.sort_array("terms").alias("terms"))
    first = lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1))
    rows = rows.withColumn("firsts", F.when(F.col("n") > 0, F.filter(F.sequence(F.lit(0), F.col("n") - 1), first)).otherwise(F.array().cast("array<int>")))
    ends = lambda i: F.coalesce(F.get("firsts", i + 1), F.col("n"))
    counted = F.transform("firsts", lambda at, i: F.struct(F.get("terms", at).alias("term"), (ends(i) - at).cast("bigint").alias("tf")))
    length = F.array(F.struct(F.lit("").alias("term"), F.col("n").cast("bigint").alias("tf")))
    return rows.select("quad_id", "position", "n", F.inline(F.concat(length, counted)))


def write_postings(index: DataFrame, folder: str, buckets: int = POSTING_BUCKETS) -> None:
    """An inverted index of the chunks' terms below a folder: postings (bucket, term, quad_id, position, n, tf), laid out
    by bucket and sorted by term, so that a query reads its own terms and a frequent term spreads over files; and stats.

    The index is read once: the bucket after the last holds the chunks' lengths, which give the stats. A row that occurs
    again counts again, as in bm25().
    """
    spark = index.sparkSession
    spread = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    bucket = F.when(F.col("term") == "", F.lit(buckets)).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    rows = _postings_of_rows(index).withColumn("bucket", bucket)
    rows = rows.repartitionById((buckets + 1) * spread, (F.col("bucket") * spread + F.pmod(F.xxhash64("quad_id", "position"), F.lit(spread))).cast("int"))
    rows.sortWithinPartitions("bucket", "term", "quad_id").write.partitionBy("bucket").parquet(f"{folder}/postings")
    lengths = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").where(F.col("bucket") == buckets)
    lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{folder}/stats")


def bm25_postings(spark: SparkSession, folders: list[str], query: str, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """quad_id, position and bm25 of the chunks that hold a word of the query, from the postings of these words alone.

    folders: those that write_postings() filled, each with other chunks.
    """
    stats = spark.read.parquet(*[f"{f}/stats" for f in folders]).where("docs > 0").agg(F.sum("docs").alias("docs"), (F.sum(F.col("docs") * F.col("mean")) / F.sum("docs")).alias("mean"), F.max("buckets").alias("buckets")).first()
    terms = query_words(spark, query)
    if not terms or not stats.docs:
        return spark.createDataFrame([], "quad_id string, position int, bm25 double")
    of = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(stats.buckets)).cast("int").alias("b")).distinct().collect()]
    hits = None
    for f in folders:
        part = spark.read.schema(POSTINGS).parquet(f"{f}/postings").where(F.col("bucket").isin(of) & F.col("term").isin(terms))
        hits = part if hits is None else hits.unionByName(part)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
    idf = F.log(1 + (stats.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(stats.mean)))
    return hits.join(F.broadcast(df), "term").groupBy("quad_id", "position").agg(F.sum(score).alias("bm25"))


# Vectors
class EmbeddingService(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text, in order; none for none."""


class ConstantEmbedding:
    """The same unit vector for every text, for tests."""

    def __init__(self, size: int = 32):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[1.0] + [0.0] * (self.size - 1) for _ in texts]


class HashedEmbedding:
    """Counts of hashed words and character trigrams, scaled to length 1. A stand-in where no model can be had.

    The trigrams of many texts are hashed at a time; counts are whole numbers, the same in any order.
    """

    def __init__(self, size: int = 256):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list = []
        for i in range(0, len(texts), HASHED_TEXTS):
            texted = [t.lower().split() for t in texts[i : i + HASHED_TEXTS]]
            v = self._counts([w for t in texted for w in t], np.repeat(np.arange(len(texted)), [len(t) for t in texted]), len(texted))
            norms = np.sqrt((v * v).sum(axis=1, keepdims=True))
            out += (v / np.where(norms == 0, 1.0, norms)).tolist()
        return out

    def _counts(self, words: list[str], of: np.ndarray, n: int) -> np.ndarray:
        """The counts of n texts; of: the text of each word."""
        if not words:
            return np.zeros((n, self.size))
        points = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), dtype=np.uint32)
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths + 2)
        begins = np.ones(len(points), dtype=bool)  # of trigrams within a word and its marks
        begins[ends - 1] = begins[ends - 2] = False
        at = np.flatnonzero(begins)
        grams = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(3):
            grams = _crc_of_point(grams, points[at + k])
        whole = np.fromiter((crc32(w.encode()) for w in words), dtype=np.uint32, count=len(words))
        h = np.concatenate([whole, grams ^ np.uint32(0xFFFFFFFF)])
        rows = np.concatenate([of, np.repeat(of, lengths)])
        return np.bincount(rows * self.size + h % self.size, weights=np.where(h >> 31, 1.0, -1.0), minlength=n * self.size).reshape(n, self.size)


def _crc_of_byte(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(crc ^ byte) & 0xFF] ^ (crc >> 8)


def _crc_of_point(crc: np.ndarray, point: np.ndarray) -> np.ndarray:
    """CRC-32s under way, each gone on with the UTF-8 bytes of a code point."""
    out = _crc_of_byte(crc, point)
    at = np.flatnonzero(point > 0x7F)
    if len(at):
        c, p = crc[at], point[at]
        c = _crc_of_byte(c, np.where(p < 0x800, 0xC0 | p >> 6, np.where(p < 0x10000, 0xE0 | p >> 12, 0xF0 | p >> 18)))
        c = np.where(p > 0xFFFF, _crc_of_byte(c, 0x80 | p >> 12 & 0x3F), c)
        c = np.where(p > 0x7FF, _crc_of_byte(c, 0x80 | p >> 6 & 0x3F), c)
        out[at] = _crc_of_byte(c, 0x80 | p & 0x3F)
    return out


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


class CallableEmbedding:
    """Any function from texts to vectors, tried again on failure and called in batches; nothing for nothing."""

    def __init__(self, function: Callable[[list[str]], list], batch: int = 128, max_retries: int = 2, aborted: Callable[[], bool] | None = None):
        self.function, self.batch, self.max_retries, self.aborted = function, batch, max_retries, aborted

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list = []
        for i in range(0, len(texts), self.batch):
            for attempt in range(self.max_retries + 1):
                if self.aborted and self.aborted():
                    raise InterruptedError("embedding was aborted")
                try:
                    out += [list(map(float, v)) for v in self.function(texts[i : i + self.batch])]
                    break
                except InterruptedError:
                    raise
                except Exception:
                    if attempt == self.max_retries:
                        raise
        return out


def embedded(df: DataFrame, service: EmbeddingService, text: str = "fts_value", into: str = "embedding") -> DataFrame:
    """df with a vector of the text column, by batches on the executors."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(service.embed(t.fillna("").tolist()), dtype=object)

    return df.withColumn(into, embed(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(df: DataFrame, service: EmbeddingService, query: list[float], text: str = "fts_value") -> Column:
    """The cosine with one query vector: of the embedding column, or where there is none, of vectors made of the text,
    which then stay in the Python worker. Both add up in the same order, of vectors of 32-bit numbers."""
    if "embedding" in df.columns:
        return cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    q = [float(x) for x in query]
    length = math.sqrt(sum(x * x for x in q))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            made = service.embed(t.fillna("").tolist())
            fits = np.array([len(v) == len(q) for v in made], dtype=bool)
            a = np.asarray([v for v, f in zip(made, fits, strict=True) if f], dtype=np.float32).astype(np.float64).reshape(-1, len(q)).T
            dots, squares = np.zeros(a.shape[1]), np.zeros(a.shape[1])
            for x, y in zip(a, q, strict=True):
                dots += x * y
                squares += x * x
            by = np.sqrt(squares) * length
            values, null = np.zeros(len(t)), np.ones(len(t), dtype=bool)
            at = np.flatnonzero(fits)[by != 0]
            values[at], null[at] = dots[by != 0] / by[by != 0], False
            yield pd.Series(pd.arrays.FloatingArray(values, null))

    return score(F.col(text))


def vector_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of highest cosine with one query vector; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vec_col), q).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


# Fusion
def ranked(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys and rank over the whole list: a sort by ranges, where each range starts after the counts of those before."""
    place = F.monotonically_increasing_id()
    rows = df.select(*keys, score).repartitionByRange(F.desc(score), *[F.asc(k) for k in keys]).sortWithinPartitions(F.desc(score), *keys)
    rows = cut(rows.select(*keys, F.shiftright(place, 33).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "range").select(*keys, (F.col("before") + F.col("place") + 1).alias("rank"))


def rrf(lists: list[DataFrame], keys: list[str], score: str = "score", k: int = RRF_K, depth: int | None = None) -> DataFrame:
    """keys and score: the sum of 1 / (k + rank) over the lists, divided by the most that could be had.

    Whole lists are ranked; depth, if given, takes the first so many of each.
    """
    parts = []
    for df in lists:
        if depth is not None:
            df = df.orderBy(F.desc(score), *keys).limit(depth)
            parts.append(df.select(*keys, F.row_number().over(Window.orderBy(F.desc(score), *keys)).alias("rank")))
        else:
            parts.append(ranked(df, keys, score))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*keys).agg((F.sum(1.0 / (F.lit(k) + F.col("rank"))) * (k + 1) / len(lists)).alias("score"))


def rrf_best(lists: list[DataFrame], keys: list[str], top_k: int, score: str = "score", k: int = RRF_K) -> DataFrame:
    """keys and score of rows of rrf(), the top_k best among them and nothing left out that ties with these.

    The top_k-th of a list has at least 1 / (k + top_k); what is in no list's first n * (k + top_k), of n lists, has less
    than that in all. So only those are candidates, and their places in the lists are found by counting the rows before
    them in the whole list, without sorting it. For many hits, and where a list names a row twice, the lists are ranked.
    """
    spark = lists[0].sparkSession
    depth = len(lists) * (k + top_k)
    if top_k > FEW_HITS or any(not df.groupBy(*keys).count().where("count > 1").isEmpty() for df in lists):
        return rrf(lists, keys, score, k)
    tops = [df.orderBy(F.desc(score), *keys).limit(depth).select(*keys).collect() for df in lists]
    named = lists[0].select(*keys).schema
    ranks = []
    for df, top in zip(lists, tops, strict=True):
        ranks += [(*r, i + 1) for i, r in enumerate(top)]
        others = {tuple(r) for t in tops for r in t} - {tuple(r) for r in top}
        if not others or len(top) < depth:  # a list that ends before has no others
            continue
        others = spark.createDataFrame([r for r in others if None not in r], named)
        at = df.join(F.broadcast(others), keys).select(*keys, score).collect()
        if not at:
            continue
        at = spark.createDataFrame(at, df.select(*keys, score).schema).select(*[F.col(c).alias(f"at_{c}") for c in (*keys, score)])
        before = (F.col(score) > F.col(f"at_{score}")) | ((F.col(score) == F.col(f"at_{score}")) & (F.struct(*keys) <= F.struct(*[F.col(f"at_{c}").alias(c) for c in keys])))
        counts = df.select(*keys, score).join(F.broadcast(at), before).groupBy(*[f"at_{c}" for c in keys]).agg(F.count("*").alias("rank"))
        ranks += [tuple(r) for r in counts.collect()]
    found = spark.createDataFrame(ranks, T.StructType([*named.fields, T.StructField("rank", T.LongType())]))
    return found.groupBy(*keys).agg((F.sum(1.0 / (F.lit(k) + F.col("rank"))) * (k + 1) / len(lists)).alias("score"))


def kept(df: DataFrame) -> DataFrame:
    """The same rows as Parquet in the shared folder, of which a reader takes the columns it needs."""
    at = fresh_path(df.sparkSession, "kept")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def search_index(index: DataFrame, query: str, mode: str = "hybrid", service: EmbeddingService | None = None, top_k: int = 10, min_score: float = 0.0, filter: QuadFilter | None = None, postings: list[str] | None = None) -> DataFrame:
    """id, subject, predicate, graph, text and score of the best chunks.

    mode: keyword, semantic or hybrid. The filter holds before ranking, top_k after it, min_score last. Scores lie in
    0 to 1: BM25 over the best hit's, cosine, or fused ranks. postings: folders of the index's postings, which serve
    keywords where there is no filter.
    """
    rows = index.withColumnsRenamed({"subject": "s", "predicate": "p", "graph": "g"})
    rows = filter_quads(rows, filter).withColumnsRenamed({"s": "subject", "p": "predicate", "g": "graph"})
    keys = ["quad_id", "position"]
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"unknown search mode {mode}")
    listed = postings and (filter is None or not (filter.include.lists() or filter.exclude.lists()))
    terms = query_words(index.sparkSession, query)
    scored, columns = rows, [*keys]
    if mode != "semantic" and not listed:
        scored, columns = term_counts(scored, terms), [*columns, "n", *[f"tf{i}" for i in range(len(terms))]]
    if mode != "keyword":
        if service is None:
            raise ValueError("semantic search needs an embedding service")
        columns.append(similarity(scored, service, service.embed([query])[0]).alias("cosine"))
    scored = scored.select(*columns)
    if mode == "hybrid":  # one pass over the index; what follows reads numbers only
        scored = kept(scored)
    found: list[DataFrame] = []
    if mode != "semantic":
        k = (bm25_postings(index.sparkSession, postings, query) if listed else bm25_of_counts(scored, terms)).select(*keys, F.col("bm25").alias("score"))
        best = k.agg(F.max("score").alias("best"))
        k = k.crossJoin(F.broadcast(best)).select(*keys, (F.col("score") / F.col("best")).alias("score"))
        found.append(kept(k) if mode == "hybrid" else k)
    if mode != "keyword":
        found.append(scored.select(*keys, F.col("cosine").alias("score")).where("score > 0"))
    hits = found[0] if len(found) == 1 else rrf_best(found, keys, top_k)
    hits = hits.orderBy(F.desc("score"), *keys).limit(top_k).where(F.col("score") >= min_score)
    named = rows.select(*keys, "subject", "predicate", "graph", "value")
    out = named.join(F.broadcast(hits) if top_k <= BROADCAST_HITS else hits, keys)
    return out.select(result_id("subject", "predicate", "value", "graph").alias("id"), "subject", "predicate", "graph", F.col("value").alias("text"), "score").orderBy(F.desc("score"), "id")
