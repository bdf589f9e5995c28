"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities (buckets x languages) of fixed size; Spark broadcasts it. A batch is
scored as a sparse count matrix in row-pointer form times that matrix: the indices are the buckets of all
n-grams, and the products are summed by np.add.reduceat. Only the text column is read; there is no shuffle of
documents. A long text is read in parts that overlap by two letters, whose own n-grams are taken off again.

Defined results: a null or empty text, one without a letter, or one that no language explains better than uniform noise
is "und" and rejected; ties go to the language first in alphabetical order; repeated rows are scored alike; an
empty table, or one without a labelled row, gives a model without languages, so that every text is "und". Columns
other than those named are left alone. A null doc_id stays null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as T

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
MAX_TRAIN_ROWS = 4000
MIN_POSTERIOR = 0.5
#: Bytes scored at a time, with some 160 bytes held for each.
SCORE_CHUNK = 1 << 18
_MUL = (T.U(0x9E3779B97F4A7C15), T.U(0xC2B2AE3D27D4EB4F), T.U(0x165667B19E3779F9))
_ASCII_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letter
    if _letter is None:
        _letter = np.array([chr(i).isalpha() for i in range(0x30000)] + [False] * (0x110000 - 0x30000))
    return _letter


def ngrams(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of a chunk's documents, and row pointers.

    Characters that are no letters count as one space; repeated spaces as one.
    """
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[offs]
    c = np.where(letters()[codes], codes, 32).astype(T.U)
    first = T.doc_starts(len(c), at)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | first[1:]
    kept = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    c, at = c[keep], kept[at]
    size = np.diff(at)
    parts, rows = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, T.U(n * 7919))
        for i in range(n):
            h = h + c[i : len(c) - n + 1 + i] * _MUL[i]
        own = np.maximum(size - n + 1, 0)
        take = T.ragged(at[:-1], own)
        h = h[take] * T.U(0xD6E8FEB86659FD93)
        h ^= h >> T.U(32)
        parts.append((h % T.U(buckets)).astype(np.int64))
        rows.append(own)
    has = np.add.reduceat(np.append(c != 32, False), at[:-1]) * (size > 0) if len(size) else np.zeros(0)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    counts = np.sum(rows, axis=0)
    ptr = np.zeros(len(offs), np.int64)
    np.cumsum(counts, out=ptr[1:])
    out, base = np.empty(int(counts.sum()), np.int64), ptr[:-1].copy()
    for b, own in zip(parts, rows, strict=True):
        out[T.ragged(base, own)] = b
        base += own
    if (has == 0).any():
        keepdoc = np.repeat(has > 0, counts)
        out, counts = out[keepdoc], np.where(has > 0, counts, 0)
        np.cumsum(counts, out=ptr[1:])
    return out, ptr


def _after_two_letters(data: np.ndarray) -> np.ndarray:
    """Where a part may begin: a blank behind two ASCII letters and before one."""
    at = np.zeros(len(data), bool)
    letter = _ASCII_LETTER[data]
    at[2:-1] = (data[2:-1] == 32) & letter[:-3] & letter[1:-2] & letter[3:]
    return at


def gram_parts(data: np.ndarray, offs: np.ndarray, buckets: int, size: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """For chunks of documents, and for parts of a long one: sign, first document, the next one, and ngrams()."""
    for i, j in T.chunks(offs, size):
        a, b = int(offs[i]), int(offs[j])
        if j - i == 1 and b - a > 2 * size:
            own, _ = T.parts(data[a:b], np.array([0, b - a]), _after_two_letters, size)
            for x, y in zip(own.tolist(), own[1:].tolist(), strict=False):
                lead = 2 if x else 0
                yield 1, i, j, *ngrams(data[a + x - lead : a + y], np.array([0, y - x + lead]), buckets)
                if lead:
                    yield -1, i, j, *ngrams(data[a + x - 2 : a + x], np.array([0, 2]), buckets)
        else:
            yield 1, i, j, *ngrams(data[a:b], offs[i : j + 1] - a, buckets)


def fit(docs: DataFrame, buckets: int = BUCKETS, max_rows: int = MAX_TRAIN_ROWS, alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (buckets x languages) and log priors.

    Fitted on at most max_rows labelled rows, those of smallest hash of id and text, so that the choice does
    not depend on partitions.
    """
    rows = T.keyed(docs, {"doc_id": "bigint", "lang": "string", "text": "string"}).where("lang IS NOT NULL AND trim(lang) <> ''")
    total = rows.count()
    if not total:
        return [], np.zeros((buckets, 0), np.float32), np.zeros(0)
    draw = F.xxhash64("doc_id", "text")
    # A threshold on the hash keeps the sort to a few times max_rows rows, however large the table.
    share = math.ceil(min(1.0, (1.5 * max_rows + 200) / total) * (1 << 40))
    sample = rows.where("text IS NOT NULL AND text <> ''").withColumn("draw", draw).where(F.pmod(F.col("draw"), F.lit(1 << 40)) < share).orderBy("draw", "doc_id", "text", "lang").limit(max_rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in T.small(batches):
            langs = b.column("lang").to_pylist()
            data, offs = T.buffers(b.column("text"), lower=True)
            counted: set[int] = set()
            for sign, i, j, got, ptr in gram_parts(data, offs, buckets, T.CHUNK_BYTES):
                for k in range(j - i):
                    if ptr[k + 1] > ptr[k]:
                        a = total.setdefault(langs[i + k], np.zeros(buckets, np.int64))
                        a += sign * np.bincount(got[ptr[k] : ptr[k + 1]], minlength=buckets)
                        if i + k not in counted:
                            counted.add(i + k)
                            seen[langs[i + k]] = seen.get(langs[i + k], 0) + 1
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[x] for x in names], pa.int64()), pa.array([T.blob(total[x]) for x in names], pa.binary())], ["lang", "docs", "counts"])

    got: dict[str, list] = {}
    for r in sample.mapInArrow(count, "lang string, docs bigint, counts binary").collect():
        x = got.setdefault(r.lang, [0, np.zeros(buckets, np.int64)])
        x[0] += r.docs
        x[1] += np.frombuffer(r.counts, np.int64)
    names = sorted(got)
    if not names:
        return [], np.zeros((buckets, 0), np.float32), np.zeros(0)
    counts = np.stack([got[x][1] for x in names], axis=1) + alpha
    prior = np.log(np.array([got[x][0] for x in names], float))
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32), prior - np.log(np.exp(prior).sum())


def score(data: np.ndarray, offs: np.ndarray, logp: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log joint of each document with each language, and its number of n-grams."""
    out, sizes = np.zeros((len(offs) - 1, logp.shape[1])), np.zeros(len(offs) - 1, np.int64)
    for sign, i, j, got, ptr in gram_parts(data, offs, len(logp), SCORE_CHUNK):
        n = np.diff(ptr)
        sizes[i:j] += sign * n
        full = np.flatnonzero(n)
        if len(full) and logp.shape[1]:
            out[i:j][full] += sign * np.add.reduceat(logp[got], ptr[:-1][full], axis=0, dtype=np.float64)
    return out + prior, sizes


def identify(docs: DataFrame, buckets: int = BUCKETS, max_rows: int = MAX_TRAIN_ROWS, min_posterior: float = MIN_POSTERIOR, model: tuple | None = None, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, posterior, mean_logp, n_grams and accepted for every row of docs.

    With keep, the rows of docs that are accepted instead, with their own columns.
    """
    spark = docs.sparkSession
    names, logp, prior = model or fit(docs, buckets, max_rows)
    shared = spark.sparkContext.broadcast((names, logp, prior))
    noise = -math.log(len(logp))

    def judge(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        names, logp, prior = shared.value
        data, offs = T.buffers(column, lower=True)
        joint, n = score(data, offs, logp, prior)
        if not names:
            z = np.zeros(len(n))
            return np.full(len(n), "und", object), z, z, n, np.zeros(len(n), bool)
        best = joint.argmax(axis=1)
        top = joint[np.arange(len(n)), best]
        post = 1 / np.exp(joint - top[:, None]).sum(axis=1)
        mean = np.where(n > 0, (top - prior[best]) / np.maximum(n, 1), 0.0)
        ok = (n > 0) & (post >= min_posterior) & (mean > noise)
        return np.where(ok, np.array(names, object)[best], "und"), np.where(n > 0, post, 0.0), mean, n, ok

    if keep:

        @F.arrow_udf("boolean")
        def accepted(texts: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(0, bool), *(judge(t)[4] for t in T.slices(texts))]))

        return T.modest(docs).where(accepted(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.small(batches):
            pred, post, mean, n, ok = judge(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.round(post, 6)), pa.array(np.round(mean, 6)), pa.array(n), pa.array(ok)], ["doc_id", "lang_pred", "posterior", "mean_logp", "n_grams", "accepted"])

    return T.keyed(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, "doc_id bigint, lang_pred string, posterior double, mean_logp double, n_grams bigint, accepted boolean")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those rejected go."""
    return identify(docs, keep=True)
