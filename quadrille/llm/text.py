"""Vectorised work on the bytes of Arrow text columns: words, hashes, windows.

Nothing here runs once per character or per word in Python; a chunk of whole documents is handled by a
fixed number of numpy passes. A long document is read whole, but in parts, so that what is held besides its own bytes
and its result does not grow with it; a part begins between words, and what spans parts is carried over.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 2000
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: ASCII letters and digits, and every byte of a longer UTF-8 sequence, are parts of words.
WORD = np.array([chr(i).isalnum() or i >= 128 for i in range(128)] + [True] * 128)
_powers = {"at": np.ones(1, U), "back": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers["at"]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("at", _BASE), ("back", _INV)):
            a = np.full(m, U(base))
            a[0] = 1
            _powers[key] = np.cumprod(a)
    return _powers["at"][:n], _powers["back"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that what is made of a batch's texts is small beside the batch."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
        release()


def slices(column: pa.Array, rows: int = 1000) -> Iterator[pa.Array]:
    for i in range(0, len(column), rows):
        yield column.slice(i, rows)
    release()


def release() -> None:
    """Give memory that is free, but still held by the allocators, back to the system: a worker serves many tasks, and what
    one of them needed most would stay with it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _find_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


_trim = _find_trim()


def chunks(offs: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about this many bytes, a longer document alone."""
    i, n, size = 0, len(offs) - 1, size or CHUNK_BYTES
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(data: np.ndarray, offs: np.ndarray, cuts: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of parts of about this many bytes, and each document's first part (n + 1): documents of over twice that
    are cut where cuts(bytes) allows a part to begin; where it nowhere does, the part is longer."""
    size = size or CHUNK_BYTES
    long = np.flatnonzero(np.diff(offs) > 2 * size)
    if not len(long):
        return offs, np.arange(len(offs))
    at = []
    for d in long.tolist():
        a, b = int(offs[d]), int(offs[d + 1])
        while b - a > 2 * size:
            end, found = a + size, None
            while end < b and found is None:  # look a part at a time
                ok = np.flatnonzero(cuts(data[end - 4 : min(b, end + size + 4)]))
                ok = ok[(ok >= 4) & (end - 4 + ok < b)]
                found = end - 4 + int(ok[0]) if len(ok) else None
                end += size
            if found is None:
                break
            at.append(found)
            a = found
    own = np.sort(np.concatenate([offs, np.array(at, offs.dtype)]), kind="stable")
    return own, np.searchsorted(own, offs, "left")


def doc_starts(mask_len: int, offs: np.ndarray) -> np.ndarray:
    first = np.zeros(mask_len + 1, bool)
    first[offs] = True
    return first[:-1]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for each span, equal for equal bytes wherever they lie."""
    at, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * at[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in bytes, and each document's first word (n + 1 offsets)."""
    w = WORD[data]
    first = doc_starts(len(data), offs)
    before = np.zeros(len(w), bool)
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | first))
    after = np.zeros(len(w), bool)
    after[:-1] = w[1:] & ~first[1:]
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def window_hash(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive items, len(items) - k + 1 of them; items are 64-bit hashes."""
    n = len(items)
    if n < k:
        return np.zeros(0, U)
    at, back = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(items * at[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * back[: n - k + 1])


def owners(woffs: np.ndarray) -> np.ndarray:
    """The document of each item."""
    return np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + c)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - begin, counts)


def between_words(data: np.ndarray) -> np.ndarray:
    return ~WORD[data]


def word_parts(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each part of one document: where it begins, and the start and end of its words in the document."""
    offs, _ = parts(data, np.array([0, len(data)]), between_words)
    for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False):
        s, e, _ = words(data[a:b], np.array([0, b - a]))
        yield a, s + a, e + a


def long_windows(data: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By parts of one document: hash, start and end of its windows of k words. A text of fewer words, but not none, has
    one of all its words."""
    h0, s0, e0, total = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for a, s, e in word_parts(data):
        h = span_hash(data[a : int(e[-1]) if len(e) else a], s - a, e - a)
        h, s, e, total = np.concatenate([h0, h]), np.concatenate([s0, s]), np.concatenate([e0, e]), total + len(h)
        if len(h) >= k:
            yield window_hash(h, k), s[: len(h) - k + 1], e[k - 1 :]
        h0, s0, e0 = (x[max(0, len(x) - k + 1) :] for x in (h, s, e))
    if 0 < total < k:
        yield _short(h0, np.array([0]), np.array([total])), s0[:1], e0[-1:]


def _short(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of all words of texts with fewer words than a window."""
    at, back = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * at[:-1], out=total[1:])
    return mix((total[starts + counts] - total[starts]) * back[starts] + counts.astype(U))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk: first document, distinct shingle hashes sorted within each document, offsets.

    A document of fewer than k words, but not none, has one shingle of all its words.
    """
    for i, j in chunks(offs):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if j - i == 1 and len(d) > 2 * CHUNK_BYTES:
            got = np.unique(np.concatenate([np.zeros(0, U), *(np.unique(h) for h, _, _ in long_windows(d, k))]))
            yield i, got, np.array([0, len(got)])
            continue
        s, e, wo = words(d, o)
        n = np.diff(wo)
        h = span_hash(d, s, e)
        whole = window_hash(h, k)
        cnt = np.where(n >= k, n - k + 1, 0)
        got = whole[ragged(wo[:-1], cnt)]
        doc = np.repeat(np.arange(j - i), cnt)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            own = _short(h, wo[short], n[short])
            got, doc = np.concatenate([got, own]), np.concatenate([doc, short])
        order = np.lexsort((got, doc))
        got, doc = got[order], doc[order]
        keep = np.ones(len(got), bool)
        keep[1:] = (got[1:] != got[:-1]) | (doc[1:] != doc[:-1])
        got, doc = got[keep], doc[keep]
        yield i, got, np.searchsorted(doc, np.arange(j - i + 1))


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def id_array(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def modest(df):
    """df, with fewer rows in a batch between Spark and Python where the session leaves that at its default: texts are long,
    and a batch is held on both sides."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def keyed(df, need: dict[str, str]):
    """Only the columns that an operator works on, under their given types; others never clash."""
    from pyspark.sql import functions as F

    df = modest(df)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in need.items()])
