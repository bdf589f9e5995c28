"""Byte-pair encoding and decoding.

Texts are cut into pieces (words with their leading space, digits, punctuation, white space) by numpy passes over
code point classes, which give the same pieces as the vocabulary's regular expression. Each distinct piece of a
chunk is encoded once: a priority queue holds the ranks of the merges that are possible between neighbours of a
doubly linked list of symbols; an entry whose symbols have changed since it was queued is stale and skipped.
Decoding concatenates the vocabulary's strings. Only the text column is read and nothing is shuffled.

Defined results: a null or empty text has no tokens and decodes to the empty text; a text of any length is encoded
whole, a long one in parts that begin at a blank between two ASCII letters, where a piece begins anyway; a piece may be of
any length; repeated rows are encoded alike; a null doc_id stays null; an empty table gives an empty table; equal ranks
merge from the left; columns other than doc_id and text are not touched. Strings of special tokens are ordinary text. In
decoding, null tokens give a null text, and an id that is null or not of the vocabulary stands for U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quadrille.llm import text as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 1 << 20
#: The pieces' regular expression, as the tiktoken library takes it.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers; the memory is started anew beyond it, which changes no result.
REMEMBERED = 200_000
LETTER, NUMBER, SPACE, OTHER = range(4)
_LENGTH = (1 << 40) - 1
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ASCII_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The class of each code point."""
    global _kinds
    if _kinds is None:
        k = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            if c in "LN":
                k[i] = LETTER if c == "L" else NUMBER
        k[_SPACES] = SPACE
        _kinds = k
    return _kinds


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset where each piece starts, and each document's first piece (n + 1 offsets). Pieces tile the text."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    c = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(c)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    at = np.searchsorted(lead, offs)
    first = T.doc_starts(n, at)
    k = kinds()[c]
    run = first.copy()
    run[1:] |= k[1:] != k[:-1]
    cut = run.copy()
    ends = np.ones(n, bool)  # of a run
    ends[:-1] = run[1:]
    closes = np.ones(n, bool)  # of a document
    closes[:-1] = first[1:]
    last = np.flatnonzero((k == SPACE) & ends & ~closes)  # a space with a word behind it
    cut[last] = True
    joined = last[c[last] == 32] + 1
    cut[joined] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe begins a piece and is alone
    q = np.flatnonzero((c == 39) & run & ends & cut & ~closes)
    if len(q):
        a = c[q + 1]
        one = np.isin(a, [115, 116, 109, 100])
        room = (q + 2 < n) & ~closes[q + 1]
        b = c[np.minimum(q + 2, n - 1)]
        two = room & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        for hit, width in ((q[one], 2), (q[two], 3)):
            cut[hit + 1] = False
            nxt = hit + width
            inside = nxt[(nxt < n)]
            cut[inside] = True
        if two.any():
            cut[q[two] + 2] = False
    starts = np.flatnonzero(cut)
    return lead[starts], np.searchsorted(starts, at)


def before_word(data: np.ndarray) -> np.ndarray:
    """Whether a piece surely begins at each byte: a blank between two ASCII letters."""
    at = np.zeros(len(data), bool)
    at[1:-1] = (data[1:-1] == 32) & _ASCII_LETTER[data[:-2]] & _ASCII_LETTER[data[2:]]
    return at


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    # The symbol at i is piece[i:nxt[i]]; nxt[i] = 0 once it is gone. Arrays for a giant piece, as their numbers take 8 bytes.
    kind = list if n < 1 << 16 else partial(array, "q")
    nxt, prv = kind(range(1, n + 2)), kind(range(-1, n))
    w = n.bit_length() + 1
    mask = (1 << w) - 1
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r << w | i) << w | i + 2)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        e = pop(heap)
        end, i = e & mask, e >> w & mask
        m = nxt[i]
        if not m or m >= n or nxt[m] != end:
            continue  # stale
        nxt[i], nxt[m] = end, 0
        if end < n:
            prv[end] = i
            r = ranks.get(piece[i : nxt[end]])
            if r is not None:
                push(heap, (r << w | i) << w | nxt[end])
        p = prv[i]
        if p >= 0:
            r = ranks.get(piece[p:end])
            if r is not None:
                push(heap, (r << w | p) << w | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : nxt[i]]])
        i = nxt[i]
    return out


class Codec:
    """A vocabulary of ranked byte strings; a token's id is its rank.

    native: pieces are merged by the tiktoken library, to the same tokens, instead of by merge().
    """

    def __init__(self, path: str = VOCABULARY, native: bool = False):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        self.size = max(self.ranks.values()) + 1
        by_id = [b""] * self.size + ["\ufffd".encode()]
        for s, i in self.ranks.items():
            by_id[i] = s
        self.pool = np.frombuffer(b"".join(by_id), np.uint8)
        self.lens = np.array([len(s) for s in by_id], np.int64)
        self.begins = np.cumsum(self.lens) - self.lens
        self.merge = lambda p: merge(p, self.ranks)
        if native:
            import tiktoken

            own = tiktoken.Encoding("pieces", pat_str=PIECE, mergeable_ranks=self.ranks, special_tokens={})
            self.merge = lambda p: own.encode_ordinary(p.decode("utf-8"))
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[bytes, int] = {}  # where a piece's tokens begin and how many they are, in one number without a limit
        self.kept = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _encode_distinct(self, raw: bytes, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, where its tokens lie in self.kept, and how many they are."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        seen, merged, fresh, used, at, many = self.seen, self.merge, [], self.used, [], []
        for s, e in zip(starts, ends, strict=True):
            p = raw[s:e]
            v = seen.get(p)
            if v is None:
                t = merged(p)
                v = seen[p] = used << 40 | len(t)
                used += len(t)
                fresh += t
            at.append(v >> 40)
            many.append(v & _LENGTH)
        if used > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros(max(used, len(self.kept)), np.int32)])
        self.kept[self.used : used] = fresh
        self.used = used
        return np.array(at, np.int64), np.array(many, np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all documents and n + 1 offsets into them."""
        own, first = T.parts(data, offs, before_word)
        if len(own) > len(offs):
            made = [self._encode(data[own[i] : own[j]], own[i : j + 1] - own[i]) for i, j in T.chunks(own, CHUNK)]
            total = np.zeros(len(own), np.int64)
            np.cumsum(np.concatenate([np.diff(o) for _, o in made]), out=total[1:])
            return np.concatenate([t for t, _ in made]), total[first]
        return self._encode(data, offs)

    def _encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, po = pieces(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(data))
        _, index, inverse = np.unique(T.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        where, n = (a[inverse] for a in self._encode_distinct(data.tobytes(), starts[index].tolist(), ends[index].tolist()))
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        return self.kept[T.ragged(where, n)], total[po]

    def decode(self, tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents and n + 1 offsets into them. An id that is not of the vocabulary stands for U+FFFD."""
        known = (tokens >= 0) & (tokens < self.size)
        tokens = tokens if known.all() else np.where(known, tokens, self.size)
        n = self.lens[tokens]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        return np.concatenate([self.pool[T.ragged(self.begins[t], self.lens[t])] for t in np.array_split(tokens, 1 + len(tokens) // CHUNK)]), total[offs]


    def gives_back(self, tokens: np.ndarray, to: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For each document, whether its tokens decode to its bytes."""
        if len(tokens) <= 2 * CHUNK:
            back, bo = self.decode(tokens, to)
            if np.array_equal(back, data) and np.array_equal(bo, offs):
                return np.ones(len(offs) - 1, bool)
            return np.array([back[bo[x] : bo[x + 1]].tobytes() == data[offs[x] : offs[x + 1]].tobytes() for x in range(len(offs) - 1)], bool)
        same = np.ones(len(offs) - 1, bool)
        for x in range(len(same)):
            at = int(offs[x])
            for i in range(int(to[x]), int(to[x + 1]), CHUNK):
                own = tokens[i : min(i + CHUNK, int(to[x + 1]))]
                back, _ = self.decode(own, np.array([0, len(own)]))
                same[x] &= np.array_equal(back, data[at : at + len(back)])
                at += len(back)
            same[x] &= at == offs[x + 1]
        return same


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str = VOCABULARY, native: bool = False) -> Codec:
    """The process's own copy of a vocabulary."""
    if (path, native) not in _codecs:
        _codecs[path, native] = Codec(path, native)
    return _codecs[path, native]


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, n_tokens and whether decoding them gave the text back, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in T.small(batches):
            data, offs = T.buffers(b.column("text"))
            for i, j in T.chunks(offs, CHUNK):
                d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                tokens, to = c.encode(d, o)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(tokens)), pa.array(np.diff(to)), pa.array(c.gives_back(tokens, to, d, o))], ["doc_id", "tokens", "n_tokens", "round_trip"])

    return T.keyed(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, "doc_id bigint, tokens array<int>, n_tokens bigint, round_trip boolean")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows of doc_id and tokens; bytes that are no UTF-8 become U+FFFD. Null tokens give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = []
            for t in b.column("tokens"):
                a = pc.fill_null(t.values, -1).to_numpy(zero_copy_only=False).astype(np.int64) if t.is_valid else None
                out.append(None if a is None else c.decode(a, np.array([0, len(a)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return T.keyed(tokens, {"doc_id": "bigint", "tokens": "array<int>"}).mapInArrow(run, "doc_id bigint, text string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token lists of the documents that are left."""
    return encode(docs)
