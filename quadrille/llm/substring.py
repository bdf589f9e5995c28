"""Repeated passages across documents, with a count-min prefilter and an exact second pass.

A window is K consecutive words, one at every word of every document. First pass: each task counts the windows of its
partition in a sparse count-min sketch (counters that stop at 2, since only "more than once" is asked), and the
partition sketches are merged range by range. The merged sketch never counts a window too low, so a window that it
holds to be single is single.

Second pass: windows estimated repeated are put down, whole documents at a time, in files of some FLUSH windows in the
shared folder; of each file every distinct hash goes once, with its number of documents there, to the group of the hash,
which adds up exactly how many documents have it and answers each file. A file's windows that two or more documents
share are joined to passages where they overlap. So no group holds a window more than once a file, however many documents
share it, and neither texts nor windows are shuffled.

The sketch has two bits of text length (rounded up to a power of two), so that it grows with the input; as one file of
flags in the shared folder it is memory-mapped by the tasks, not sent to them. The shared folder must be mounted.
Beyond MAX_BITS the hashes are dealt to rounds, each with its own sketch and its own passes over the text.

Result: doc_id, start_byte and end_byte of each passage in the UTF-8 text, windows in it, and docs, the most documents
that share one of its windows. Words are runs of letters, digits and other non-ASCII characters; what lies between
words is not compared.

Defined results: a null or empty text and one of fewer than K words has no windows; a text of any length is used
whole; rows with a null doc_id are left out; repeated rows count as one document, and an id with several texts counts as
one and has the passages of each; a passage that repeats only within one document is not reported; an empty table gives
no rows; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import files
from quadrille.llm import text as T
from quadrille.llm.groups import by_id
from quadrille.shared import cut, fresh_path, local_path

K = 50
#: Rows of the count-min sketch, of which the least counts. Each sends a position a window: of 24.3 million windows of a
#: corpus in which 5.7 million repeat, 1, 2 and 4 rows of 2^29 bits in all let through 683, 97 and 7 thousand too many.
DEPTH = 2
RANGE_BITS = 22
FLUSH = 1 << 22
GROUP_WINDOWS = 1 << 20
#: Bits of a round's sketch at most; a text that asks for more is done in rounds, each over a share of the hashes.
MAX_BITS = 1 << 40


def windows(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end byte (in its document) of each window of a chunk's documents."""
    s, e, wo = T.words(data, offs)
    n = np.maximum(np.diff(wo) - k + 1, 0)
    first = T.ragged(wo[:-1], n)
    h = T.window_hash(T.span_hash(data, s, e), k)[first]
    doc = np.repeat(np.arange(len(offs) - 1), n)
    return h, doc, s[first] - offs[doc], e[first + k - 1] - offs[doc]  # in order of document and start


def pieces(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """For chunks of documents, and for parts of a long one: first document, the next one, and windows()."""
    for i, j in T.chunks(offs):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if j - i == 1 and len(d) > 2 * T.CHUNK_BYTES:
            some = False
            for h, s, e in T.long_windows(d, k):
                if len(h) > 1 or some or len(T.words(d[int(s[0]) : int(e[0])], np.array([0, int(e[0] - s[0])]))[0]) == k:
                    some = True
                    yield i, j, (h, np.zeros(len(h), np.int64), s, e)
        else:
            yield i, j, windows(d, o, k)


def cells(h: np.ndarray, row: int, depth: int, bits: int) -> np.ndarray:
    """Counter of each hash in a row of the sketch."""
    own = bits // depth
    return (T.mix(h + T.U(row) * T.U(0x9E3779B97F4A7C15)) & T.U(own - 1)) + T.U(row * own)


def _narrow(x: np.ndarray) -> np.ndarray:
    """As integers of no more bytes than the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def text_hash(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each text, to tell texts of one id apart."""
    long = np.diff(offs) > 2 * T.CHUNK_BYTES
    if not long.any():
        return T.span_hash(data, offs[:-1], offs[1:]).view(np.int64)
    return np.array([int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(offs, offs[1:])], np.int64)


def share(h: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Whether each hash belongs to this round."""
    return np.ones(len(h), bool) if rounds == 1 else T.mix(h ^ T.U(0xA0761D6478BD642F)) % T.U(rounds) == T.U(turn)


def repeats(docs: DataFrame, k: int = K, depth: int = DEPTH, bits: int | None = None, rounds: int | None = None) -> DataFrame:
    """Passages of at least k words that two or more documents share."""
    spark = docs.sparkSession
    docs = T.keyed(docs, {"doc_id": "bigint", "text": "string"}).where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    want = bits or 1 << max(RANGE_BITS + 1, int(2 * size - 1).bit_length())
    rounds = rounds or max(1, want // MAX_BITS)
    bits = bits or max(1 << RANGE_BITS + 1, want // rounds)
    groups = max(8, 1 << int(size / rounds / 6 / GROUP_WINDOWS).bit_length())
    folder = fresh_path(spark, "windows")
    files.make_dir(folder)
    # Ids that several rows have are counted by name, all others by number
    often = cut(docs.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")))
    docs = by_id(docs, often, "left").select("doc_id", "text", "again")
    found = None
    for turn in range(rounds):
        flags = f"{folder}/sketch-{turn}"
        part = _shared_windows(docs, k, depth, bits, groups, turn, rounds, folder, local_path(flags))
        found = part if found is None else found.unionByName(part)
    if rounds > 1:  # windows of one passage may lie in several rounds
        found = found.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "s")
        return found.mapInArrow(_joined, PASSAGES).distinct()
    return found.select("doc_id", F.col("s").alias("start_byte"), F.col("e").alias("end_byte"), "windows", F.col("n").alias("docs")).distinct()


PASSAGES = "doc_id bigint, start_byte bigint, end_byte bigint, windows bigint, docs bigint"


def _shared_windows(docs: DataFrame, k: int, depth: int, bits: int, groups: int, turn: int, rounds: int, folder: str, place: str) -> DataFrame:
    """doc_id, text_hash, s, e, windows and n of the passages (with several rounds: of the windows) that this round finds."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            pos = np.sort(np.concatenate(held))
            lead = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
            twice = np.diff(np.append(lead, len(pos))) > 1
            pos = pos[lead]
            part = pos >> RANGE_BITS
            cut_at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            ends = np.append(cut_at[1:], len(pos))
            low = (pos & 0xFFFF).astype(np.uint16)
            block = ((pos >> 16) & ((1 << (RANGE_BITS - 16)) - 1)).astype(np.int64)
            rows = []
            for a, b in zip(cut_at, ends, strict=True):
                rows.append((int(part[a]), T.blob(np.bincount(block[a:b], minlength=1 << (RANGE_BITS - 16)).astype(np.uint32)), T.blob(low[a:b]), T.blob(np.packbits(twice[a:b]))))
            held.clear()
            c = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], ["part", "blocks", "low", "twice"])

        load = 0
        for b in T.small(batches):
            data, offs = T.buffers(b.column("text"))
            for _, _, (h, *_) in pieces(data, offs, k):
                h = h[share(h, turn, rounds)]
                for r in range(depth):
                    held.append(cells(h, r, depth, bits).astype(np.uint32 if bits <= 1 << 32 else np.uint64))
                load += len(h) * depth
                if load >= FLUSH:
                    yield flush()
                    load = 0
        if load:
            yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: np.ndarray | None = None
        now, made = -1, []

        def store() -> None:
            with open(place, "r+b") as f:
                f.seek(now << (RANGE_BITS - 3))
                f.write(T.blob(np.packbits(count > 1, bitorder="little")))
            made.append(now)

        for b in batches:
            for part, blocks, low, twice in zip(*(b.column(c).to_pylist() for c in ("part", "blocks", "low", "twice")), strict=True):
                if part != now:
                    if count is not None:
                        store()
                    now, count = part, np.zeros(1 << RANGE_BITS, np.uint8)
                lo = np.frombuffer(low, np.uint16).astype(np.int64)
                own = lo + (np.repeat(np.arange(1 << (RANGE_BITS - 16)), np.frombuffer(blocks, np.uint32)) << 16)
                two = np.unpackbits(np.frombuffer(twice, np.uint8))[: len(lo)]
                count[own] = np.minimum(count[own] + 1 + two, 2)
        if count is not None:
            store()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int32())], ["part"])

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.memmap(place, np.uint8, "r")
        held: list[tuple[np.ndarray, ...]] = []
        names: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, row, s, e = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, texts, again = (np.concatenate(x) for x in zip(*names, strict=True))
            held.clear()
            names.clear()
            uri = f"{folder}/{uuid.uuid4().hex}.npz"
            width = e - s  # windows lie in order of row and start
            files.save_arrays(uri, h=h, rows=np.bincount(row, minlength=len(ids)).astype(np.uint32), s=_narrow(s), width=_narrow(width), ids=ids, texts=texts)
            # Distinct (hash, document), then by hash the number of documents, those of several rows by name
            order = np.lexsort((ids[row], h))
            h, doc, again = h[order], ids[row][order], again[row][order]
            own = np.ones(len(h), bool)
            own[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc, again = h[own], doc[own], again[own]
            lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            once = np.add.reduceat((~again).astype(np.int64), lead).astype(np.uint32)
            group = lambda x: (x >> T.U(40)).astype(np.int64) & (groups - 1)
            g, g2 = group(h[lead]), group(h[again])
            by, by2 = np.argsort(g, kind="stable"), np.argsort(g2, kind="stable")
            at, at2 = np.searchsorted(g[by], np.arange(groups + 1)), np.searchsorted(g2[by2], np.arange(groups + 1))
            rows = [(int(x), uri, T.blob(h[lead][by[at[x] : at[x + 1]]]), T.blob(once[by[at[x] : at[x + 1]]]), T.blob(h[again][by2[at2[x] : at2[x + 1]]]), T.blob(doc[again][by2[at2[x] : at2[x + 1]]])) for x in np.flatnonzero(np.diff(at))]
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), *(pa.array(x, pa.binary()) for x in c[2:])], ["g", "file", "h", "once", "h2", "doc2"])

        load = seen = 0
        for b in T.small(batches):
            ids, again = T.id_array(b.column("doc_id")), pc.fill_null(b.column("again"), False).to_numpy(zero_copy_only=False)
            data, offs = T.buffers(b.column("text"))
            last = -1
            for i, j, (h, doc, s, e) in pieces(data, offs, k):
                if i != last and load >= FLUSH // 4:  # between documents
                    yield flush()
                    load = seen = 0
                hit = share(h, turn, rounds)
                for r in range(depth):
                    p = cells(h, r, depth, bits)
                    hit &= (flags[(p >> T.U(3)).astype(np.int64)] >> (p & T.U(7)).astype(np.uint8) & 1).astype(bool)
                if hit.any():
                    if i != last or not names:
                        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                        names.append((ids[i:j], text_hash(d, o), again[i:j]))
                        base, seen = seen, seen + j - i
                    held.append((h[hit], doc[hit] + base, s[hit], e[hit]))
                    load += int(hit.sum())
                    last = i
            if load >= FLUSH // 4:
                yield flush()
                load = seen = 0
        if load:
            yield flush()

    def exact(t: pa.Table) -> pa.Table:
        """For each file's hashes of a group, the number of documents that have them."""
        h, once, h2, doc2 = ([np.frombuffer(x, kind) for x in t.column(c).to_pylist()] for c, kind in (("h", np.uint64), ("once", np.uint32), ("h2", np.uint64), ("doc2", np.int64)))
        own, back = np.unique(np.concatenate(h), return_inverse=True)
        n = np.bincount(back, np.concatenate(once), len(own)).astype(np.int64)
        a, b = np.concatenate(h2), np.concatenate(doc2)
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            n += np.bincount(np.searchsorted(own, a[first]), minlength=len(own))
        n = n[back].astype(np.uint32)
        ends = np.cumsum([len(x) for x in h])
        keep = [x > 1 for x in np.split(n, ends[:-1])]
        return pa.table({"file": t.column("file"), "h": pa.array([T.blob(x[m]) for x, m in zip(h, keep, strict=True)], pa.binary()), "n": pa.array([T.blob(x[m]) for x, m in zip(np.split(n, ends[:-1]), keep, strict=True)], pa.binary())})

    def answered(t: pa.Table) -> pa.Table:
        """The shared windows of a file, joined to passages."""
        w = files.load_arrays(t.column("file")[0].as_py())
        known, n = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("h", np.uint64), ("n", np.uint32)))
        order = np.argsort(known)
        known, n = known[order], n[order]
        if not len(known):
            return pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "text_hash", "s", "e", "windows", "n")})
        at = np.minimum(np.searchsorted(known, w["h"]), len(known) - 1)
        hit = known[at] == w["h"]
        row, s, n = np.repeat(np.arange(len(w["ids"])), w["rows"])[hit], w["s"][hit].astype(np.int64), n[at[hit]].astype(np.int64)
        e = s + w["width"][hit]
        ids, texts = w["ids"][row], w["texts"][row]
        if rounds > 1:
            return pa.table({"doc_id": ids, "text_hash": texts, "s": s, "e": e, "windows": np.ones(len(s), np.int64), "n": n})
        lead = passages(row, s, e)
        return pa.table({"doc_id": ids[lead], "text_hash": texts[lead], "s": s[lead], "e": np.maximum.reduceat(e, lead) if len(lead) else e, "windows": np.diff(np.append(lead, len(s))), "n": np.maximum.reduceat(n, lead) if len(lead) else n})

    parts = docs.mapInArrow(sketch, "part int, blocks binary, low binary, twice binary").repartition("part").sortWithinPartitions("part")
    with open(place, "wb") as f:
        f.truncate(bits >> 3)
    parts.mapInArrow(merged, "part int").agg(F.count("*")).collect()
    asked = cut(docs.mapInArrow(flagged, "g bigint, file string, h binary, once binary, h2 binary, doc2 binary"))
    found = asked.groupBy("g").applyInArrow(exact, "file string, h binary, n binary")
    return found.groupBy("file").applyInArrow(answered, "doc_id bigint, text_hash bigint, s bigint, e bigint, windows bigint, n bigint")


def passages(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The first window of each passage, of windows in order: overlapping and touching windows are joined."""
    lead = np.ones(len(doc), bool)
    lead[1:] = (doc[1:] != doc[:-1]) | (s[1:] > e[:-1])
    return np.flatnonzero(lead)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of document, text and start to passages. A text that several rows have brings its windows again."""
    rest: pa.Table | None = None

    def join(t: pa.Table) -> pa.RecordBatch:
        doc, text, s, e, n = (t.column(c).to_numpy() for c in ("doc_id", "text_hash", "s", "e", "n"))
        own = np.ones(len(doc), bool)
        own[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (s[1:] != s[:-1])
        doc, text, s, e, n = doc[own], text[own], s[own], e[own], n[own]
        which = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]))
        lead = passages(which, s, e)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[lead], s[lead], np.maximum.reduceat(e, lead), np.diff(np.append(lead, len(doc))), np.maximum.reduceat(n, lead))], ["doc_id", "start_byte", "end_byte", "windows", "docs"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        key = [t.column(c).to_numpy() for c in ("doc_id", "text_hash")]
        last = int(np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]))[-1]) + 1 if ((key[0] != key[0][-1]) | (key[1] != key[1][-1])).any() else 0
        if last:
            yield join(t.slice(0, last))
        rest = t.slice(last).combine_chunks()
    if rest is not None and len(rest):
        yield join(rest)


def op9_substring_repeats(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same passages from all windows as strings.
SQL = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9\\x{{80}}-\\x{{10FFFF}}]+|[^a-zA-Z0-9\\x{{80}}-\\x{{10FFFF}}]+')) AS x, generate_subscripts(regexp_extract_all(text, '[a-zA-Z0-9\\x{{80}}-\\x{{10FFFF}}]+|[^a-zA-Z0-9\\x{{80}}-\\x{{10FFFF}}]+'), 1) AS i FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT doc_id, i, x, sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM t),
w AS (SELECT doc_id, e - strlen(x) AS s, e, x, i FROM b WHERE regexp_matches(x, '^[a-zA-Z0-9\\x{{80}}-\\x{{10FFFF}}]')),
k AS (SELECT doc_id, s, last_value(e) OVER v AS e, count(*) OVER v AS n, string_agg(x, ' ') OVER v AS k FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING)),
r AS (SELECT k, count(DISTINCT doc_id) AS docs FROM k WHERE n = {K} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, s, e, docs, CASE WHEN s <= lag(e) OVER (PARTITION BY doc_id ORDER BY s) THEN 0 ELSE 1 END AS new FROM k JOIN r USING (k) WHERE n = {K}),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM m)
SELECT doc_id, min(s)::BIGINT AS start_byte, max(e)::BIGINT AS end_byte, count(*) AS windows, max(docs) AS docs FROM p GROUP BY doc_id, p.p
"""
