"""Personal data and secrets by weak supervision.

Candidate spans come from the bytes of the text: at signs, digit groups, long words with digits, values assigned to
key words, and two capitalised words of which the first is a given name of the gazetteer, or which follow a word that
introduces a person. The gazetteer is a parameter. Regex, gazetteer and context labelers vote
on each (personal, not personal, or abstain). The distinct (kind, votes, features) of all documents are counted by
Spark; on that small table expectation-maximisation estimates each labeler's reliability and each kind's share, and
the resulting posteriors train a logistic span classifier on features of shape and context. A second pass scores
every span. Neither pass shuffles texts.

Defined results: a null or empty text has no spans; texts of any length are searched whole, long ones in parts that begin
between lower-case words, where no span lies; an e-mail's local part is as long as its run of characters; repeated rows
are judged alike; a null doc_id stays null; ties at the threshold count as personal; without any candidate no model is fitted and
no span reported; overlapping candidates go to the kind first in KINDS; columns other than those named stay as they
are. Offsets count characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as T

KINDS = ("EMAIL", "SECRET", "IP", "SSN", "IBAN", "CARD", "PHONE", "PERSON", "NUMBER")
THRESHOLD = 0.5
CONTEXT = 48
GIVEN_NAMES = """james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven
paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry
justin scott brandon benjamin samuel gregory frank alexander raymond patrick jack dennis jerry mary patricia jennifer linda elizabeth
barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah
stephanie rebecca laura sharon cynthia kathleen amy angela anna emma olivia sophia maria jose juan carlos luis pedro pablo miguel
francisco javier antonio manuel carmen isabel lucia elena pierre jean jacques michel francois nicolas marie claire camille hans peter
klaus wolfgang jurgen heinrich ursula helga greta ingrid ahmed mohammed ali fatima omar yusuf wei li ming hiroshi yuki""".split()
_NUM = re.compile(
    rb"(?<![\w.])(?:"
    rb"(?P<IP>\d{1,3}(?:\.\d{1,3}){3}(?![\d])|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:]))"
    rb"|(?P<SSN>\d{3}-\d{2}-\d{4}(?!\d))"
    rb"|(?P<CARD>\d{4}(?:[ -]\d{4}){3}(?!\d)|3\d{3}[ -]\d{6}[ -]\d{5}(?!\d)|\d{13,19}(?!\d))"
    rb"|(?P<PHONE>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)|\d{3}[.\- ]\d{3}[.\- ]\d{4}(?!\d)|0\d{2,4}[ /\-]\d{3,8}(?!\d)"
    rb"|\+\d{7,15}(?!\d)|\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,7}(?!\d)|0\d(?:[ .\-]\d\d){4}(?!\d)|\d{3}(?:[ \-]\d{3}){2}(?!\d)|\d{3}(?:[ \-]\d\d){3}(?!\d)|\d{9,12}(?![.,/:\-]?\d))"
    rb"|(?P<NUMBER>\d[\d.,/:\-]{4,}\d|\d{1,5}(?:[ .\-/]\d{1,5}){1,9}(?!\d)))"
)
_LEFT = bytes(c for c in range(256) if chr(c).isalnum() and c < 128 or c >= 128 or chr(c) in "._%+-")
_RIGHT = re.compile(rb"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_ASSIGN = re.compile(rb"(?:token|secret|password|passwd|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer)[\"']?\s*(?:[=:]|is)\s*[\"']?([^\s\"']{6,})", re.I)
_SPACED_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IBAN = re.compile(rb"[A-Z]{2}\d{2}[A-Z0-9]{11,30}$")
_POSITIVE = re.compile(rb"token|secret|passw|key|bearer|phone|tel\b|call|mobile|fax|card|visa|account|iban|ssn|social sec|e-?mail|contact|mailto|\bip\b|host|address|reach", re.I)
_NEGATIVE = re.compile(rb"version|page|isbn|issn|order|figure|chapter|section|vol\b|volume|copyright|license|serial|table|no\.|release|build", re.I)
_DATE = re.compile(rb"(?:\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}|\d{1,2}:\d{2}(?::\d{2})?)$")
_DOMAINS = re.compile(rb"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|it|info|co|us|eu|ch|at|nl|ru|cn|jp|br|in)$", re.I)
_IIN = re.compile(rb"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
_PERSON = re.compile(rb"(?:\b(?:mr|mrs|ms|dr|prof|sir|madam|dear|named?|signed|regards|sincerely|contact|attn|author|patient|customer|herr|frau|monsieur|madame|se\xc3\xb1or|se\xc3\xb1ora)\b[.:,]?|name is|my name's|je m'appelle|me llamo|ich hei\xc3\x9fe)[ \t]*$", re.I)
#: Names that a gazetteer may hold, as it is broadcast.
MAX_NAMES = 1_000_000
PART = 1 << 20
#: Labelers by number: what each says of a span is in votes().
LABELERS = ("rx_email", "rx_ip", "rx_card", "rx_luhn", "rx_phone", "rx_ssn", "rx_secret", "rx_iban", "rx_date", "rx_number", "gz_domain", "gz_iin", "gz_name", "gz_template", "cx_near", "cx_against", "cx_assign", "rx_plain", "rx_mod97", "cx_person")


def name_hashes(names: DataFrame | list[str] | None = None) -> np.ndarray:
    """The gazetteer as sorted hashes: a list, or the first column of a table, of at most MAX_NAMES given names."""
    if names is None:
        names = GIVEN_NAMES
    elif isinstance(names, DataFrame):
        rows = names.select(F.col(names.columns[0]).cast("string").alias("n")).where("n IS NOT NULL").distinct().limit(MAX_NAMES + 1).collect()
        names = [r.n for r in rows]
    if len(names) > MAX_NAMES:
        raise ValueError(f"a gazetteer holds at most {MAX_NAMES} names")
    data, offs = T.buffers(pa.array([n.strip().capitalize() for n in names if n and n.strip()], pa.string()))
    return np.sort(T.span_hash(data, offs[:-1], offs[1:]))


_names = name_hashes()


def between_lower_words(data: np.ndarray) -> np.ndarray:
    """Where no candidate lies: a blank with three lower-case ASCII letters on either side."""
    low = _LOWER[data]
    at = np.zeros(len(data), bool)
    if len(data) > 6:
        at[3:-3] = (data[3:-3] == 32) & low[:-6] & low[1:-5] & low[2:-4] & low[4:-2] & low[5:-1] & low[6:]
    return at


def _local_part(raw: bytes, at: int) -> int:
    """Where the run of characters before an at sign begins."""
    wide = 64
    while True:
        lo = max(0, at - wide)
        head = raw[lo:at].rstrip(_LEFT)
        if head or not lo:
            return lo + len(head)
        wide *= 4


_UPPER = np.array([65 <= i < 91 or i == 0xC3 for i in range(256)])
_LOWER = np.array([97 <= i < 123 for i in range(256)])
_DIGIT = np.array([48 <= i < 58 for i in range(256)])


def candidates(data: np.ndarray, offs: np.ndarray, names: np.ndarray | None = None) -> Iterator[tuple[int, bytes, list[tuple[int, int, str]]]]:
    """(document, its bytes, spans (start, end, kind) in order) for the documents of a chunk that have any."""
    names = _names if names is None else names
    if len(offs) == 2 and len(data) > 2 * PART:
        own, _ = T.parts(data, offs, between_lower_words, PART)
        found = []
        for a, b in zip(own.tolist(), own[1:].tolist(), strict=False):
            lead = min(a, 4 * CONTEXT)  # key words and the context before the part
            for _, _, spans in _candidates(data[a - lead : b], np.array([0, b - a + lead]), names):
                found += [(s + a - lead, e + a - lead, k) for s, e, k in spans if s >= lead]
        if found:
            yield 0, data.tobytes(), found
        return
    yield from _candidates(data, offs, names)


def _candidates(data: np.ndarray, offs: np.ndarray, names: np.ndarray) -> Iterator[tuple[int, bytes, list[tuple[int, int, str]]]]:
    s, e, wo = T.words(data, offs)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGIT[data], out=digits[1:])
    doc = T.owners(wo)
    long = (e - s >= 16) & (digits[e] - digits[s] >= 4)
    capital = _UPPER[data[s]]
    pair = np.zeros(len(s), bool)
    pair[:-1] = capital[:-1] & capital[1:] & (s[1:] - e[:-1] == 1) & (doc[1:] == doc[:-1])
    pair = np.flatnonzero(pair)
    if len(pair):
        known = np.isin(T.span_hash(data, s[pair], e[pair]), names)
        for i in np.flatnonzero(~known):
            at = int(s[pair[i]])
            known[i] = _PERSON.search(data[max(int(offs[doc[pair[i]]]), at - 24) : at].tobytes()) is not None
        pair = pair[known]
    named = pair
    at = np.flatnonzero(data == 64)
    marks = np.zeros(len(offs) - 1, bool)
    marks[np.searchsorted(offs, at, "right") - 1] = True
    marks |= digits[offs[1:]] > digits[offs[:-1]]
    marks[doc[named]] = True
    equal = np.flatnonzero((data == 61) | (data == 58))
    marks[np.searchsorted(offs, equal, "right") - 1] = True
    long, named = np.flatnonzero(long), named
    long_of, named_of = np.searchsorted(doc[long], np.arange(len(offs))), np.searchsorted(doc[named], np.arange(len(offs)))
    for d in np.flatnonzero(marks):
        o = int(offs[d])
        raw = data[o : offs[d + 1]].tobytes()
        found: list[tuple[int, int, str]] = []
        i = raw.find(b"@")
        while i >= 0:
            left, right = _local_part(raw, i), _RIGHT.match(raw, i + 1)
            if left < i and right:
                found.append((left, right.end(), "EMAIL"))
            i = raw.find(b"@", i + 1)
        for m in _ASSIGN.finditer(raw):
            a, b = m.span(1)
            body = raw[a:b].rstrip(b"!?#$%&*.,;)")
            if len(body) >= 6:
                found.append((a, a + len(body), "SECRET"))
        for w in long[long_of[d] : long_of[d + 1]]:
            word = raw[s[w] - o : e[w] - o]
            kind = "IBAN" if _IBAN.match(word) else None if word.isdigit() else "SECRET"
            if kind:
                found.append((int(s[w] - o), int(e[w] - o), kind))
        if digits[offs[d + 1]] > digits[o]:
            found += [(*m.span(), "IBAN") for m in _SPACED_IBAN.finditer(raw)]
            found += [(*m.span(), m.lastgroup) for m in _NUM.finditer(raw) if m.lastgroup != "NUMBER" or b" " not in m[0] or 7 <= sum(48 <= c < 58 for c in m[0]) <= 20]
        for w in named[named_of[d] : named_of[d + 1]]:
            found.append((int(s[w] - o), int(e[w + 1] - o), "PERSON"))
        taken: list[tuple[int, int, str]] = []
        for x in sorted(found, key=lambda x: (KINDS.index(x[2]), x[0], -x[1])):
            if all(x[1] <= y[0] or x[0] >= y[1] for y in taken):
                taken.append(x)
        if taken:
            yield int(d), raw, sorted(taken)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(span: bytes) -> bool:
    """Whether an IBAN's check digits are right."""
    text = "".join(chr(c) for c in span if c != 32)
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def votes(raw: bytes, start: int, end: int, kind: str) -> tuple[int, ...]:
    """1 personal, 0 not, -1 abstain, by labeler."""
    span = raw[start:end]
    digits = "".join(chr(c) for c in span if 48 <= c < 58)
    near = raw[max(0, start - CONTEXT) : start]
    yes = lambda c: 1 if c else -1
    no = lambda c: 0 if c else -1
    octets = span.split(b".")
    good_ip = kind == "IP" and (b":" in span or (all(int(x) < 256 for x in octets) and int(octets[0]) > 0))
    parts = {c for c in span}
    return (
        yes(kind == "EMAIL"),
        1 if good_ip else no(kind == "IP"),
        yes(kind == "CARD" and len(digits) in (15, 16)),
        yes(kind == "CARD" and luhn(digits)),
        yes(kind == "PHONE" and 7 <= len(digits) <= 15 and not span.isdigit()),
        1 if kind == "SSN" and span[:3] not in (b"000", b"666") and span[:1] != b"9" else no(kind == "SSN"),
        yes(kind == "SECRET" and len(span) >= 20 and len(parts) >= 8),
        yes(kind == "IBAN"),
        no(kind in ("NUMBER", "PHONE") and bool(_DATE.match(span))),
        no(kind == "NUMBER"),
        yes(kind == "EMAIL" and bool(_DOMAINS.search(span))),
        yes(kind == "CARD" and bool(_IIN.match(span))),
        yes(kind == "PERSON"),
        no(kind == "EMAIL" and span.lower().split(b"@")[0] in (b"example", b"user", b"name", b"noreply", b"you")),
        yes(bool(_POSITIVE.search(near))),
        no(bool(_NEGATIVE.search(near)) and not _POSITIVE.search(near)),
        yes(kind == "SECRET" and near.rstrip(b"\"' ")[-1:] in (b"=", b":")),
        no((kind == "SECRET" and not digits and near[-1:] not in (b"=", b'"', b"'")) or (kind == "PHONE" and span.isdigit() and not _POSITIVE.search(near))),
        yes(kind == "IBAN" and mod97(span)),
        yes(kind == "PERSON" and bool(_PERSON.search(near))),
    )


def features(raw: bytes, start: int, end: int, kind: str) -> int:
    """Shape and context of a span, packed: kind, length, share of digits, separators, neighbours, context words."""
    span, near = raw[start:end], raw[max(0, start - CONTEXT) : start]
    n_digits = sum(48 <= c < 58 for c in span)
    f = [
        (KINDS.index(kind), len(KINDS)),
        (min(7, len(span) // 6), 8),
        (min(3, 4 * n_digits // max(1, len(span))), 4),
        (min(3, sum(span.count(c) for c in b" .-()/:")), 4),
        (int(start == 0 or raw[start - 1 : start].isspace()), 2),
        (int(end == len(raw) or raw[end : end + 1].isspace()), 2),
        (int(bool(_POSITIVE.search(near))), 2),
        (int(bool(_NEGATIVE.search(near))), 2),
        (int(len(set(span)) >= 8), 2),
    ]
    code = 0
    for v, base in f:
        code = code * base + v
    return code


_BASES = (len(KINDS), 8, 4, 4, 2, 2, 2, 2, 2)


def unpack(codes: np.ndarray) -> np.ndarray:
    """One-hot rows of packed features, each also together with its kind, and a constant."""
    rest, cols = codes.copy(), []
    for base in reversed(_BASES):
        cols.append(rest % base)
        rest //= base
    cols = cols[::-1]
    hot = [np.eye(base)[c] for c, base in zip(cols, _BASES, strict=True)]
    return np.concatenate([np.ones((len(codes), 1)), *hot, *(np.eye(_BASES[0] * b)[cols[0] * b + c] for c, b in zip(cols[1:], _BASES[1:], strict=True))], axis=1)


def expectation_maximisation(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50, prior: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, reliability P(votes 1 | class) by labeler and class, share of each kind.

    Rows are distinct (kind, votes) with counts. Reliabilities start at 0.8 right with `prior` such votes each.
    """
    rel = np.tile([0.2, 0.8], (vote.shape[1], 1))
    share = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        odds = np.log(share[kind] / (1 - share[kind]))
        for j in range(vote.shape[1]):
            v = vote[:, j]
            odds += np.where(v == 1, np.log(rel[j, 1] / rel[j, 0]), np.where(v == 0, np.log((1 - rel[j, 1]) / (1 - rel[j, 0])), 0))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for j in range(vote.shape[1]):
            for c, w in ((0, (1 - post) * count), (1, post * count)):
                seen = vote[:, j] >= 0
                rel[j, c] = ((w * (vote[:, j] == 1)).sum() + prior * (0.8 if c else 0.2)) / (w[seen].sum() + prior)
        rel = np.clip(rel, 0.01, 0.99)
        for k in range(len(KINDS)):
            w = count[kind == k]
            share[k] = ((post[kind == k] * w).sum() + prior / 2) / (w.sum() + prior)
        share = np.clip(share, 0.01, 0.99)
    return post, rel, share


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic classifier on soft targets, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (target - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, names: DataFrame | list[str] | None = None) -> dict[str, np.ndarray] | None:
    """Labeler reliabilities, shares by kind and classifier weights, from the spans of all documents."""

    known = docs.sparkSession.sparkContext.broadcast(name_hashes(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.small(batches):
            got: Counter = Counter()
            data, offs = T.buffers(b.column("text"))
            for i, j in T.chunks(offs):
                for _, raw, spans in candidates(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], known.value):
                    for s, e, k in spans:
                        got[k, "".join("01-"[v] for v in votes(raw, s, e, k)), features(raw, s, e, k)] += 1
            c = list(zip(*got, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(list(got.values()), pa.int64())], ["kind", "votes", "features", "n"])

    rows = T.keyed(docs, {"text": "string"}).mapInArrow(count, "kind string, votes string, features bigint, n bigint").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).orderBy("kind", "votes", "features").collect()
    if not rows:
        return None
    kind = np.array([KINDS.index(r.kind) for r in rows])
    vote = np.array([["01-".index(c) if c != "-" else -1 for c in r.votes] for r in rows])
    n = np.array([r.n for r in rows], float)
    post, rel, share = expectation_maximisation(kind, vote, n)
    return {"names": known.value, "reliability": rel, "share": share, "weights": logistic(unpack(np.array([r.features for r in rows])), post, n)}


def _scored(data: np.ndarray, offs: np.ndarray, weights: np.ndarray, names: np.ndarray) -> Iterator[tuple[int, bytes, list[tuple[int, int, str]], np.ndarray]]:
    got = list(candidates(data, offs, names))
    if not got:
        return
    codes = np.array([features(raw, *x) for _, raw, spans in got for x in spans])
    own, back = np.unique(codes, return_inverse=True)
    p = (1 / (1 + np.exp(-np.clip(unpack(own) @ weights, -30, 30))))[back]
    k = 0
    for d, raw, spans in got:
        yield d, raw, spans, p[k : k + len(spans)]
        k += len(spans)


def in_characters(raw: bytes, found: list[tuple[int, int, str]]) -> np.ndarray:
    """Start and end of spans counted in characters."""
    at = np.array([x for s, e, _ in found for x in (s, e)])
    leads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    edges = np.concatenate([[0], at])
    return np.cumsum([int(np.count_nonzero(leads[a:b])) for a, b in zip(edges, edges[1:])]).reshape(-1, 2)


def spans(docs: DataFrame, threshold: float = THRESHOLD, rejected: bool = False, names: DataFrame | list[str] | None = None) -> DataFrame:
    """doc_id, start, end, kind, score and is_pii of the personal spans; with rejected, of every candidate."""
    schema = "doc_id bigint, start bigint, end bigint, kind string, score double, is_pii boolean"
    model = fit(docs, names)
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["names"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.small(batches):
            ids, rows = b.column("doc_id").to_pylist(), []
            data, offs = T.buffers(b.column("text"))
            for i, j in T.chunks(offs):
                for d, raw, found, p in _scored(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], *shared.value):
                    rows += [(ids[i + d], int(s), int(e), k, round(float(q), 6), bool(q >= threshold)) for (s, e), (_, _, k), q in zip(in_characters(raw, found), found, p, strict=True) if rejected or q >= threshold]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()], strict=True)], ["doc_id", "start", "end", "kind", "score", "is_pii"])

    return T.keyed(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, schema)


def redact(docs: DataFrame, threshold: float = THRESHOLD, names: DataFrame | list[str] | None = None) -> DataFrame:
    """The rows of docs with each personal span replaced by its kind in brackets; n_chars, if there, follows."""
    model = fit(docs, names)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["names"]))

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        done = [pa.array([], texts.type)]
        for t in T.slices(texts):
            changed: dict[int, str] = {}
            data, offs = T.buffers(t)
            for i, j in T.chunks(offs):
                for d, raw, found, p in _scored(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], *shared.value):
                    parts, at = [], 0
                    for (s, e, k), q in zip(found, p, strict=True):
                        if q >= threshold:
                            parts += [raw[at:s], b"[", k.encode(), b"]"]
                            at = e
                    if at:
                        changed[i + d] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            if changed:
                mask = np.zeros(len(t), bool)
                mask[list(changed)] = True
                t = pc.replace_with_mask(t, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], t.type))
            done.append(t)
        return pa.concat_arrays(done)

    done = T.modest(docs).withColumn("text", clean(F.col("text")))
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))if "n_chars" in docs.columns else done


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal spans replaced."""
    return redact(docs)
