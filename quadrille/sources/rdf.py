"""Reading and writing RDF text.

One grammar, TriG with a fourth term allowed after a triple and with reified triples, reads all formats. Line-based
data in files is read in parallel, a line at a time; other files are parsed whole, a file a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as Q
from quadrille.functions.terms import DEFAULT_GRAPH, RDF, XSD, Quad, Term, bnode, iri, literal

#: Content type to writer; unknown types are written as N-Quads.
FORMATS = {"text/turtle": "turtle", "application/n-quads": "n-quads", "application/n-triples": "n-triples", "text/n3": "turtle"}
DEFAULT_TYPE = "application/n-quads"


def get_format(content_type: str | None) -> str:
    """The writer for a content type, whatever its case; N-Quads where it is missing or unknown."""
    return FORMATS.get((content_type or "").lower(), "n-quads")


class RdfSyntaxError(ValueError):
    pass


def resolve(base: str, reference: str) -> str:
    """An IRI reference against a base, whatever the base's scheme."""
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", reference):
        return reference
    scheme = urlsplit(base).scheme
    if scheme and "//" in base:  # the library joins by the general rules only for schemes it knows
        return scheme + urljoin("http" + base[len(scheme) :], reference)[4:]
    if not reference or reference[0] == "#":
        return base.split("#")[0] + reference
    return base[: max(base.rfind("/"), base.find(":")) + 1] + reference


_TOKEN = re.compile(
    r"""(?P<ws>(?:[\s\ufeff]|\#[^\n\r]*)+)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|[ ])*>)
    |(?P<long>\"{3}(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3})
    |(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[a-z]+)?)
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<bnode>_:[\w\u00b7](?:[\w\u00b7.\-]*[\w\u00b7\-])?)
    |(?P<mark>\^\^|<<\(|\)>>|<<|>>|\{\||\|\}|[.;,\[\](){}~])
    |(?P<name>(?:[^\W\d_][\w.\-\u00b7]*)?:(?:[\w:\u00b7\-.%]|\\[_~.\-!$&'()*+,;=/?\#@%])*)
    |(?P<word>[A-Za-z]+)""",
    re.X | re.S,
)
_ESC = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_CHARS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3] is not None:
            if m[3] not in _CHARS:
                raise RdfSyntaxError(f"unknown escape \\{m[3]}")
            return _CHARS[m[3]]
        return chr(int(m[1] or m[2], 16))

    return _ESC.sub(one, text) if "\\" in text else text


class Parser:
    """A document's quads, in its order. Blank nodes without a label are named gen0, gen1 and so on."""

    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None):
        self.text, self.base, self.prefixes = text, base, dict(prefixes or {})
        self.made, self.quads, self.graph = 0, [], DEFAULT_GRAPH
        self.tokens = list(self._lex())
        self.at = 0

    def _lex(self) -> Iterator[tuple[str, str]]:
        i, n = 0, len(self.text)
        while i < n:
            m = _TOKEN.match(self.text, i)
            if not m or m.end() == i:
                line = self.text.count("\n", 0, i) + 1
                raise RdfSyntaxError(f"line {line}: cannot read {self.text[i : i + 20]!r}")
            i = m.end()
            kind = m.lastgroup
            if kind == "ws":
                continue
            value = m.group()
            if kind == "name" and value.endswith("."):  # a dot ends the statement, not the name
                short = value.rstrip(".")
                i -= len(value) - len(short)
                value = short
            yield kind, value
        yield "end", ""

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def next(self) -> tuple[str, str]:
        t = self.tokens[self.at]
        self.at += 1
        return t

    def take(self, mark: str) -> bool:
        if self.peek() == ("mark", mark):
            self.at += 1
            return True
        return False

    def expect(self, mark: str) -> None:
        if not self.take(mark):
            raise RdfSyntaxError(f"expected {mark} and found {self.peek()[1] or 'the end'!r}")

    def fresh(self) -> Term:
        self.made += 1
        return bnode(f"gen{self.made - 1}")

    def parse(self) -> list[Quad]:
        while self.peek()[0] != "end":
            self.statement()
        return self.quads

    def emit(self, s: Term, p: Term, o: Term) -> None:
        self.quads.append(Quad(s, p, o, self.graph))

    def statement(self) -> None:
        kind, value = self.peek()
        word = value.lower() if kind in ("word", "lang") else ""
        if word in ("@prefix", "prefix") or word in ("@base", "base"):
            self.next()
            if "prefix" in word:
                k, name = self.next()
                if k != "name" or not name.endswith(":"):
                    raise RdfSyntaxError("expected a prefix")
                self.prefixes[name[:-1]] = self.iri_of(*self.next()).value
            else:
                self.base = self.iri_of(*self.next()).value
            if word[0] == "@":
                self.expect(".")
            return
        if word == "graph":
            self.next()
            return self.graph_block(self.node())
        if self.take("{"):
            return self.graph_block(DEFAULT_GRAPH, opened=True)
        bare = kind == "mark" and value in ("[", "<<")
        start = self.at
        s = self.node()
        if self.peek() == ("mark", "{") and (kind in ("iri", "name", "bnode") or self.at == start + 2):
            return self.graph_block(s)
        if not (bare and self.peek() == ("mark", ".")):
            before = len(self.quads)
            self.predicates(s)
            k, v = self.peek()
            if k in ("iri", "name", "bnode"):  # the graph of an N-Quads line
                g = self.node()
                self.quads[before:] = [Quad(q.s, q.p, q.o, g) for q in self.quads[before:]]
        self.expect(".")

    def graph_block(self, g: Term, opened: bool = False) -> None:
        if not opened:
            self.expect("{")
        outer, self.graph = self.graph, g
        while not self.take("}"):
            bare = self.peek() in (("mark", "["), ("mark", "<<"))
            s = self.node()
            if not (bare and self.peek() in (("mark", "."), ("mark", "}"))):
                self.predicates(s)
            if not self.take(".") and self.peek() != ("mark", "}"):
                raise RdfSyntaxError(f"expected . or }} and found {self.peek()[1]!r}")
        self.graph = outer
        self.take(".")

    def predicates(self, s: Term) -> None:
        while True:
            kind, value = self.next()
            p = iri(RDF + "type") if (kind, value) == ("word", "a") else self.iri_of(kind, value)
            while True:
                o = self.node(as_object=True)
                self.emit(s, p, o)
                while self.peek() in (("mark", "~"), ("mark", "{|")):
                    self.annotate(s, p, o)
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek() in (("mark", "."), ("mark", "]"), ("mark", "}"), ("mark", "|}")):
                return

    def annotate(self, s: Term, p: Term, o: Term) -> None:
        r = None
        if self.take("~"):
            r = self.node() if self.peek()[0] in ("iri", "name", "bnode") else self.fresh()
            self.emit(r, iri(RDF + "reifies"), triple_term(s, p, o))
        if self.take("{|"):
            if r is None:
                r = self.fresh()
                self.emit(r, iri(RDF + "reifies"), triple_term(s, p, o))
            self.predicates(r)
            self.expect("|}")

    def iri_of(self, kind: str, value: str) -> Term:
        if kind == "iri":
            v = unescape(value[1:-1])
            return iri(resolve(self.base, v))
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise RdfSyntaxError(f"unknown prefix {prefix}:")
            return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise RdfSyntaxError(f"expected an IRI and found {value or 'the end'!r}")

    def node(self, as_object: bool = False) -> Term:
        kind, value = self.next()
        if kind in ("iri", "name"):
            return self.iri_of(kind, value)
        if kind == "bnode":
            return bnode(value[2:])
        if kind == "mark":
            if value == "[":
                b = self.fresh()
                if not self.take("]"):
                    self.predicates(b)
                    self.expect("]")
                return b
            if value == "(":
                items = []
                while not self.take(")"):
                    items.append(self.node(as_object=True))
                cells = [self.fresh() for _ in items]
                for i, (c, x) in enumerate(zip(cells, items, strict=True)):
                    self.emit(c, iri(RDF + "first"), x)
                    self.emit(c, iri(RDF + "rest"), cells[i + 1] if i + 1 < len(cells) else iri(RDF + "nil"))
                return cells[0] if cells else iri(RDF + "nil")
            if value == "<<":
                t = self.inner_triple()
                r = self.node() if self.take("~") and self.peek() != ("mark", ">>") else self.fresh()
                self.expect(">>")
                self.emit(r, iri(RDF + "reifies"), t)
                return r
            if value == "<<(":
                t = self.inner_triple()
                self.expect(")>>")
                return t
        if as_object:
            if kind in ("str", "long"):
                return self.literal_of(unescape(value[3:-3] if kind == "long" else value[1:-1]))
            if kind == "num":
                kind = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
                return literal(value, XSD + kind)
            if kind == "word" and value in ("true", "false"):
                return literal(value, XSD + "boolean")
        raise RdfSyntaxError(f"expected a term and found {value or 'the end'!r}")

    def inner_triple(self) -> Term:
        s = self.node()
        kind, value = self.next()
        p = iri(RDF + "type") if (kind, value) == ("word", "a") else self.iri_of(kind, value)
        return triple_term(s, p, self.node(as_object=True))

    def literal_of(self, text: str) -> Term:
        kind, value = self.peek()
        if kind == "lang":
            self.next()
            lang, _, direction = value[1:].partition("--")
            return literal(text, lang=lang, dir=direction or None)
        if self.take("^^"):
            return literal(text, self.iri_of(*self.next()).value)
        return literal(text)


def triple_term(s: Term, p: Term, o: Term) -> Term:
    return Term(Q.TRIPLE, f"<<( {Q.nquads_term(s)} {Q.nquads_term(p)} {Q.nquads_term(o)} )>>")


def parse(text: str, base: str = "", content_type: str | None = None) -> list[Quad]:
    """The quads of a document. The content type is accepted and changes nothing: one grammar reads all."""
    return Parser(text, base).parse()


def read_text(spark: SparkSession, text: str, content_type: str | None = None, base: str = "") -> DataFrame:
    """A document's quads as a DataFrame; text that cannot be read raises here, not later."""
    return Q.quads_from(spark, parse(text, base, content_type))


_ROWS = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, o_dir string, g string, g_kind string"


def _table(quads: list[Quad]) -> pd.DataFrame:
    return pd.DataFrame([Q.row(q) for q in quads], columns=Q.KEY, dtype=object)


_ABSOLUTE = r"<([A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|^`\\]*)>"
_LABEL = r"_:([A-Za-z0-9_][A-Za-z0-9_\-]*)"
#: A line without escapes: subject, predicate, object and graph as groups, of which those that are not there are empty.
_PLAIN = rf'^\s*(?:{_ABSOLUTE}|{_LABEL})\s+{_ABSOLUTE}\s+(?:{_ABSOLUTE}|{_LABEL}|"([^"\\\x00-\x1f\x7f]*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)(?:--(ltr|rtl))?|\^\^{_ABSOLUTE})?)\s*(?:{_ABSOLUTE}|{_LABEL})?\s*\.\s*$'
_QUAD = "struct<" + ", ".join(x.replace(" ", ": ") for x in _ROWS.split(", ")) + ">"


def from_lines(text: DataFrame) -> DataFrame:
    """Quads of lines (column value) of N-Quads or N-Triples, also of a stream.

    Plain lines are taken apart in SQL; only lines with escapes, dots in labels or quoted triples go through the parser.
    """
    kind = pa.list_(pa.struct([(n, pa.string()) for n in Q.KEY]))

    @F.arrow_udf(f"array<{_QUAD}>")
    def parsed(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [dict(zip(Q.KEY, Q.row(q), strict=True)) for q in Parser(x).parse()] for x in column.to_pylist()], kind)

    text = text.where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    mark = "\x01"
    part = lambda i: F.col("parts")[i - 1]
    some = lambda i: F.when(part(i) != "", part(i))
    node = lambda i: (F.coalesce(some(i), part(i + 1)), F.when(part(i) != "", Q.IRI).otherwise(Q.BNODE))
    (s, s_kind), (g, g_kind) = node(1), node(10)
    literal = (part(4) == "") & (part(5) == "")
    datatype = F.when(part(8) != "", Q.DIR_LANG_STRING).when(part(7) != "", Q.LANG_STRING).otherwise(F.when(part(9) != Q.XSD_STRING, some(9)))
    cells = (
        s, s_kind, part(3), F.when(literal, part(6)).otherwise(node(4)[0]), F.when(literal, Q.LITERAL).otherwise(node(4)[1]),
        F.when(literal, datatype), some(7), some(8), g, F.when((part(10) == "") & (part(11) == ""), Q.DEFAULT).otherwise(g_kind),
    )
    rows = text.withColumn("plain", F.col("value").rlike(_PLAIN))
    rows = rows.withColumn("parts", F.when(F.col("plain"), F.split(F.regexp_replace("value", _PLAIN, mark.join(f"${i}" for i in range(1, 12))), mark, -1)))
    rows = rows.withColumn("others", parsed(F.when(~F.col("plain"), F.col("value"))))
    one = F.array(F.struct(*[c.alias(n) for c, n in zip(cells, Q.KEY, strict=True)]).cast(_QUAD))
    return Q.with_number(rows.select(F.explode(F.when(F.col("plain"), one).otherwise(F.col("others"))).alias("q")).select("q.*"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """N-Quads or N-Triples files, a line at a time in parallel. A blank node's label names it in every line."""
    return from_lines(spark.read.text(path))


def read_files(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Files in any of the formats, each parsed whole; blank nodes are told apart by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for b in batches:
            for name, text in zip(b["name"], b["value"], strict=True):
                mark = sha256(name.encode()).hexdigest()[:12]
                t = _table(Parser(text, base).parse())
                for c, k in (("s", "s_kind"), ("o", "o_kind"), ("g", "g_kind")):
                    t[c] = t[c].where(t[k] != Q.BNODE, mark + "-" + t[c])
                yield t

    return Q.with_number(spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("name")).mapInPandas(run, _ROWS))


def lines(quads: DataFrame, graphs: bool = True) -> DataFrame:
    """Canonical lines (column value, without line ends) in order; without graphs, as N-Triples."""
    q = quads if graphs else quads.withColumns({"g": F.lit(""), "g_kind": F.lit(Q.DEFAULT)})
    line = F.rtrim(Q.canonical_nquads(triples=True), F.lit("\n"))
    return q.select(line.alias("value")).distinct().orderBy("value")


def write_lines(quads: DataFrame, path: str, graphs: bool = True) -> None:
    lines(quads, graphs).write.mode("overwrite").text(path)


def turtle_blocks(quads: DataFrame) -> DataFrame:
    """One row (g, value) for each subject of each graph: its predicates and objects in Turtle, in order."""
    s, p = Q.node(F.col("s_kind"), F.col("s"), "subject"), F.concat(F.lit("<"), Q.iri_body(F.col("p")), F.lit(">"))
    o = F.when(F.col("o_kind") == Q.TRIPLE, F.col("o")).otherwise(Q.nquads_object(F.col("o_kind"), F.col("o"), F.col("o_datatype"), F.col("o_lang"), F.col("o_dir")))
    g = F.when(F.col("g_kind") == Q.DEFAULT, F.lit("")).otherwise(Q.node(F.col("g_kind"), F.col("g"), "graph"))
    t = quads.select(g.alias("g"), s.alias("s"), p.alias("p"), o.alias("o")).groupBy("g", "s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("o"))
    t = t.groupBy("g", "s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n  ").alias("po"))
    return t.select("g", "s", F.concat(F.col("s"), F.lit(" "), F.col("po"), F.lit(" .")).alias("value")).orderBy("g", "s").select("g", "value")


def serialize(quads: DataFrame, content_type: str | None = None) -> str:
    """The quads as one string, gathered on the driver, in a stable order."""
    kind = get_format(content_type)
    if kind != "turtle":
        return "".join(r.value + "\n" for r in lines(quads, kind == "n-quads").toLocalIterator())
    out, graph = [], ""
    for r in turtle_blocks(quads).toLocalIterator():
        if r.g != graph:
            out.append(("}\n" if graph else "") + (f"{r.g} {{\n" if r.g else ""))
            graph = r.g
        out.append(r.value + "\n")
    return "".join(out) + ("}\n" if graph else "")
