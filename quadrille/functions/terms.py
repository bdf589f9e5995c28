"""RDF terms and quads as columns: schema, canonical N-Quads, content ids, textual literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IRI, BNODE, LITERAL, DEFAULT, TRIPLE = "NamedNode", "BlankNode", "Literal", "DefaultGraph", "Triple"
W3 = "http://www.w3.org/"
RDF, RDFS, XSD = W3 + "1999/02/22-rdf-syntax-ns#", W3 + "2000/01/rdf-schema#", W3 + "2001/XMLSchema#"
XSD_STRING, LANG_STRING, DIR_LANG_STRING = XSD + "string", RDF + "langString", RDF + "dirLangString"
NUMERIC = [XSD + n for n in "integer decimal double float int long short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedInt unsignedLong unsignedShort unsignedByte".split()]

#: One row is one quad. Empty g with kind DefaultGraph is the default graph; o_num is the literal's number, if it is one.
QUAD_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang", "o_dir", "g", "g_kind")] + [T.StructField("o_num", T.DoubleType())]
)
COLUMNS = QUAD_SCHEMA.names
#: What makes a quad that quad.
KEY = COLUMNS[:-1]


@dataclass(frozen=True)
class Term:
    """A term outside of DataFrames. Kind is one of the module's names; absent parts are None."""

    kind: str
    value: str
    datatype: str | None = None
    lang: str | None = None
    dir: str | None = None

    def __str__(self) -> str:
        return nquads_term(self)


def iri(value: str) -> Term:
    return Term(IRI, value)


def bnode(value: str) -> Term:
    return Term(BNODE, value)


def literal(value: str, datatype: str | None = None, lang: str | None = None, dir: str | None = None) -> Term:
    """A literal; a language wins over a datatype, a blank language is none, and xsd:string is the plain literal."""
    lang = lang if lang and lang.strip() else None
    if lang:
        return Term(LITERAL, value, None, lang, dir)
    return Term(LITERAL, value, None if datatype == XSD_STRING else datatype)


DEFAULT_GRAPH = Term(DEFAULT, "")


@dataclass(frozen=True)
class Quad:
    s: Term
    p: Term
    o: Term
    g: Term = DEFAULT_GRAPH


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escape_literal(text: str) -> str:
    return "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 else c) for c in text)


def escape_iri(text: str) -> str:
    return "".join("\\\\" if c == "\\" else f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 or c in '<>"{}|^`' else c for c in text)


def nquads_term(t: Term) -> str:
    """A term in canonical N-Quads; what that has no form for raises ValueError."""
    if t.kind == IRI:
        return f"<{escape_iri(t.value)}>"
    if t.kind == BNODE:
        return f"_:{t.value}"
    if t.kind == LITERAL:
        tail = f"@{t.lang}" + (f"--{t.dir}" if t.dir else "") if t.lang else f"^^<{escape_iri(t.datatype)}>" if t.datatype and t.datatype != XSD_STRING else ""
        return f'"{escape_literal(t.value)}"{tail}'
    if t.kind == TRIPLE:
        return t.value
    if t.kind == DEFAULT:
        return ""
    raise ValueError(f"no N-Quads form for a term of kind {t.kind}")


def _replace_controls(c: Column, extra: str) -> Column:
    for code in [*range(32), 127, *map(ord, extra)]:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    return c


def literal_body(c: Column) -> Column:
    """The escaped text of a literal."""
    plain = F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    odd = c.rlike(r'[\x00-\x1f\x7f"\\]')
    control = c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
    return F.when(control, _replace_controls(plain, "")).when(odd, plain).otherwise(c)


def iri_body(c: Column) -> Column:
    """The escaped text of an IRI; a space stays as it is."""
    return F.when(c.rlike(r'[\x00-\x1f\x7f<>"{}|^`\\]'), _replace_controls(F.replace(c, F.lit("\\"), F.lit("\\\\")), '<>"{}|^`')).otherwise(c)


def _wrong(what: str) -> Column:
    return F.raise_error(F.lit(what)).cast("string")


def node(kind: Column, value: Column, where: str, blame: str = "") -> Column:
    return F.when(kind == IRI, F.concat(F.lit("<"), iri_body(value), F.lit(">"))).when(kind == BNODE, F.concat(F.lit("_:"), value)).otherwise(_wrong(f"{blame}no N-Quads form for this kind of term as {where}"))


def nquads_object(kind: Column, value: Column, datatype: Column, lang: Column, dir: Column, blame: str = "") -> Column:
    tail = (
        F.when(lang.isNotNull(), F.concat(F.lit("@"), lang, F.coalesce(F.concat(F.lit("--"), dir), F.lit(""))))
        .when(datatype.isNotNull() & (datatype != XSD_STRING), F.concat(F.lit("^^<"), iri_body(datatype), F.lit(">")))
        .otherwise(F.lit(""))
    )
    return F.when(kind == LITERAL, F.concat(F.lit('"'), literal_body(value), F.lit('"'), tail)).otherwise(node(kind, value, "object", blame))


def canonical_nquads(quads: DataFrame | None = None, prefix: str = "", triples: bool = False, blame: str = "") -> Column:
    """A quad's line in canonical N-Quads, with the line's end. Triple terms raise, unless triples is set; blame stands
    before the error's text."""
    c = lambda n: F.col(prefix + n)
    o = nquads_object(c("o_kind"), c("o"), c("o_datatype"), c("o_lang"), c("o_dir"), blame)
    if triples:
        o = F.when(c("o_kind") == TRIPLE, c("o")).otherwise(o)
    g = F.when(c("g_kind") == DEFAULT, F.lit("")).otherwise(F.concat(F.lit(" "), node(c("g_kind"), c("g"), "graph", blame)))
    return F.concat(node(c("s_kind"), c("s"), "subject", blame), F.lit(" <"), iri_body(c("p")), F.lit("> "), o, g, F.lit(" .\n"))


def content_id(line: Column) -> Column:
    """q2. and the line's SHA-256 in base64 for URLs."""
    return F.concat(F.lit("q2."), F.rtrim(F.translate(F.base64(F.unhex(F.sha2(line.cast("binary"), 256))), "+/", "-_"), F.lit("=")))


def quad_id() -> Column:
    """The content id of a quad; a quad with a triple term has one by its extended line."""
    return content_id(canonical_nquads(triples=True))


def hash_quads(quads: DataFrame) -> DataFrame:
    """quads with quad_id, failing at run time on a quad that canonical N-Quads has no line for."""
    return quads.withColumn("quad_id", content_id(canonical_nquads(blame="failed to compute content hashes: ")))


def textual(kind: Column | None = None, datatype: Column | None = None) -> Column:
    """Whether the object is a literal of text: plain, xsd:string or with a language, but without a direction."""
    kind, datatype = F.col("o_kind") if kind is None else kind, F.col("o_datatype") if datatype is None else datatype
    return (kind == LITERAL) & F.coalesce(datatype, F.lit(XSD_STRING)).isin(XSD_STRING, LANG_STRING)


def result_id(s: str = "s", p: str = "p", text: str = "o", g: str = "g") -> Column:
    """A search hit's id: that of the quad with the text as a plain literal and subject and graph as IRIs."""
    graph = F.when(F.col(g) == "", F.lit("")).otherwise(F.concat(F.lit(" <"), iri_body(F.col(g)), F.lit(">")))
    return content_id(F.concat(F.lit("<"), iri_body(F.col(s)), F.lit("> <"), iri_body(F.col(p)), F.lit('> "'), literal_body(F.col(text)), F.lit('"'), graph, F.lit(" .\n")))


def number(value: Column, datatype: Column) -> Column:
    """The number that a literal stands for, or null."""
    v = F.trim(value)
    special = F.when(v == "INF", F.lit("Infinity")).when(v == "-INF", F.lit("-Infinity")).otherwise(v)
    shape = F.when(datatype.isin(XSD + "double", XSD + "float"), v.rlike(r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$")).when(datatype == XSD + "decimal", v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")).otherwise(v.rlike(r"^[+-]?\d+$"))
    return F.when(datatype.isin(NUMERIC) & shape, special.try_cast("double"))


def with_number(quads: DataFrame) -> DataFrame:
    return quads.withColumn("o_num", number(F.col("o"), F.col("o_datatype")))


def row(q: Quad) -> tuple:
    """A quad as a row of QUAD_SCHEMA without o_num."""
    if q.p.kind != IRI:
        raise ValueError("a predicate must be an IRI")
    if q.s.kind not in (IRI, BNODE):
        raise ValueError(f"Unsupported term type: {q.s.kind}")
    if q.o.kind not in (IRI, BNODE, LITERAL, TRIPLE):
        raise ValueError(f"Unsupported term type: {q.o.kind}")
    datatype = (DIR_LANG_STRING if q.o.dir else LANG_STRING) if q.o.lang else q.o.datatype
    return (q.s.value, q.s.kind, q.p.value, q.o.value, q.o.kind, datatype, q.o.lang, q.o.dir, q.g.value, q.g.kind)


def quads_from(spark: SparkSession, quads) -> DataFrame:
    """A DataFrame of QUAD_SCHEMA from Quad objects."""
    rows = [row(q) for q in quads]
    return with_number(spark.createDataFrame(rows, T.StructType(QUAD_SCHEMA.fields[:-1])))


def quads_of(df: DataFrame) -> list[Quad]:
    """Quad objects of a small DataFrame of quads."""
    return [quad_from_row(r) for r in df.select(*KEY).collect()]


def quad_from_row(r) -> Quad:
    """The Quad that a row of QUAD_SCHEMA describes."""
    if r.o_kind not in (IRI, BNODE, LITERAL, TRIPLE):
        raise ValueError(f"Unsupported term type: {r.o_kind}")
    o = literal(r.o, r.o_datatype, r.o_lang, r.o_dir) if r.o_kind == LITERAL else Term(r.o_kind, r.o)
    return Quad(Term(r.s_kind, r.s), iri(r.p), o, Term(r.g_kind, r.g))


def conform(df: DataFrame) -> DataFrame:
    """Columns of df as a quads table: missing optional ones are filled in, others dropped."""
    have = set(df.columns)
    fill = {"s_kind": F.lit(IRI), "o_kind": F.lit(LITERAL), "o_datatype": F.lit(None), "o_lang": F.lit(None), "o_dir": F.lit(None), "g": F.lit("")}
    missing = {"s", "p", "o"} - have
    if missing:
        raise ValueError(f"not a table of quads: it has no {sorted(missing)}")
    df = df.withColumns({n: c for n, c in fill.items() if n not in have})
    df = df.withColumn("g", F.coalesce("g", F.lit("")))
    if "g_kind" not in have:
        df = df.withColumn("g_kind", F.when(F.col("g") == "", DEFAULT).otherwise(IRI))
    df = df.withColumn("o_lang", F.when(F.trim("o_lang") != "", F.col("o_lang")))
    datatype = F.when(F.col("o_lang").isNotNull(), F.when(F.col("o_dir").isNotNull(), DIR_LANG_STRING).otherwise(LANG_STRING)).when(F.col("o_datatype") != XSD_STRING, F.col("o_datatype"))
    df = df.withColumn("o_datatype", F.when(F.col("o_kind") == LITERAL, datatype))
    df = df.select(*[F.col(n).cast("string").alias(n) for n in KEY])
    return with_number(df)
