"""SPARQL expressions as Spark columns.

A value is seven columns: lexical form, kind, datatype, language (with --direction), number, instant and, for integers and
decimals, the exact number. Unbound and error are both a null lexical form, which gives the three-valued logic of FILTER
by SQL's own. Comparisons use the native number or instant, so that they reach the scan where a table has one.

Integers and decimals are compared, added up and computed exactly, in decimals of 25 digits before the point and 12 after
it; a result that needs more before the point is an error, and digits beyond the 12th are rounded. A literal of more digits
has no exact number and counts as a double. A time without a zone is taken to be in UTC.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.terms import BNODE, IRI, LANG_STRING, LITERAL, NUMERIC, RDF, TRIPLE, XSD, Term, iri_body, literal_body, number
from quadrille.sources.virtual import EXACT, decimal_form
from quadrille.sparql import algebra as A

INTEGER, DECIMAL, DOUBLE, BOOLEAN, DATE, DATETIME, STRING = (XSD + n for n in ("integer", "decimal", "double", "boolean", "date", "dateTime", "string"))
_DOUBLES = (DOUBLE, XSD + "float")
_INTEGERS = [n for n in NUMERIC if n not in (DECIMAL, DOUBLE, XSD + "float")]
#: Lexical form, kind, datatype, language, number, instant, exact number.
PARTS = ("v", "k", "d", "l", "n", "t", "e")
TYPES = {"n": "double", "t": "timestamp_ntz", "e": EXACT}
_ZONE = r"(Z|[+-]\d\d:\d\d)$"


def null() -> Column:
    return F.lit(None).cast("string")


def no_number() -> Column:
    return F.lit(None).cast("double")


def no_instant() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def no_exact() -> Column:
    return F.lit(None).cast(EXACT)


class UnsupportedExpression(ValueError):
    pass


def column(name: str, part: str) -> str:
    return f"{name}|{part}"


def ref(name: str, part: str) -> Column:
    return F.col(f"`{column(name, part)}`")


@dataclass
class Ex:
    v: Column
    k: Column
    d: Column
    l: Column  # noqa: E741
    n: Column
    kind: str = "term"  # or bool, num, str, iri, time, where that is known before any row is read
    b: Column | None = None
    t: Column | None = None
    e: Column | None = None
    #: exact, if a number that is bound always has an exact one; double, if it never has; None if that is not known.
    lane: str | None = None
    #: The datatype of a number, where every row has the same.
    dt: str | None = None
    #: A computed number as one struct of n, e and d, to build on; its parts would be copied as a whole each time.
    pack: Column | None = None

    def parts(self) -> tuple[Column, ...]:
        return self.v, self.k, self.d, self.l, self.n, no_instant() if self.t is None else self.t, self.exact()

    def exact(self) -> Column:
        return no_exact() if self.e is None or self.lane == "double" else self.e


def of_parts(parts) -> Ex:
    *five, t, e = parts
    return Ex(*five, t=t, e=e)


def var(name: str, datatype: str | None = None) -> Ex:
    """A variable; with the datatype, if all that it may be bound to are numbers of a table's column."""
    x = of_parts(ref(name, p) for p in PARTS)
    if datatype in NUMERIC:
        x.kind, x.lane, x.dt = "num", "double" if datatype in _DOUBLES else "exact", datatype
    return x


def unbound() -> Ex:
    return Ex(null(), null(), null(), null(), no_number())


def _if_bound(v: Column, x: str) -> Column:
    return F.when(v.isNotNull(), F.lit(x))


def boolean(b: Column) -> Ex:
    v = F.when(b, "true").when(~b, "false")
    return Ex(v, _if_bound(v, LITERAL), _if_bound(v, BOOLEAN), null(), no_number(), "bool", b)


def exact(v: Column, d: Column) -> Column:
    """The exact number of an integer or decimal literal that has no more digits than EXACT."""
    shape = F.when(d == DECIMAL, v.rlike(r"^\s*[+-]?(0*\d{1,25}(\.\d{0,12}0*)?|\.\d{1,12}0*)\s*$")).when(d.isin(_INTEGERS), v.rlike(r"^\s*[+-]?0*\d{1,25}\s*$"))
    return F.when(shape, F.trim(v).try_cast(EXACT))


def _exact_form(e: Column, d: Column) -> Column:
    """No fraction for integers, no needless zeros for decimals."""
    return F.when(d == DECIMAL, decimal_form(e)).otherwise(e.cast("decimal(38,0)").cast("string"))


def _double_form(n: Column) -> Column:
    return F.when(n == float("inf"), "INF").when(n == float("-inf"), "-INF").otherwise(n.cast("string"))


def _kind(d: Column | str) -> tuple[Column, str | None]:
    return (F.lit(d), d) if isinstance(d, str) else (d, None)


def numeric(n: Column, d: Column | str) -> Ex:
    """A number of a double; integers and decimals get as many of its digits as EXACT holds."""
    d, dt = _kind(d)
    v = F.when(d.isin(*_DOUBLES), _double_form(n)).otherwise(_exact_form(n.try_cast(EXACT), d))
    return Ex(v, _if_bound(n, LITERAL), F.when(n.isNotNull(), d), null(), n, "num", lane="double", dt=dt)


def exact_number(e: Column, d: Column | str) -> Ex:
    """An integer or decimal."""
    d, dt = _kind(d)
    return Ex(_exact_form(e, d), _if_bound(e, LITERAL), F.when(e.isNotNull(), d), null(), e.cast("double"), "num", e=e, lane="exact", dt=dt)


def either_number(e: Column, n: Column, d: Column) -> Ex:
    """A number that is exact where e is, and an error where it is neither that nor a double."""
    n = F.when(e.isNotNull() | d.isin(*_DOUBLES), n)
    return Ex(F.when(e.isNotNull(), _exact_form(e, d)).otherwise(_double_form(n)), _if_bound(n, LITERAL), F.when(n.isNotNull(), d), null(), n, "num", e=e)


def integer(n: Column) -> Ex:
    """An xsd:integer of a column of whole numbers."""
    v = n.cast("string")
    return Ex(v, _if_bound(v, LITERAL), _if_bound(v, INTEGER), null(), n.cast("double"), "num", e=n.cast(EXACT), lane="exact", dt=INTEGER)


def string(v: Column, lang: Column | None = None) -> Ex:
    lang = null() if lang is None else lang
    return Ex(v, _if_bound(v, LITERAL), F.when(v.isNotNull() & lang.isNotNull(), LANG_STRING), F.when(v.isNotNull(), lang), no_number(), "str")


def iri_value(v: Column) -> Ex:
    return Ex(v, _if_bound(v, IRI), null(), null(), no_number(), "iri")


def constant(t: Term) -> Ex:
    if t.kind != LITERAL:
        return Ex(F.lit(t.value), F.lit(t.kind), null(), null(), no_number(), "iri" if t.kind == IRI else "term")
    lang = f"{t.lang}--{t.dir}" if t.dir else t.lang
    d = LANG_STRING if lang else t.datatype
    n = number(F.lit(t.value), F.lit(d)) if d in NUMERIC else no_number()
    kind = "num" if d in NUMERIC else "bool" if d == BOOLEAN else "time" if d in (DATETIME, DATE) else "term" if d not in (None, LANG_STRING) else "str"
    b = F.lit(t.value in ("true", "1")) if kind == "bool" else None
    when = parsed_instant(F.lit(t.value), F.lit(d)) if kind == "time" else None
    e, lane = None, None
    if kind == "num":
        whole, _, rest = t.value.strip().lstrip("+-").partition(".")
        lane = "double" if d in _DOUBLES else "exact" if (whole + rest).isascii() and (whole + rest).isdigit() and len(whole.lstrip("0")) <= 25 and len(rest.rstrip("0")) <= 12 and not (rest and d != DECIMAL) else None
        e = F.lit(Decimal(t.value.strip())).cast(EXACT) if lane == "exact" else None
    return Ex(F.lit(t.value), F.lit(LITERAL), F.lit(d).cast("string"), F.lit(lang).cast("string"), n, kind, b, when, e, lane, d if lane else None)


def plain(e: Ex) -> Column:
    """Whether a value is a string, with or without a language."""
    return F.lit(True) if e.kind == "str" else (e.k == LITERAL) & (e.d.isNull() | e.d.isin(STRING, LANG_STRING))


def truth(e: Ex) -> Column:
    """Effective boolean value; null is an error."""
    if e.kind == "bool":
        return e.b
    if e.kind == "num":
        return (e.n != 0) & ~F.isnan(e.n)
    if e.kind == "str":
        return F.length(e.v) > 0
    return F.when(e.d == BOOLEAN, e.v.isin("true", "1")).when(e.n.isNotNull(), (e.n != 0) & ~F.isnan(e.n)).when(e.d.isin(NUMERIC), False).when(plain(e), F.length(e.v) > 0)


def as_bool(e: Ex) -> Column:
    return e.b if e.kind == "bool" else F.when(e.d == BOOLEAN, F.when(e.v.isin("true", "1"), True).when(e.v.isin("false", "0"), False))


def parsed_instant(v: Column, d: Column) -> Column:
    """The time that a literal stands for, in UTC."""
    zone = F.regexp_extract(v, _ZONE, 1)
    local = F.regexp_replace(v, _ZONE, "").try_cast("timestamp_ntz")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    ahead = F.make_dt_interval(F.lit(0), sign * F.substring(zone, 2, 2).try_cast("int"), sign * F.substring(zone, 5, 2).try_cast("int"))
    return F.when(d.isin(DATETIME, DATE), F.when(zone.isin("", "Z"), local).otherwise(local - ahead))


def instant(e: Ex) -> Column:
    return parsed_instant(e.v, e.d) if e.t is None else e.t


def same_term(a: Ex, b: Ex) -> Column:
    return (a.v == b.v) & (a.k == b.k) & a.d.eqNullSafe(b.d) & a.l.eqNullSafe(b.l)


def _same_number(a: Ex, b: Ex) -> Column:
    """Numbers are equal; as the doubles then are as well, the filter on them reaches the scan."""
    if a.lane == b.lane == "exact":
        return a.e == b.e
    same = (a.n == b.n) & ~F.isnan(a.n)
    return same if "double" in (a.lane, b.lane) else same & F.coalesce(a.exact() == b.exact(), F.lit(True))


def _less_number(a: Ex, b: Ex, cmp: Callable) -> Column:
    if a.lane == b.lane == "exact":
        return cmp(a.e, b.e)
    real = ~F.isnan(a.n) & ~F.isnan(b.n)
    if "double" in (a.lane, b.lane):
        return cmp(a.n, b.n) & real
    return (a.n <= b.n) & F.coalesce(cmp(a.exact(), b.exact()), cmp(a.n, b.n)) & real


def equal(a: Ex, b: Ex) -> Column:
    kinds = {a.kind, b.kind}
    if "num" in kinds:
        return _same_number(a, b)
    if "bool" in kinds:
        return as_bool(a) == as_bool(b)
    if "time" in kinds:
        return instant(a) == instant(b)
    if "iri" in kinds:
        return (a.v == b.v) & (a.k == b.k)
    if kinds == {"str"}:
        return (a.v == b.v) & a.l.eqNullSafe(b.l)
    strings = plain(a) & plain(b)
    return (
        F.when(a.n.isNotNull() & b.n.isNotNull(), _same_number(a, b))
        .when(a.v.isNull() | b.v.isNull(), F.lit(None).cast("boolean"))
        .when((a.k != LITERAL) | (b.k != LITERAL), (a.v == b.v) & (a.k == b.k))
        .when((a.d == BOOLEAN) & (b.d == BOOLEAN), as_bool(a) == as_bool(b))
        .when(instant(a).isNotNull() & instant(b).isNotNull(), instant(a) == instant(b))
        .when(strings, (a.v == b.v) & a.l.eqNullSafe(b.l))
        .when(same_term(a, b), True)
    )


def less(a: Ex, b: Ex, or_equal: bool) -> Column:
    cmp = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    kinds = {a.kind, b.kind}
    if "num" in kinds:
        return _less_number(a, b, cmp)
    if "time" in kinds:
        return cmp(instant(a), instant(b))
    if kinds == {"str"}:
        return cmp(a.v, b.v)
    if "str" in kinds:
        return F.when(plain(a) & plain(b), cmp(a.v, b.v))
    return (
        F.when(a.n.isNotNull() & b.n.isNotNull(), _less_number(a, b, cmp))
        .when(instant(a).isNotNull() & instant(b).isNotNull(), cmp(instant(a), instant(b)))
        .when((a.d == BOOLEAN) & (b.d == BOOLEAN), cmp(as_bool(a).cast("int"), as_bool(b).cast("int")))
        .when(plain(a) & plain(b) & a.l.eqNullSafe(b.l), cmp(a.v, b.v))
    )


def _by_exact(op: str, x: Column, y: Column, whole: Column) -> Column:
    """Of exact numbers, null if it doesn't fit. Narrower decimals go in where the result's scale would be cut, wide ones
    without a fraction where both are integers."""
    if op in "+-":
        return (F.try_add if op == "+" else F.try_subtract)(x, y).try_cast(EXACT)
    fine = lambda c: c.try_cast("decimal(24,12)")
    if op == "/":
        return F.try_divide(fine(x), fine(y)).try_cast(EXACT)
    wide = lambda c: c.cast("decimal(38,0)")
    return F.when(whole, F.try_multiply(wide(x), wide(y)).try_cast(EXACT)).otherwise(F.try_multiply(fine(x), fine(y)).try_cast(EXACT))


def _widest(op: str, a: Column | str, b: Column | str) -> Column | str:
    """The datatype of a result."""
    if isinstance(a, str) and isinstance(b, str):
        wide = DOUBLE if {a, b} & {*_DOUBLES} else DECIMAL if DECIMAL in (a, b) or op == "/" else INTEGER
        return wide
    either = lambda *t: a.isin(*t) | b.isin(*t)
    return F.when(either(*_DOUBLES), DOUBLE).when(either(DECIMAL), DECIMAL).otherwise(DECIMAL if op == "/" else INTEGER)


def _by_double(op: str, a: Column, b: Column, kind: Column | str) -> Column:
    if op != "/":
        return {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op](a, b)
    special = F.when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan")))
    return F.coalesce(special if isinstance(kind, str) else F.when(kind == DOUBLE, special), F.try_divide(a, b))


def arithmetic(op: str, a: Ex, b: Ex) -> Ex:
    if a.dt and b.dt:
        kind = _widest(op, a.dt, b.dt)
        if kind == DOUBLE:
            return numeric(_by_double(op, a.n, b.n, kind), kind)
        if a.lane == b.lane == "exact":
            return exact_number(_by_exact(op, a.e, b.e, F.lit(not {a.dt, b.dt} & {DECIMAL})), kind)
    pack = lambda x: F.struct(x.n.alias("n"), x.exact().alias("e"), x.d.alias("d")) if x.pack is None else x.pack

    def combined(x: Column) -> Column:
        a, b = x["a"], x["b"]
        kind = _widest(op, a["d"], b["d"])
        e = _by_exact(op, a["e"], b["e"], kind == INTEGER)
        n = F.when(kind == DOUBLE, _by_double(op, a["n"], b["n"], kind)).otherwise(e.cast("double"))
        # Of literals with more digits than EXACT has, there is no result
        return F.struct(n.alias("n"), e.alias("e"), F.when(n.isNotNull(), kind).alias("d"))

    # A value is bound once and used many times, so that a long chain of operations stays an expression of its length
    made = F.transform(F.array(F.struct(pack(a).alias("a"), pack(b).alias("b"))), combined)[0]
    x = either_number(made["e"], made["n"], made["d"])
    x.pack = made
    return x


def text(e: Ex) -> Column:
    """The characters of a string literal; null for other values."""
    return e.v if e.kind == "str" else F.when(plain(e), e.v)


def _compatible(a: Ex, b: Ex) -> Column:
    return b.l.isNull() | a.l.eqNullSafe(b.l)


def _regex(pattern: Column, flags: Column | None) -> Column:
    if flags is None:
        return pattern
    quoted = F.when(F.contains(flags, F.lit("q")), F.concat(F.lit("\\Q"), pattern, F.lit("\\E"))).otherwise(pattern)
    kept = F.regexp_replace(flags, "[^imsx]", "")
    return F.when(kept == "", quoted).otherwise(F.concat(F.lit("(?"), kept, F.lit(")"), quoted))


def _zone(e: Ex) -> Column:
    return F.regexp_extract(e.v, _ZONE, 1)


def _stamp(part: Callable) -> Callable:
    return lambda e: integer(part(F.regexp_replace(F.when(e.d.isin(DATETIME, DATE), e.v), _ZONE, "").try_cast("timestamp_ntz")))


def _around_zero(f: Callable, of_exact: Callable | None = None) -> Callable:
    def call(e: Ex) -> Ex:
        d = e.dt or F.when(e.n.isNotNull(), e.d)
        if e.lane == "double":
            return numeric(f(e.n), d)
        x = (of_exact or f)(e.exact()).cast(EXACT)
        return exact_number(x, d) if e.lane == "exact" else either_number(x, F.coalesce(x.cast("double"), f(e.n)), d)

    return call


def _round_exact(e: Column) -> Column:
    """Halves go up, also below zero."""
    r = F.round(e, 0)
    return F.when(e == r + F.lit(Decimal("0.5")), r + 1).otherwise(r)


def _triple_part(i: int) -> Callable:
    piece = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
    whole = rf"^<<\( {piece} {piece} (.*) \)>>$"

    def take(e: Ex) -> Ex:
        raw = F.when(e.k == TRIPLE, F.regexp_extract(e.v, whole, i))
        lit_v = F.regexp_extract(raw, r'^"((?:[^"\\]|\\.)*)"', 1)
        for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
            lit_v = F.replace(lit_v, F.lit(a), F.lit(b))
        is_lit, is_b = raw.startswith('"'), raw.startswith("_:")
        v = F.when(is_lit, lit_v).when(is_b, F.substring(raw, 3, 1 << 30)).when(raw.startswith("<<("), raw).otherwise(F.regexp_extract(raw, "^<(.*)>$", 1))
        k = F.when(is_lit, LITERAL).when(is_b, BNODE).when(raw.startswith("<<("), TRIPLE).when(raw.isNotNull(), IRI)
        lang = F.regexp_extract(raw, r'"@([A-Za-z0-9-]+)$', 1)
        d = F.regexp_extract(raw, r'"\^\^<([^>]*)>$', 1)
        d = F.when(is_lit & (lang != ""), LANG_STRING).when(is_lit & (d != ""), d)
        return Ex(v, k, d, F.when(is_lit & (lang != ""), lang), number(v, d), t=parsed_instant(v, d), e=exact(v, d))

    return take


def _to_number(name: str, e: Ex) -> Ex:
    flag, words = as_bool(e), F.when(plain(e), e.v)
    if name in _DOUBLES:
        return numeric(e.n if e.kind == "num" else F.when(flag.isNotNull(), flag.cast("double")).otherwise(F.coalesce(e.n, number(words, F.lit(DOUBLE)))), name)
    x = e.e if e.lane == "exact" else e.n.try_cast(EXACT) if e.lane == "double" else F.coalesce(e.exact(), e.n.try_cast(EXACT))
    if e.kind != "num":
        x = F.when(flag.isNotNull(), flag.cast("int").cast(EXACT)).otherwise(F.coalesce(x, exact(words, F.lit(name))))
    if name in _INTEGERS:
        x = _truncated(x)
    return exact_number(x, name)


def _truncated(x: Column) -> Column:
    """Without what stands behind the point."""
    return F.regexp_extract(x.cast("string"), r"^[+-]?\d+", 0).try_cast(EXACT)


def _cast(name: str, e: Ex) -> Ex | None:
    kind = name[len(XSD) :] if name.startswith(XSD) else ""
    if name in NUMERIC:
        return _to_number(name, e)
    if kind == "string":
        return string(e.v)
    if kind == "boolean":
        return boolean(F.coalesce(as_bool(e), F.when(e.n.isNotNull(), (e.n != 0) & ~F.isnan(e.n)), F.when(plain(e), F.when(e.v.isin("true", "1"), True).when(e.v.isin("false", "0"), False))))
    if kind in ("dateTime", "date"):
        stamp = F.regexp_replace(e.v, _ZONE, "").try_cast("timestamp_ntz")
        v = F.when(stamp.isNotNull(), F.when(F.lit(kind == "date"), F.substring(e.v, 1, 10)).when(F.length(e.v) == 10, F.concat(e.v, F.lit("T00:00:00"))).otherwise(e.v))
        return Ex(v, _if_bound(v, LITERAL), _if_bound(v, name), null(), no_number(), t=F.when(v.isNotNull(), parsed_instant(v, F.lit(name))))
    return None


def _no_dir(lang: Column) -> Column:
    return F.regexp_replace(lang, "--.*$", "")


def _sign(e: Ex) -> Ex:
    d = e.dt or F.when(e.n.isNotNull(), e.d)
    return numeric(-e.n, d) if e.lane == "double" else exact_number(-e.e, d) if e.lane == "exact" else either_number(-e.exact(), -e.n, d)


def _seconds(e: Ex) -> Ex:
    t = F.regexp_extract(F.when(e.d == DATETIME, e.v), r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1)
    return exact_number(t.try_cast(EXACT), DECIMAL)


class Expressions:
    """Builds columns from expressions. exists: turns an Exists into a boolean column, where a caller can; numeric: the
    datatypes of variables that only a table's numeric column binds."""

    def __init__(self, known: set[str], now: str, base: str = "", exists: Callable[[A.Exists], Column] | None = None, numeric: dict[str, str | None] | None = None):
        self.known, self.now, self.base, self.exists, self.numeric = known, now, base, exists, numeric or {}

    def build(self, e) -> Ex:
        if isinstance(e, A.Var):
            return var(e.name, self.numeric.get(e.name)) if e.name in self.known else unbound()
        if isinstance(e, Term):
            return constant(e)
        if isinstance(e, A.Exists):
            if self.exists is None:
                raise UnsupportedExpression("EXISTS is supported in FILTER only")
            return boolean(self.exists(e))
        if isinstance(e, A.Call):
            return self.call(e)
        raise UnsupportedExpression(f"{type(e).__name__} is not allowed here")

    def truth(self, e) -> Column:
        return truth(self.build(e))

    def call(self, e: A.Call) -> Ex:
        name, args = e.name, e.args
        if name in ("&&", "||"):
            a, b = map(self.truth, args)
            return boolean(a & b if name == "&&" else a | b)
        if name == "!":
            return boolean(~self.truth(args[0]))
        if name == "BOUND":
            return boolean(self.build(args[0]).v.isNotNull())
        x = [self.build(a) for a in args]
        if name == "IF":
            c = self.truth(args[0])
            return of_parts(F.when(c, a).when(~c, b) for a, b in zip(x[1].parts(), x[2].parts(), strict=True))
        if name == "COALESCE":
            out = unbound()
            for y in reversed(x):
                out = of_parts(F.when(y.v.isNotNull(), a).otherwise(b) for a, b in zip(y.parts(), out.parts(), strict=True))
            return out
        if name == "IN":
            return boolean(reduce(lambda p, q: p | q, [equal(x[0], y) for y in x[1:]], F.lit(False)))
        f = getattr(self, "f_" + name.lower(), None)
        if f is not None:
            return f(*x)
        if name in _OPERATORS:
            return _OPERATORS[name](*x)
        cast = _cast(name, x[0]) if len(x) == 1 else None
        if cast is None:
            raise UnsupportedExpression(f"unknown function {name}")
        return cast

    def f_now(self) -> Ex:
        return constant(Term(LITERAL, self.now, DATETIME))

    def f_iri(self, e: Ex) -> Ex:
        v = F.when((e.k == IRI) | plain(e), e.v)
        return iri_value(F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), v).otherwise(F.concat(F.lit(self.base), v)))

    f_uri = f_iri


def _lang_matches(a: Ex, b: Ex) -> Ex:
    return boolean(F.when(b.v == "*", F.length(a.v) > 0).otherwise((F.lower(a.v) == F.lower(b.v)) | F.lower(a.v).startswith(F.concat(F.lower(b.v), F.lit("-")))))


def _substr(e: Ex, start: Ex, n: Ex | None = None) -> Ex:
    # XPath: characters at places p with round(start) <= p < round(start) + round(n)
    first = F.floor(start.n + 0.5)
    begin = F.greatest(first, F.lit(1))
    if n is None:
        return string(F.substr(text(e), begin.cast("int")), e.l)
    end = first + F.floor(n.n + 0.5)
    return string(F.when(end > begin, F.substr(text(e), begin.cast("int"), (end - begin).cast("int"))).otherwise(F.when(text(e).isNotNull(), F.lit(""))), e.l)


def _before(a: Ex, b: Ex) -> Ex:
    v, x = text(a), text(b)
    hit = F.contains(v, x)
    cut = F.when(x == "", F.lit("")).when(hit, F.left(v, F.position(x, v) - 1)).otherwise(F.lit(""))
    return string(F.when(_compatible(a, b) & v.isNotNull() & x.isNotNull(), cut), F.when(hit, a.l))


def _after(a: Ex, b: Ex) -> Ex:
    v, x = text(a), text(b)
    hit = F.contains(v, x)
    cut = F.when(hit, F.substr(v, F.position(x, v) + F.length(x))).otherwise(F.lit(""))
    return string(F.when(_compatible(a, b) & v.isNotNull() & x.isNotNull(), F.when(x == "", v).otherwise(cut)), F.when(hit, a.l))


def _concat(*x: Ex) -> Ex:
    if not x:
        return string(F.lit(""))
    same = reduce(lambda p, q: p & q, [y.l.eqNullSafe(x[0].l) for y in x], F.lit(True))
    return string(F.concat(*[text(y) for y in x]), F.when(same, x[0].l))


def _datatype(e: Ex) -> Ex:
    d = F.when(F.contains(e.l, F.lit("--")), RDF + "dirLangString").otherwise(F.coalesce(e.d, F.lit(STRING)))
    return iri_value(F.when(e.k == LITERAL, d))


def _timezone(e: Ex) -> Ex:
    z = _zone(e)
    sign = F.when(z.startswith("-"), "-").otherwise("")
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    v = F.when(z == "Z", "PT0S").when(z != "", F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise("")))
    return Ex(v, _if_bound(v, LITERAL), _if_bound(v, XSD + "dayTimeDuration"), null(), no_number())


def _triple(s: Ex, p: Ex, o: Ex) -> Ex:
    def form(e: Ex) -> Column:
        tail = F.when(e.l.isNotNull(), F.concat(F.lit("@"), e.l)).when(e.d.isNotNull(), F.concat(F.lit("^^<"), iri_body(e.d), F.lit(">"))).otherwise("")
        return F.when(e.k == IRI, F.concat(F.lit("<"), iri_body(e.v), F.lit(">"))).when(e.k == BNODE, F.concat(F.lit("_:"), e.v)).when(e.k == TRIPLE, e.v).otherwise(F.concat(F.lit('"'), literal_body(e.v), F.lit('"'), tail))

    v = F.when((p.k == IRI) & s.k.isin(IRI, BNODE), F.concat(F.lit("<<( "), form(s), F.lit(" "), form(p), F.lit(" "), form(o), F.lit(" )>>")))
    return Ex(v, _if_bound(v, TRIPLE), null(), null(), no_number())


def _bnode(e: Ex | None = None) -> Ex:
    v = F.concat(F.lit("b"), F.substring(F.md5(text(e)), 1, 16)) if e else F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-")))
    return Ex(v, _if_bound(v, BNODE), null(), null(), no_number())


def _strdt(e: Ex, d: Ex) -> Ex:
    kind = F.when(d.k == IRI, F.when(d.v != STRING, d.v))
    v = F.when((d.k == IRI) & e.d.isNull() & (e.k == LITERAL), e.v)
    return Ex(v, _if_bound(v, LITERAL), kind, null(), number(v, kind), t=parsed_instant(v, kind), e=exact(v, kind))


def _hash(f: Callable) -> Callable:
    return lambda e: string(f(text(e)))


_OPERATORS: dict[str, Callable] = {
    "=": lambda a, b: boolean(equal(a, b)),
    "!=": lambda a, b: boolean(~equal(a, b)),
    "<": lambda a, b: boolean(less(a, b, False)),
    "<=": lambda a, b: boolean(less(a, b, True)),
    ">": lambda a, b: boolean(less(b, a, False)),
    ">=": lambda a, b: boolean(less(b, a, True)),
    **{op: (lambda a, b, op=op: arithmetic(op, a, b)) for op in "+-*/"},
    "NEGATE": _sign,
    "STR": lambda e: string(F.when(e.k != BNODE, e.v)),
    "LANG": lambda e: string(F.when(e.k == LITERAL, F.coalesce(_no_dir(e.l), F.lit("")))),
    "LANGMATCHES": _lang_matches,
    "DATATYPE": _datatype,
    "BNODE": _bnode,
    "RAND": lambda: numeric(F.rand(), DOUBLE),
    "ABS": _around_zero(F.abs),
    "CEIL": _around_zero(lambda n: F.ceil(n).cast("double"), F.ceil),
    "FLOOR": _around_zero(lambda n: F.floor(n).cast("double"), F.floor),
    "ROUND": _around_zero(lambda n: F.floor(n + 0.5).cast("double"), _round_exact),
    "CONCAT": _concat,
    "STRLEN": lambda e: integer(F.length(text(e))),
    "SUBSTR": _substr,
    "UCASE": lambda e: string(F.upper(text(e)), e.l),
    "LCASE": lambda e: string(F.lower(text(e)), e.l),
    "ENCODE_FOR_URI": lambda e: string(F.replace(F.replace(F.replace(F.url_encode(text(e)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))),
    "CONTAINS": lambda a, b: boolean(F.when(_compatible(a, b), F.contains(text(a), text(b)))),
    "STRSTARTS": lambda a, b: boolean(F.when(_compatible(a, b), F.startswith(text(a), text(b)))),
    "STRENDS": lambda a, b: boolean(F.when(_compatible(a, b), F.endswith(text(a), text(b)))),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "REGEX": lambda e, p, f=None: boolean(F.rlike(text(e), _regex(text(p), text(f) if f else None))),
    "REPLACE": lambda e, p, r, f=None: string(F.regexp_replace(text(e), _regex(text(p), text(f) if f else None), text(r)), e.l),
    "YEAR": _stamp(F.year),
    "MONTH": _stamp(F.month),
    "DAY": _stamp(F.day),
    "HOURS": _stamp(F.hour),
    "MINUTES": _stamp(F.minute),
    "SECONDS": _seconds,
    "TIMEZONE": _timezone,
    "TZ": lambda e: string(F.when(e.d == DATETIME, _zone(e))),
    "UUID": lambda: iri_value(F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: string(F.uuid()),
    "MD5": _hash(F.md5),
    "SHA1": _hash(F.sha1),
    "SHA256": _hash(lambda c: F.sha2(c, 256)),
    "SHA384": _hash(lambda c: F.sha2(c, 384)),
    "SHA512": _hash(lambda c: F.sha2(c, 512)),
    "STRLANG": lambda e, lang: string(F.when(e.d.isNull() & (e.k == LITERAL), e.v), lang.v),
    "STRDT": _strdt,
    "SAMETERM": lambda a, b: boolean(same_term(a, b)),
    "ISIRI": lambda e: boolean(e.k == IRI),
    "ISURI": lambda e: boolean(e.k == IRI),
    "ISBLANK": lambda e: boolean(e.k == BNODE),
    "ISLITERAL": lambda e: boolean(e.k == LITERAL),
    "ISNUMERIC": lambda e: boolean(F.when(e.v.isNotNull(), e.n.isNotNull())),
    "TRIPLE": _triple,
    "SUBJECT": _triple_part(1),
    "PREDICATE": _triple_part(2),
    "OBJECT": _triple_part(3),
    "ISTRIPLE": lambda e: boolean(e.k == TRIPLE),
    "LANGDIR": lambda e: string(F.when(e.k == LITERAL, F.regexp_extract(F.coalesce(e.l, F.lit("")), "--(.*)$", 1))),
    "STRLANGDIR": lambda e, lang, d: string(F.when(e.d.isNull() & (e.k == LITERAL), e.v), F.concat(lang.v, F.lit("--"), d.v)),
    "HASLANG": lambda e: boolean(F.when(e.v.isNotNull(), e.l.isNotNull())),
    "HASLANGDIR": lambda e: boolean(F.when(e.v.isNotNull(), F.coalesce(F.contains(e.l, F.lit("--")), F.lit(False)))),
}


def variables(e) -> set[str]:
    """Variables that an expression mentions, patterns of EXISTS left out."""
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, A.Call):
        return set().union(*map(variables, e.args)) if e.args else set()
    if isinstance(e, A.Aggregate):
        return variables(e.arg) if e.arg is not None else set()
    return set()

