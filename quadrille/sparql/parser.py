"""SPARQL text to algebra."""

from __future__ import annotations

import re
from quadrille.functions.terms import RDF, XSD, Term, iri, literal
from quadrille.sources.rdf import resolve, triple_term, unescape
from quadrille.sparql import algebra as A


class SparqlSyntaxError(ValueError):
    pass


_TOKEN = re.compile(
    r"""(?P<ws>(?:\s|\#[^\n\r]*)+)
    |(?P<iri><[^\x00-\x20<>"{}|^`\\]*>)
    |(?P<var>[?$]\w+)
    |(?P<long>\"{3}(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3})
    |(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[a-z]+)?)
    |(?P<num>\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<bnode>_:\w(?:[\w.\-]*[\w\-])?)
    |(?P<name>(?:[^\W\d_][\w.\-]*)?:(?:[\w:\-.%]|\\[_~.\-!$&'()*+,;=/?\#@%])*)
    |(?P<word>[A-Za-z][A-Za-z0-9_]*)
    |(?P<mark>\^\^|<<\(|\)>>|<<|>>|&&|\|\||!=|<=|>=|[.;,\[\](){}=<>!+\-*/|^?])""",
    re.X | re.S,
)
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
FUNCTIONS = set(
    """STR LANG LANGMATCHES DATATYPE BOUND IRI URI BNODE RAND ABS CEIL FLOOR ROUND CONCAT STRLEN UCASE LCASE ENCODE_FOR_URI CONTAINS
    STRSTARTS STRENDS STRBEFORE STRAFTER YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ NOW UUID STRUUID MD5 SHA1 SHA256 SHA384 SHA512
    COALESCE IF STRLANG STRDT SAMETERM ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC REGEX SUBSTR REPLACE TRIPLE SUBJECT PREDICATE OBJECT
    ISTRIPLE LANGDIR STRLANGDIR HASLANG HASLANGDIR""".split()
)


class Parser:
    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None):
        self.base, self.prefixes, self.made, self.at = base, dict(prefixes or {}), 0, 0
        self.tokens: list[tuple[str, str]] = []
        i = 0
        while i < len(text):
            m = _TOKEN.match(text, i)
            if not m or m.end() == i:
                raise SparqlSyntaxError(f"cannot read {text[i : i + 20]!r}")
            i = m.end()
            kind, value = m.lastgroup, m.group()
            if kind == "ws":
                continue
            if kind == "name" and value.endswith("."):
                short = value.rstrip(".")
                i -= len(value) - len(short)
                value = short
            self.tokens.append((kind, value))
        self.tokens.append(("end", ""))

    # Tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def next(self) -> tuple[str, str]:
        t = self.tokens[self.at]
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return t

    def mark(self, value: str) -> bool:
        if self.peek() == ("mark", value):
            self.at += 1
            return True
        return False

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        k, v = self.peek(ahead)
        return k == "word" and v.upper() in words

    def word(self, *words: str) -> str | None:
        if self.is_word(*words):
            return self.next()[1].upper()
        return None

    def fail(self, wanted: str):
        raise SparqlSyntaxError(f"expected {wanted} and found {self.peek()[1] or 'the end'!r}")

    def need(self, value: str) -> None:
        if not self.mark(value):
            self.fail(value)

    def need_word(self, *words: str) -> str:
        return self.word(*words) or self.fail(" or ".join(words))

    def fresh(self) -> A.Var:
        """A variable that no query can name, for a blank node."""
        self.made += 1
        return A.Var(f".b{self.made}")

    # Terms
    def resolve(self, value: str) -> str:
        return resolve(self.base, unescape(value))

    def iri(self) -> str:
        k, v = self.next()
        if k == "iri":
            return self.resolve(v[1:-1])
        if k == "name":
            p, _, local = v.partition(":")
            if p not in self.prefixes:
                raise SparqlSyntaxError(f"unknown prefix {p}:")
            return self.prefixes[p] + re.sub(r"\\(.)", r"\1", local)
        self.at -= 1
        self.fail("an IRI")

    def is_iri(self) -> bool:
        return self.peek()[0] in ("iri", "name")

    def literal(self) -> Term | None:
        k, v = self.peek()
        sign = ""
        if k == "mark" and v in "+-" and self.peek(1)[0] == "num":
            self.next()
            sign = v if v == "-" else ""
            k, v = self.peek()
        if k == "num":
            self.next()
            return literal(sign + v, XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"))
        if k in ("str", "long"):
            self.next()
            text = unescape(v[3:-3] if k == "long" else v[1:-1])
            if self.peek()[0] == "lang":
                lang, _, direction = self.next()[1][1:].partition("--")
                return literal(text, lang=lang, dir=direction or None)
            if self.mark("^^"):
                return literal(text, self.iri())
            return literal(text)
        if k == "word" and v.lower() in ("true", "false"):
            self.next()
            return literal(v.lower(), XSD + "boolean")
        return None

    def node(self, out: list, labels: dict) -> A.Node:
        """A term or variable; what brackets and lists stand for goes to out."""
        k, v = self.peek()
        if k == "var":
            self.next()
            return A.Var(v[1:])
        if k in ("iri", "name"):
            return iri(self.iri())
        if k == "bnode":
            self.next()
            return labels.setdefault(v, self.fresh())
        if self.mark("["):
            b = self.fresh()
            if not self.mark("]"):
                self.properties(b, out, labels)
                self.need("]")
            return b
        if self.mark("("):
            items = []
            while not self.mark(")"):
                items.append(self.node(out, labels))
            cells = [self.fresh() for _ in items]
            for i, (c, x) in enumerate(zip(cells, items, strict=True)):
                out.append(A.Triple(c, iri(RDF + "first"), x))
                out.append(A.Triple(c, iri(RDF + "rest"), cells[i + 1] if i + 1 < len(cells) else iri(RDF + "nil")))
            return cells[0] if cells else iri(RDF + "nil")
        if self.mark("<<"):
            inner = self.quoted(out, labels)
            r = self.node(out, labels) if self.word("~") else self.fresh()
            self.need(">>")
            self.reify(r, inner, out)
            return r
        if self.mark("<<("):
            inner = self.quoted(out, labels)
            self.need(")>>")
            if not all(isinstance(x, Term) for x in inner):
                raise SparqlSyntaxError("a triple term in a pattern takes no variables; use << >>")
            return triple_term(*inner)
        t = self.literal()
        return t if t is not None else self.fail("a term")

    def quoted(self, out: list, labels: dict) -> tuple:
        s = self.node(out, labels)
        p = iri(RDF + "type") if self.word("A") else A.Var(self.next()[1][1:]) if self.peek()[0] == "var" else iri(self.iri())
        return s, p, self.node(out, labels)

    def reify(self, r: A.Node, inner: tuple, out: list) -> None:
        if all(isinstance(x, Term) for x in inner):
            out.append(A.Triple(r, iri(RDF + "reifies"), triple_term(*inner)))
        else:
            t = self.fresh()
            out.append(A.Triple(r, iri(RDF + "reifies"), t))
            for name, x in zip(("SUBJECT", "PREDICATE", "OBJECT"), inner, strict=True):
                part = A.Call(name, [t])
                if isinstance(x, A.Var) and x not in {y for e in out if isinstance(e, A.Triple) for y in (e.s, e.o)} and not any(isinstance(e, A.Bind) and e.var == x.name for e in out):
                    out.append(A.Bind(x.name, part))
                else:
                    out.append(A.Call("SAMETERM", [part, x]))

    # Triples
    def triples(self, out: list, labels: dict) -> None:
        while True:
            k, v = self.peek()
            if not (k in ("var", "iri", "name", "bnode", "str", "long", "num") or (k == "mark" and v in ("[", "(", "<<", "+", "-")) or self.is_word("TRUE", "FALSE")):
                return
            bare = k == "mark" and v in ("[", "(", "<<")
            s = self.node(out, labels)
            if not (bare and (self.peek() in (("mark", "."), ("mark", "}")))):
                self.properties(s, out, labels)
            if not self.mark("."):
                return

    def properties(self, s: A.Node, out: list, labels: dict) -> None:
        while True:
            p = A.Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            if isinstance(p, A.Link):
                p = iri(p.iri)
            while True:
                out.append(A.Triple(s, p, self.node(out, labels)))
                if not self.mark(","):
                    break
            if not self.mark(";"):
                return
            while self.mark(";"):
                pass
            if self.peek() in (("mark", "."), ("mark", "]"), ("mark", "}")):
                return

    def path(self):
        parts = [self.path_sequence()]
        while self.mark("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else A.Alternative(tuple(parts))

    def path_sequence(self):
        parts = [self.path_step()]
        while self.mark("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else A.Sequence(tuple(parts))

    def path_step(self):
        if self.mark("^"):
            return A.Inverse(self.path_step())
        if self.mark("("):
            p = self.path()
            self.need(")")
        elif self.mark("!"):
            p = self.negated()
        elif self.is_word("A"):
            self.next()
            p = A.Link(RDF + "type")
        else:
            p = A.Link(self.iri())
        if self.mark("*"):
            return A.Closure(p, True, True)
        if self.mark("+"):
            return A.Closure(p, False, True)
        if self.mark("?"):
            return A.Closure(p, True, False)
        return p

    def negated(self):
        forward, backward = [], []

        def one():
            to = backward if self.mark("^") else forward
            to.append(RDF + "type" if self.word("A") else self.iri())

        if self.mark("("):
            while not self.mark(")"):
                one()
                self.mark("|")
        else:
            one()
        return A.Negated(tuple(forward), tuple(backward))

    # Groups
    def group(self) -> A.Group:
        self.need("{")
        if self.is_word("SELECT"):
            q = self.select()
            q = self.trailing_values(q)
            self.need("}")
            return A.Group([A.SubSelect(q)])
        g, labels = A.Group(), {}
        while not self.mark("}"):
            found: list = []
            self.triples(found, labels)
            for x in found:
                (g.filters if isinstance(x, A.Call) else g.elements).append(x)
            if self.mark("}"):
                break
            if self.word("FILTER"):
                g.filters.append(self.constraint())
            elif self.word("OPTIONAL"):
                g.elements.append(A.Optional_(self.group()))
            elif self.word("MINUS"):
                g.elements.append(A.Minus(self.group()))
            elif self.word("GRAPH"):
                k, v = self.peek()
                where = A.Var(self.next()[1][1:]) if k == "var" else iri(self.iri())
                g.elements.append(A.InGraph(where, self.group()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need_word("AS")
                name = self.variable()
                self.need(")")
                g.elements.append(A.Bind(name, e))
            elif self.word("VALUES"):
                g.elements.append(self.values())
            elif self.word("SERVICE"):
                raise SparqlSyntaxError("SERVICE is not supported: there is no network access from a query")
            elif self.peek() == ("mark", "{"):
                branches = [self.group()]
                while self.word("UNION"):
                    branches.append(self.group())
                g.elements.append(branches[0] if len(branches) == 1 else A.Union_(branches))
            else:
                self.fail("a graph pattern")
            self.mark(".")
        return g

    def variable(self) -> str:
        k, v = self.next()
        if k != "var":
            self.at -= 1
            self.fail("a variable")
        return v[1:]

    def values(self) -> A.Values:
        single = self.peek()[0] == "var"
        names = []
        if single:
            names.append(self.variable())
        else:
            self.need("(")
            while not self.mark(")"):
                names.append(self.variable())
        self.need("{")
        rows = []
        while not self.mark("}"):
            if single:
                rows.append([self.value()])
            else:
                self.need("(")
                row = []
                while not self.mark(")"):
                    row.append(self.value())
                if len(row) != len(names):
                    raise SparqlSyntaxError("a row of VALUES has another length than its variables")
                rows.append(row)
        return A.Values(names, rows)

    def value(self) -> Term | None:
        if self.word("UNDEF"):
            return None
        if self.is_iri():
            return iri(self.iri())
        return self.literal() or self.fail("a value")

    # Expressions
    def constraint(self):
        if self.peek() == ("mark", "("):
            self.next()
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self):
        e = self.conjunction()
        while self.mark("||"):
            e = A.Call("||", [e, self.conjunction()])
        return e

    def conjunction(self):
        e = self.relation()
        while self.mark("&&"):
            e = A.Call("&&", [e, self.relation()])
        return e

    def relation(self):
        e = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.mark(op):
                return A.Call(op, [e, self.sum()])
        if self.word("IN"):
            return A.Call("IN", [e, *self.arguments()])
        if self.is_word("NOT") and self.is_word("IN", ahead=1):
            self.next()
            self.next()
            return A.Call("!", [A.Call("IN", [e, *self.arguments()])])
        return e

    def sum(self):
        e = self.product()
        while True:
            if self.mark("+"):
                e = A.Call("+", [e, self.product()])
            elif self.mark("-"):
                e = A.Call("-", [e, self.product()])
            else:
                return e

    def product(self):
        e = self.unary()
        while True:
            if self.mark("*"):
                e = A.Call("*", [e, self.unary()])
            elif self.mark("/"):
                e = A.Call("/", [e, self.unary()])
            else:
                return e

    def unary(self):
        if self.mark("!"):
            return A.Call("!", [self.unary()])
        if self.peek() == ("mark", "-") and self.peek(1)[0] != "num":
            self.next()
            return A.Call("NEGATE", [self.unary()])
        if self.peek() == ("mark", "+") and self.peek(1)[0] != "num":
            self.next()
            return self.unary()
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.mark(")"):
            out.append(self.expression())
            self.mark(",")
        return out

    def primary(self):
        k, v = self.peek()
        if k == "var":
            self.next()
            return A.Var(v[1:])
        if self.mark("("):
            e = self.expression()
            self.need(")")
            return e
        if self.word("EXISTS"):
            return A.Exists(self.group(), False)
        if self.is_word("NOT") and self.is_word("EXISTS", ahead=1):
            self.next()
            self.next()
            return A.Exists(self.group(), True)
        if k == "word" and v.upper() in AGGREGATES:
            self.next()
            self.need("(")
            distinct = bool(self.word("DISTINCT"))
            arg = None if self.mark("*") else self.expression()
            separator = " "
            if self.mark(";"):
                self.need_word("SEPARATOR")
                self.need("=")
                separator = self.literal().value
            self.need(")")
            return A.Aggregate(v.upper(), arg, distinct, separator)
        if k == "word" and v.upper() in FUNCTIONS:
            self.next()
            return A.Call(v.upper(), self.arguments())
        if self.is_iri():
            name = self.iri()
            if self.peek() == ("mark", "("):
                return A.Call(name, self.arguments())
            return iri(name)
        t = self.literal()
        return t if t is not None else self.fail("an expression")

    # Queries
    def prologue(self) -> None:
        while True:
            if self.word("BASE"):
                self.base = self.resolve(self.next()[1][1:-1])
            elif self.word("PREFIX"):
                k, name = self.next()
                if k != "name" or not name.endswith(":"):
                    raise SparqlSyntaxError("expected a prefix")
                self.prefixes[name[:-1]] = self.resolve(self.next()[1][1:-1])
            else:
                return

    def dataset(self, q: A.Query) -> None:
        while self.word("FROM"):
            (q.named_graphs if self.word("NAMED") else q.default_graphs).append(self.iri())

    def query(self) -> A.Query:
        self.prologue()
        if self.is_word("SELECT"):
            q = self.select(dataset=True)
        elif self.word("ASK"):
            q = A.Query("ask", A.Group())
            self.dataset(q)
            self.word("WHERE")
            q.where = self.group()
            self.modifiers(q)
        elif self.word("CONSTRUCT"):
            q = A.Query("construct", A.Group())
            if self.peek() == ("mark", "{"):
                self.need("{")
                self.triples(q.template, {})
                self.need("}")
                self.dataset(q)
                self.word("WHERE")
                q.where = self.group()
            else:
                self.dataset(q)
                self.need_word("WHERE")
                q.where = self.group()
                q.template = [e for e in q.where.elements if isinstance(e, A.Triple)]
            self.modifiers(q)
        elif self.word("DESCRIBE"):
            q = A.Query("describe", A.Group())
            if not self.mark("*"):
                while self.peek()[0] == "var" or self.is_iri():
                    q.describe.append(A.Var(self.variable()) if self.peek()[0] == "var" else iri(self.iri()))
            self.dataset(q)
            if self.word("WHERE") or self.peek() == ("mark", "{"):
                q.where = self.group()
            self.modifiers(q)
        else:
            self.fail("SELECT, ASK, CONSTRUCT or DESCRIBE")
        q = self.trailing_values(q)
        if self.peek()[0] != "end":
            self.fail("the end")
        return q

    def trailing_values(self, q: A.Query) -> A.Query:
        if self.word("VALUES"):
            q.where = A.Group([q.where, self.values()])
        return q

    def select(self, dataset: bool = False) -> A.Query:
        self.need_word("SELECT")
        q = A.Query("select", A.Group())
        q.distinct, q.reduced = bool(self.word("DISTINCT")), bool(self.word("REDUCED"))
        if not self.mark("*"):
            while True:
                if self.peek()[0] == "var":
                    q.select.append((self.variable(), None))
                elif self.mark("("):
                    e = self.expression()
                    self.need_word("AS")
                    q.select.append((self.variable(), e))
                    self.need(")")
                else:
                    break
            if not q.select:
                self.fail("what to select")
        if dataset:
            self.dataset(q)
        self.word("WHERE")
        q.where = self.group()
        self.modifiers(q)
        return q

    def modifiers(self, q: A.Query) -> None:
        if self.word("GROUP"):
            self.need_word("BY")
            while True:
                if self.peek()[0] == "var":
                    name = self.variable()
                    q.group_by.append((name, A.Var(name)))
                elif self.mark("("):
                    e = self.expression()
                    q.group_by.append((self.variable() if self.word("AS") else None, e))
                    self.need(")")
                elif (self.peek()[0] == "word" and self.peek()[1].upper() in FUNCTIONS) or self.is_iri():
                    q.group_by.append((None, self.primary()))
                else:
                    break
        if self.word("HAVING"):
            while self.peek() == ("mark", "(") or (self.peek()[0] == "word" and self.peek()[1].upper() in FUNCTIONS | AGGREGATES):
                q.having.append(self.constraint())
        if self.word("ORDER"):
            self.need_word("BY")
            while True:
                direction = self.word("ASC", "DESC")
                if direction or self.peek()[0] == "var" or self.peek() == ("mark", "(") or (self.peek()[0] == "word" and self.peek()[1].upper() in FUNCTIONS | AGGREGATES):
                    q.order_by.append((self.constraint(), direction != "DESC"))
                else:
                    break
        while True:
            if self.word("LIMIT"):
                q.limit = int(self.next()[1])
            elif self.word("OFFSET"):
                q.offset = int(self.next()[1])
            else:
                return

    # Updates
    def update(self) -> A.Update:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                break
            out.append(self.operation())
            if not self.mark(";"):
                break
        if self.peek()[0] != "end":
            self.fail("the end")
        return A.Update(out)

    def operation(self):
        verb = self.word("LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD")
        if verb:
            silent = bool(self.word("SILENT"))
            if verb == "LOAD":
                source = self.iri()
                return A.Manage(verb, source, self.graph_ref() if self.word("INTO") else "DEFAULT", silent)
            if verb in ("CLEAR", "DROP", "CREATE"):
                return A.Manage(verb, self.graph_ref(), None, silent)
            source = self.graph_ref()
            self.need_word("TO")
            return A.Manage(verb, source, self.graph_ref(), silent)
        with_graph = self.iri() if self.word("WITH") else None
        m = A.Modify([], [], None, with_graph)
        if self.is_word("INSERT", "DELETE") and self.is_word("DATA", ahead=1):
            verb = self.word("INSERT", "DELETE")
            self.next()
            (m.insert if verb == "INSERT" else m.delete).extend(self.quads())
            return m
        if self.is_word("DELETE") and self.is_word("WHERE", ahead=1):
            self.next()
            self.next()
            m.delete = self.quads()
            m.where = A.Group()
            for g, t in m.delete:
                m.where.elements.append(t if g is None else A.InGraph(g, A.Group([t])))
            return m
        if self.word("DELETE"):
            m.delete = self.quads()
        if self.word("INSERT"):
            m.insert = self.quads()
        while self.word("USING"):
            (m.using_named if self.word("NAMED") else m.using).append(self.iri())
        self.need_word("WHERE")
        m.where = self.group()
        return m

    def graph_ref(self) -> str:
        w = self.word("DEFAULT", "NAMED", "ALL")
        if w:
            return w
        self.word("GRAPH")
        return self.iri()

    def quads(self) -> list:
        out: list = []
        labels: dict = {}
        self.need("{")
        while not self.mark("}"):
            if self.word("GRAPH"):
                g = A.Var(self.variable()) if self.peek()[0] == "var" else iri(self.iri())
                found: list = []
                self.need("{")
                self.triples(found, labels)
                self.need("}")
                out += [(g, t) for t in found]
                self.mark(".")
            else:
                found = []
                self.triples(found, labels)
                if not found:
                    self.fail("a triple")
                out += [(None, t) for t in found]
        return out


def parse_query(text: str, base: str = "") -> A.Query:
    return Parser(text, base).query()


def parse_update(text: str, base: str = "") -> A.Update:
    return Parser(text, base).update()


def is_update(text: str, base: str = "") -> bool:
    """Whether a request changes the store, from its first word behind the prologue."""
    p = Parser(text, base)
    p.prologue()
    return p.is_word("INSERT", "DELETE", "WITH", "LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD")
