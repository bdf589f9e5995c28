"""What a query means: graph patterns, paths, expressions, query forms and updates."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quadrille.functions.terms import Term


@dataclass(frozen=True)
class Var:
    name: str


Node = Term | Var


# Paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: Any


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Closure:
    path: Any
    zero: bool
    many: bool


@dataclass(frozen=True)
class Negated:
    forward: tuple
    backward: tuple


# Patterns
@dataclass
class Triple:
    s: Node
    p: Any  # Var, Term or a path
    o: Node


@dataclass
class Group:
    """Elements in the order written; filters hold for the whole group."""

    elements: list = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Optional_:
    group: Group


@dataclass
class Union_:
    branches: list


@dataclass
class Minus:
    group: Group


@dataclass
class InGraph:
    graph: Node
    group: Group


@dataclass
class Bind:
    var: str
    expr: Any


@dataclass
class Values:
    vars: list
    rows: list  # of lists of Term or None


@dataclass
class SubSelect:
    query: Any


# Expressions
@dataclass
class Call:
    name: str
    args: list


@dataclass
class Exists:
    group: Group
    negated: bool


@dataclass
class Aggregate:
    name: str
    arg: Any  # None for *
    distinct: bool
    separator: str = " "


# Query forms
@dataclass
class Query:
    form: str  # select, ask, construct, describe
    where: Group
    select: list = field(default_factory=list)  # (name, expr or None); empty for *
    distinct: bool = False
    reduced: bool = False
    template: list = field(default_factory=list)
    describe: list = field(default_factory=list)
    default_graphs: list = field(default_factory=list)
    named_graphs: list = field(default_factory=list)
    group_by: list = field(default_factory=list)  # (name or None, expr)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (expr, ascending)
    limit: int | None = None
    offset: int | None = None


@dataclass
class Modify:
    """DELETE/INSERT with a WHERE, or of data if where is None. Templates are (graph or None, Triple)."""

    delete: list
    insert: list
    where: Group | None
    with_graph: str | None = None
    using: list = field(default_factory=list)
    using_named: list = field(default_factory=list)


@dataclass
class Manage:
    """LOAD, CLEAR, CREATE, DROP, COPY, MOVE or ADD. Targets are an IRI or DEFAULT, NAMED, ALL."""

    verb: str
    source: str
    target: str | None = None
    silent: bool = False


@dataclass
class Update:
    operations: list
