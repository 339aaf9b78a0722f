"""Nodes of parsed queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: Any
    type: str


@dataclass(frozen=True)
class Param(Node):
    name: str
    optional: bool = False


@dataclass(frozen=True)
class Global(Node):
    name: str


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Dot(Node):
    """The object that an expression without a root starts from."""


@dataclass(frozen=True)
class Step(Node):
    """base.name, base.<name (back), base@name (link property) or base[is T]."""

    base: Node
    name: str
    kind: str = "forward"


@dataclass(frozen=True)
class Index(Node):
    base: Node
    at: Node | None
    to: Node | None = None
    slice: bool = False


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class If(Node):
    cond: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Cast(Node):
    type: str
    arg: Node


@dataclass(frozen=True)
class Is(Node):
    arg: Node
    type: str
    negated: bool


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    named: tuple[tuple[str, Node], ...] = ()


@dataclass(frozen=True)
class SetOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class ArrayOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class TupleOf(Node):
    items: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Element(Node):
    """A shape element: a pointer, `name := value`, or a splat."""

    name: str
    value: Node | None = None
    shape: tuple[Element, ...] | None = None
    mods: Mods | None = None
    kind: str = "pointer"
    only: str | None = None


@dataclass(frozen=True)
class Mods(Node):
    filter: Node | None = None
    order: tuple[tuple[Node, bool, bool], ...] = ()
    offset: Node | None = None
    limit: Node | None = None


@dataclass(frozen=True)
class Shaped(Node):
    base: Node
    elements: tuple[Element, ...]


@dataclass(frozen=True)
class Select(Node):
    source: Node
    mods: Mods = field(default_factory=Mods)
    alias: str | None = None


@dataclass(frozen=True)
class Group(Node):
    source: Node
    using: tuple[tuple[str, Node], ...]
    by: tuple[str, ...]


@dataclass(frozen=True)
class For(Node):
    name: str
    source: Node
    body: Node
    optional: bool = False


@dataclass(frozen=True)
class With(Node):
    bindings: tuple[tuple[str, Node], ...]
    body: Node


@dataclass(frozen=True)
class Analyze(Node):
    body: Node


@dataclass(frozen=True)
class Insert(Node):
    type: str
    values: tuple[tuple[str, str, Node], ...]
    conflict: Node | None = None
    otherwise: Node | None = None
    guarded: bool = False


@dataclass(frozen=True)
class Update(Node):
    type: str
    mods: Mods
    values: tuple[tuple[str, str, Node], ...]


@dataclass(frozen=True)
class Delete(Node):
    type: str
    mods: Mods
