"""Object schemas: types, properties, links and the tables that hold them."""

from __future__ import annotations

from dataclasses import dataclass, field


class SchemaError(ValueError):
    """A schema that contradicts itself."""


@dataclass(frozen=True)
class Link:
    """A reference to `target`. Single links hold the key in a column; `through` names a bridge table of a multi link,
    with the columns of source and target key and further properties, read as @name."""

    target: str
    column: str | None = None
    through: str | None = None
    source_column: str | None = None
    target_column: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    on_target_delete: str = "allow"
    on_source_delete: str = "allow"

    @property
    def many(self) -> bool:
        return self.through is not None


@dataclass
class ObjectType:
    """Properties map names to columns; `key` is the expression of the object's identity."""

    name: str
    table: str | None = None
    key: str = "id"
    properties: dict[str, str] = field(default_factory=dict)
    links: dict[str, Link] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    bases: tuple[str, ...] = ()
    interface: bool = False
    defaults: dict[str, str] = field(default_factory=dict)
    constraints: tuple[Constraint, ...] = ()
    rewrites: tuple[Rewrite, ...] = ()
    triggers: tuple[Trigger, ...] = ()
    partition: tuple[str, str] | None = None


@dataclass(frozen=True)
class Constraint:
    """exclusive (fields; unless: an expression under which rows are free), expression (that must hold), readonly, min,
    max, min_ex, max_ex, min_len, max_len, regexp, one_of (a field and its bound)."""

    kind: str
    fields: tuple[str, ...] = ()
    arg: object = None
    unless: str | None = None


@dataclass(frozen=True)
class Rewrite:
    """A property that an expression sets before rows are written, on 'insert', 'update' or both."""

    field: str
    expression: str
    on: tuple[str, ...] = ("insert", "update")


@dataclass(frozen=True)
class Trigger:
    """A statement that runs after rows are written or deleted, for each of them as __new__ or __old__."""

    on: tuple[str, ...]
    handler: str


# Policies for links of deleted objects, and partition intervals.
POLICIES = ("allow", "restrict", "deferred_restrict", "delete_source", "delete_target", "delete_target_if_orphan")
INTERVALS = {"daily": "DAY", "weekly": "WEEK", "monthly": "MONTH", "yearly": "YEAR"}


@dataclass
class Function:
    """A function in the query language: parameter names and a body."""

    name: str
    params: tuple[str, ...]
    body: str


class Schema:
    def __init__(self, types: list[ObjectType], aliases: dict[str, str] | None = None, functions: list[Function] = (), globals_: dict[str, str] | None = None, enums: dict[str, tuple[str, ...]] | None = None):
        self.types = {t.name: t for t in types}
        self.aliases = dict(aliases or {})
        self.functions = {f.name: f for f in functions}
        self.globals = dict(globals_ or {})
        self.enums = dict(enums or {})
        self.check()

    def check(self) -> None:
        for t in self.types.values():
            for b in t.bases:
                if b not in self.types:
                    raise SchemaError(f"type '{t.name}' extends unknown type '{b}'")
            for name, link in t.links.items():
                if link.target not in self.types:
                    raise SchemaError(f"link '{t.name}.{name}' points to unknown type '{link.target}'")
                if link.on_target_delete not in POLICIES or link.on_source_delete not in POLICIES:
                    raise SchemaError(f"link '{t.name}.{name}' has an unknown deletion policy")
            known = {*t.properties, *t.links}
            for c in t.constraints:
                for f in c.fields:
                    if f not in known:
                        raise SchemaError(f"a constraint of '{t.name}' names unknown '{f}'")
            for f in [*t.defaults, *[r.field for r in t.rewrites]]:
                if f not in known:
                    raise SchemaError(f"'{t.name}' sets unknown '{f}'")
            if t.partition is not None and (t.partition[0] not in t.properties or t.partition[1] not in INTERVALS):
                raise SchemaError(f"'{t.name}' can't be partitioned by {t.partition}")
            for trigger in t.triggers:
                self._check_trigger(t, trigger)
            if not t.interface and t.table is None:
                raise SchemaError(f"type '{t.name}' has no table")

    @staticmethod
    def _check_trigger(t: ObjectType, trigger: Trigger) -> None:
        """Handlers are read at once; one that would fire itself again is refused."""
        from .plans import ast as A
        from .plans.parser import parse

        node = parse(trigger.handler)
        does = {A.Insert: "insert", A.Update: "update", A.Delete: "delete"}.get(type(node))
        if does in trigger.on and node.type == t.name:
            raise SchemaError(f"a trigger of '{t.name}' would fire itself")
        if "insert" in trigger.on and "__old__" in trigger.handler or "delete" in trigger.on and "__new__" in trigger.handler:
            raise SchemaError(f"a trigger of '{t.name}' names a row that its event doesn't have")

    def concrete(self, name: str) -> list[ObjectType]:
        """The types whose rows a read of `name` returns: itself, if it has a table, and all that extend it."""
        own = self.types[name]
        out = [] if own.interface else [own]
        for t in self.types.values():
            if name in t.bases:
                out += self.concrete(t.name)
        return out
