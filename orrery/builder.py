"""A query builder in Python that makes the same syntax trees as query texts.

    Order = Model(engine, "Order")
    Order.filter(lambda o: (o.totalprice > 100.0) & (o.customer.name != "x")).order_by("-totalprice").limit(3)
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from .plans import ast as A

_OPS = {"__eq__": "=", "__ne__": "!=", "__lt__": "<", "__le__": "<=", "__gt__": ">", "__ge__": ">=", "__add__": "+", "__sub__": "-", "__mul__": "*", "__truediv__": "/", "__floordiv__": "//", "__mod__": "%", "__and__": "and", "__or__": "or"}


def node(value) -> A.Node:
    if isinstance(value, Expr):
        return value._node
    if isinstance(value, Model):
        return value.tree()
    if isinstance(value, list | set | tuple):
        return A.SetOf(tuple(node(v) for v in value))
    kind = {bool: "bool", int: "int64", float: "float64", str: "str"}.get(type(value))
    if kind is None:
        raise TypeError(f"{type(value).__name__} can't stand in a query")
    return A.Lit(value, kind)


class Expr:
    """An expression under construction; Python operators make larger ones."""

    def __init__(self, tree: A.Node):
        self._node = tree

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return Expr(A.Step(self._node, name))

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; combine conditions with &, | and ~")

    def __invert__(self) -> Expr:
        return Expr(A.Unary("not", self._node))

    def __neg__(self) -> Expr:
        return Expr(A.Unary("-", self._node))

    def isin(self, values) -> Expr:
        return Expr(A.Binary("in", self._node, node(values)))

    def like(self, pattern: str) -> Expr:
        return Expr(A.Binary("like", self._node, node(pattern)))

    def backlink(self, name: str, kind: str) -> Expr:
        return Expr(A.Step(A.Step(self._node, name, "back"), kind, "is"))

    __hash__ = None


def _binary(op: str):
    return lambda self, other: Expr(A.Binary(op, self._node, node(other)))


for _name, _op in _OPS.items():
    setattr(Expr, _name, _binary(_op))


class _Std:
    """std.count(x) and so on."""

    def __getattr__(self, name: str):
        return lambda *args, **named: Expr(A.Call(name.replace("__", "::"), tuple(node(a) for a in args), tuple((k, node(v)) for k, v in named.items())))


std = _Std()


class Model:
    def __init__(self, engine, name: str, mods: A.Mods = A.Mods(), elements: tuple[A.Element, ...] = ()):  # noqa: B008
        self.engine, self.name, self._mods, self._elements = engine, name, mods, elements

    def _with(self, **changes) -> Model:
        return Model(self.engine, self.name, replace(self._mods, **changes), self._elements)

    def filter(self, test) -> Model:
        cond = node(test(Expr(A.Dot())))
        return self._with(filter=cond if self._mods.filter is None else A.Binary("and", self._mods.filter, cond))

    def select(self, *names: str, **computed) -> Model:
        made = tuple(A.Element(n) for n in names) + tuple(A.Element(n, node(f(Expr(A.Dot())) if callable(f) else f), kind="computed") for n, f in computed.items())
        return Model(self.engine, self.name, self._mods, self._elements + made)

    def order_by(self, *keys: str) -> Model:
        order = tuple((A.Step(A.Dot(), k.lstrip("-")), k.startswith("-"), False) for k in keys)
        return self._with(order=self._mods.order + order)

    def limit(self, n: int) -> Model:
        return self._with(limit=node(n))

    def offset(self, n: int) -> Model:
        return self._with(offset=node(n))

    def tree(self) -> A.Node:
        base: A.Node = A.Name(self.name)
        return A.Select(A.Shaped(base, self._elements) if self._elements else base, self._mods)

    def df(self) -> DataFrame:
        return self.engine.run(self.tree())
