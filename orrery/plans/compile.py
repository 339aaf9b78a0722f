"""From parsed queries to DataFrames.

A set of objects is a `Frame`: a DataFrame whose columns carry a prefix for each object that is in reach. Paths over
single links add left joins to it, once each; sets that depend on a row (back links, bridge links, sub-selects) are
compiled apart, keyed by the row's identity, and come back as one aggregate for each key or as a semi or anti join.
So no plan holds a correlated subquery, and Catalyst sees joins and aggregates only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stdlib
from ..schema import ObjectType, Schema
from . import ast as A
from .lexer import QueryError
from .parser import parse

AGGREGATES = stdlib.AGGREGATES


@dataclass
class Frame:
    """Rows of objects (type set) or of values (type None, column `value`)."""

    df: DataFrame
    type: ObjectType | None = None
    prefix: str = ""
    joined: dict = field(default_factory=dict)
    value: Column | None = None
    elements: tuple[A.Element, ...] | None = None
    mods: A.Mods = field(default_factory=A.Mods)
    keys: dict | None = None  # of a group: the key columns
    keys_of: tuple[str, ...] = ()
    env: dict | None = None
    link: tuple[str, dict] | None = None  # prefix and properties of the bridge that led here
    order: tuple[Column, ...] = ()  # of values that come from an ordered set

    def col(self, name: str) -> Column:
        return F.col(f"`{self.prefix}{name}`")

    @property
    def key(self) -> Column:
        return self.col("__key")


def _renamed(node, name: str):
    """The node with paths from the name as paths from the object at hand."""
    if isinstance(node, A.Name) and node.name == name:
        return A.Dot()
    if isinstance(node, tuple):
        return tuple(_renamed(x, name) for x in node)
    if isinstance(node, A.Node):
        return type(node)(**{k: _renamed(v, name) for k, v in vars(node).items()})
    return node


class Compiler:
    def __init__(self, spark: SparkSession, schema: Schema, tables, params: dict | None = None, globals_: dict | None = None):
        self.spark, self.schema, self.tables = spark, schema, tables
        self.params, self.globals = params or {}, globals_ or {}
        self.count = 0
        self.engine = None  # where statements that write may stand as sources

    def fresh(self, stem: str = "t") -> str:
        self.count += 1
        return f"{stem}{self.count}_"

    # --- scans

    def scan(self, name: str) -> Frame:
        if name not in self.schema.types:
            near = [t for t in self.schema.types if t.lower() == name.lower()]
            raise QueryError(f"unknown type '{name}'" + (f"; did you mean '{near[0]}'?" if near else ""))
        kind = self.schema.types[name]
        prefix = self.fresh(name.lower())
        parts = []
        for t in self.schema.concrete(name):
            df = self.tables(t.table)
            cols = [F.expr(t.key).alias(f"{prefix}__key"), F.lit(t.name).alias(f"{prefix}__type__")]
            shown = kind.properties if t.name != name else t.properties
            cols += [F.expr(t.properties[p]).alias(prefix + p) for p in shown]
            shown_links = {n: k for n, k in (kind if t.name != name else t).links.items() if k.column}
            cols += [F.expr(t.links[n].column).alias(f"{prefix}{n}__fk") for n in shown_links]
            if t.name != name:  # what only the concrete type has, for [is T]
                cols += [F.expr(e).alias(f"{prefix}{t.name}.{p}") for p, e in t.properties.items() if p not in kind.properties]
            parts.append(df.select(*cols))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p, allowMissingColumns=True)
        return Frame(df, kind, prefix)

    def follow(self, frame: Frame, link_name: str, how: str = "left") -> Frame:
        """The object at the end of a single link of the frame's object, joined in once."""
        at = (frame.prefix, link_name)
        if at not in frame.joined:
            target = self.scan(frame.type.links[link_name].target)
            fk = frame.col(f"{link_name}__fk")
            frame.df = frame.df.join(target.df, fk == target.key, how)
            frame.joined[at] = (target.type, target.prefix)
        kind, prefix = frame.joined[at]
        return replace(frame, type=kind, prefix=prefix, elements=None, link=None)

    # --- sets

    def rows(self, node: A.Node, env: dict) -> Frame:
        """The set that an expression stands for, as a frame of its own."""
        if isinstance(node, A.Name):
            if node.name in env:
                bound, own = env[node.name]
                if isinstance(bound, Frame) and bound.df is not None:
                    return replace(bound, joined=dict(bound.joined))
                if isinstance(bound, A.Node):
                    return self.rows(bound, own)
                raise QueryError(f"'{node.name}' can't be read as a set here")
            if node.name in self.schema.aliases:
                return self.rows(parse(self.schema.aliases[node.name]), {})
            return self.scan(node.name)
        if isinstance(node, A.With):
            env = dict(env)
            for name, value in node.bindings:
                env[name] = (value, dict(env))
            return self.rows(node.body, env)
        if isinstance(node, A.Insert | A.Update | A.Delete):
            return self.written(node)
        if isinstance(node, A.Select):
            frame = self.rows(node.source, env)
            root = node.source.base if isinstance(node.source, A.Shaped) else node.source
            if isinstance(root, A.Name) and root.name in env and frame.keys is None:
                env = {**env, root.name: (A.Dot(), env)}  # in its own conditions the name is the row at hand
            return self.modified(frame, node.mods, env, node.alias)
        if isinstance(node, A.Shaped):
            if isinstance(node.base, A.SetOf) and node.base.items == (A.Lit(True, "bool"),):
                one = Frame(self.spark.range(1).select(F.lit(0).alias("__one")), env=env)
                return replace(one, elements=node.elements)
            frame = self.rows(node.base, env)
            old = {e.name: e for e in frame.elements or ()}
            return replace(frame, elements=tuple(old.get(e.name, e) if e.value is None and e.shape is None and e.name in old else e for e in node.elements), env=env)
        if isinstance(node, A.Group):
            return self.grouped(node, env)
        if isinstance(node, A.For):
            return self.loop(node, env)
        if isinstance(node, A.SetOf):
            return self.values([self.rows(i, env) for i in node.items])
        if isinstance(node, A.If) and isinstance(node.other, A.SetOf) and not node.other.items:
            target = node.then.base if isinstance(node.then, A.Shaped) else node.then
            if isinstance(target, A.Insert | A.Update | A.Delete):  # whether to write is known before
                if self.spark.range(1).select(self.scalar(node.cond, Frame(self.spark.range(1)), env)).first()[0]:
                    return self.rows(node.then, env)
                none = self.scan(target.type)
                return replace(none, df=none.df.where(F.lit(False)))
            frame = self.rows(node.then, env)
            holds = self.spark.range(1).select(self.scalar(node.cond, Frame(self.spark.range(1)), env).alias("__if"))
            return replace(frame, df=frame.df.crossJoin(F.broadcast(holds)).where("__if").drop("__if"))
        if isinstance(node, A.Binary) and node.op in ("union", "except", "intersect"):
            return self.combined(node.op, self.rows(node.left, env), self.rows(node.right, env), env)
        if isinstance(node, A.Binary) and node.op == "??" and self._is_set(node.left, env):
            left, right = self.rows(node.left, env), self.rows(node.right, env)
            a, b = self.finished(left, env), self.finished(right, env)
            none = a.limit(1).agg(F.count(F.lit(1)).alias("__n"))
            b = b.crossJoin(F.broadcast(none)).where("__n = 0").drop("__n").toDF(*a.columns)
            return Frame(a.unionByName(b), value=F.col(a.columns[0]))
        if isinstance(node, A.Unary) and node.op == "distinct":
            frame = self.rows(node.arg, env)
            if frame.type is None:
                df = frame.df.select(frame.value.alias("value")).distinct()
                return Frame(df, value=F.col("value"))
            return replace(frame, df=frame.df.dropDuplicates([f"{frame.prefix}__key"]))
        if isinstance(node, A.Unary) and node.op == "detached":
            return self.rows(node.arg, {})
        if isinstance(node, A.Step):
            return self.step(self.rows(node.base, env), node)
        if isinstance(node, A.Call):
            return self.called(node, env)
        one = Frame(self.spark.range(1).select(F.lit(0).alias("__one")), env=env)
        return replace(one, value=self.scalar(node, one, env))

    @staticmethod
    def _root(node: A.Node) -> A.Node:
        while isinstance(node, A.Step | A.Shaped | A.Index):
            node = node.base
        return node

    def _is_set(self, node: A.Node, env: dict) -> bool:
        root = self._root(node)
        if isinstance(root, A.Name):
            if root.name in env:
                bound, own = env[root.name]
                return isinstance(bound, Frame) and bound.df is not None or isinstance(bound, A.Node) and self._is_set(bound, own)
            return root.name in self.schema.types or root.name in self.schema.aliases
        if isinstance(root, A.Unary) and root.op in ("distinct", "detached"):
            return self._is_set(root.arg, {} if root.op == "detached" else env)
        if isinstance(root, A.Binary) and root.op in ("union", "except", "intersect"):
            return self._is_set(root.left, env) or self._is_set(root.right, env)
        return isinstance(root, A.Select | A.SetOf | A.Group | A.For | A.Insert | A.Update | A.Delete) or isinstance(root, A.Call) and (root.name in stdlib.SET_RETURNING or root.name in ("assert_exists", "assert_single", "assert_distinct") and self._is_set(root.args[0], env))

    def _names_set(self, node, env: dict) -> bool:
        """Whether there is a set somewhere in an expression."""
        if isinstance(node, tuple):
            return any(self._names_set(x, env) for x in node)
        if not isinstance(node, A.Node):
            return False
        return self._is_set(node, env) or any(self._names_set(v, env) for v in vars(node).values())

    def values(self, frames: list[Frame]) -> Frame:
        parts = []
        for f in frames:
            if f.type is not None:
                return self._union_objects(frames)
            parts.append(f.df.select(f.value.alias("value")))
        if not parts:
            return Frame(self.spark.range(0).select(F.lit(None).cast("string").alias("value")), value=F.col("value"))
        df = parts[0]
        for p in parts[1:]:
            df = df.union(p)
        return Frame(df.where("value IS NOT NULL"), value=F.col("value"))

    def _union_objects(self, frames: list[Frame]) -> Frame:
        df = None
        prefix = self.fresh("u")
        for f in frames:
            names = ["__key", "__type__", *f.type.properties, *[f"{n}__fk" for n, k in f.type.links.items() if k.column]]
            part = f.df.select(*[f.col(n).alias(prefix + n) for n in names])
            df = part if df is None else df.unionByName(part, allowMissingColumns=True)
        return Frame(df, frames[0].type, prefix, elements=frames[0].elements, env=frames[0].env)

    def combined(self, op: str, a: Frame, b: Frame, env: dict) -> Frame:
        if op == "union":
            return self.values([a, b])
        if a.type is None or b.type is None:
            left, right = a.df.select(a.value.alias("value")), b.df.select(b.value.alias("value"))
            df = left.subtract(right) if op == "except" else left.intersect(right)
            return Frame(df, value=F.col("value"))
        other = b.df.select(b.key.alias("__other")).distinct()
        df = a.df.join(other, a.key == F.col("__other"), "left_anti" if op == "except" else "left_semi")
        return replace(a, df=df.dropDuplicates([f"{a.prefix}__key"]))

    def step(self, frame: Frame, node: A.Step) -> Frame:
        """One step of a path that starts at a set of its own."""
        if frame.mods.limit is not None or frame.mods.offset is not None:
            frame = replace(frame, df=self._cut(frame), mods=A.Mods())
        if frame.keys is not None:
            return replace(frame, value=self.scalar(A.Step(A.Dot(), node.name), frame, frame.env or {}))
        if frame.type is None:
            return replace(frame, value=frame.value.getField(node.name), type=None)
        kind = frame.type
        order = tuple(self._order(frame, frame.env or {})) or frame.order
        if node.kind == "is":
            return self.narrowed(frame, node.name)
        if node.kind == "property":
            prefix, props = frame.link or (None, {})
            if node.name not in props:
                raise QueryError(f"there is no link property '@{node.name}' here")
            return replace(frame, value=F.col(prefix + node.name), type=None, order=order)
        if node.kind == "forward" and node.name in kind.links and not kind.links[node.name].many:
            out = self.follow(frame, node.name)
            return replace(out, df=out.df.where(out.key.isNotNull()))
        if node.kind == "forward" and (node.name in kind.properties or node.name == "id" or node.name in kind.computed):
            value = self.scalar(A.Step(A.Dot(), node.name), frame, {})
            name = self.fresh("v")
            df = frame.df.select("*", value.alias(name)).where(F.col(name).isNotNull())
            return Frame(df, value=F.col(name), joined=frame.joined, order=order)
        child, parent = self.dependent(frame, node)
        df = frame.df.join(child.df, frame.key == parent)
        return replace(child, df=df, joined={**frame.joined, **child.joined})

    def narrowed(self, frame: Frame, name: str) -> Frame:
        names = [t.name for t in self.schema.concrete(name)]
        out = replace(frame, df=frame.df.where(frame.col("__type__").isin(*names)))
        if frame.type.name != name and len(names) == 1:
            kind = self.schema.types[name]
            cols = {p: f"{frame.prefix}{name}.{p}" for p in kind.properties if p not in frame.type.properties}
            for p, c in cols.items():
                if c in out.df.columns:
                    out = replace(out, df=out.df.withColumnRenamed(c, frame.prefix + p))
            out = replace(out, type=replace(kind, links={k: v for k, v in kind.links.items() if f"{frame.prefix}{k}__fk" in out.df.columns or v.many}))
        return out

    def dependent(self, frame: Frame, node: A.Step, only: str | None = None) -> tuple[Frame, Column]:
        """The frame of a set-valued step from the frame's object, and its column with that object's key."""
        kind = frame.type
        if node.kind == "back":
            found = [(t, n, k) for t in self.schema.types.values() for n, k in t.links.items() if n == node.name and (only is None or t.name == only) and self._reaches(k.target, kind.name)]
            if not found:
                raise QueryError(f"no link '{node.name}' leads to '{kind.name}'" + (f" from '{only}'" if only else ""))
            source, name, link = found[0]
            child = self.scan(source.name)
            if not link.many:
                return child, child.col(f"{name}__fk")
            bridge, prefix = self.bridge(link)
            df = child.df.join(bridge, child.key == F.col(prefix + "source"))
            return replace(child, df=df, link=(prefix, link.properties)), F.col(prefix + "target")
        link = kind.links.get(node.name)
        if link is None:
            known = ", ".join(sorted([*kind.properties, *kind.links, *kind.computed]))
            raise QueryError(f"'{kind.name}' has no link or property '{node.name}' (it has {known})")
        child = self.scan(link.target)
        bridge, prefix = self.bridge(link)
        df = bridge.join(child.df, F.col(prefix + "target") == child.key)
        return replace(child, df=df, link=(prefix, link.properties)), F.col(prefix + "source")

    def _reaches(self, target: str, name: str) -> bool:
        return target == name or name in [t.name for t in self.schema.concrete(target)] or target in [t.name for t in self.schema.concrete(name)]

    def bridge(self, link) -> tuple[DataFrame, str]:
        prefix = self.fresh("b")
        cols = [F.expr(link.source_column).alias(prefix + "source"), F.expr(link.target_column).alias(prefix + "target")]
        cols += [F.expr(e).alias(prefix + n) for n, e in link.properties.items()]
        return self.tables(link.through).select(*cols), prefix

    def called(self, node: A.Call, env: dict) -> Frame:
        name = node.name
        if name in ("vector::search", "fts::search"):
            from ..operators import search

            return search.searched(self, node, env)
        if name in stdlib.SET_RETURNING:
            frame = Frame(self.spark.range(1).select(F.lit(0).alias("__one")), env=env)
            if self._is_set(node.args[0], env):
                frame = self.rows(node.args[0], env)
                first = frame.value
            else:
                first = self.scalar(node.args[0], frame, env)
            rest = [self.scalar(a, frame, env) for a in node.args[1:]]
            out = self.fresh("v")
            df = frame.df.select("*", stdlib.SET_RETURNING[name](first, *rest).alias(out))
            return Frame(df, value=F.col(out))
        if name in ("assert_exists", "assert_single", "assert_distinct"):
            return self.asserted(node, env)
        if name == "enumerate":
            frame = self.rows(node.args[0], env)
            value = frame.value if frame.type is None else frame.key
            order = self._order(frame, env) or [value.asc_nulls_last()]
            at = F.row_number().over(Window.orderBy(*order)).cast("long") - 1
            return Frame(frame.df.select(F.struct(at.alias("0"), value.alias("1")).alias("value")), value=F.col("value"))
        if name in AGGREGATES and len(node.args) == 1:
            arg, distinct = node.args[0], False
            if isinstance(arg, A.Unary) and arg.op == "distinct":
                arg, distinct = arg.arg, True
            frame, value = self.ranged(arg, env)
            order = tuple(self._order(frame, env)) or frame.order
            if name == "array_agg" and order and not distinct:
                df = frame.df.withColumn("__at", F.rank().over(Window.orderBy(*order)))
                return Frame(df.agg(self._in_order(F.col("__at"), value).alias("value")), value=F.col("value"))
            out = AGGREGATES[name](value, distinct)
            return Frame(frame.df.agg(out.alias("value")), value=F.col("value"))
        fn = self.schema.functions.get(name)
        if fn is not None:
            inner = {p: (a, env) for p, a in zip(fn.params, node.args, strict=True)}
            return self.rows(parse(fn.body), inner)
        frame, value = self.ranged(node, env, scalar=True)
        return replace(frame, value=value, type=None)

    @staticmethod
    def _in_order(at: Column, value: Column) -> Column:
        """The values by rank; those of one rank by themselves, so that ties come out the same in every run."""
        return F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), value.alias("v")))), lambda s: s["v"])

    def ranged(self, node: A.Node, env: dict, scalar: bool = False) -> tuple[Frame, Column]:
        """A frame over the first set that an expression names, and the expression's value on it."""
        if not scalar and self._is_set(node, env):
            frame = self.rows(node, env)
            if frame.mods.limit is not None or frame.mods.offset is not None:
                frame = replace(frame, df=self._cut(frame), mods=A.Mods())
            return frame, frame.value if frame.type is None else frame.key
        found: list[A.Node] = []

        def look(n) -> None:
            if found or not isinstance(n, A.Node) or isinstance(n, A.Call) and n.name in AGGREGATES:
                return  # an aggregate's set is its own
            if not isinstance(n, A.Call) and self._is_set(n, env):
                found.append(n)
                return
            for v in vars(n).values():
                for x in v if isinstance(v, tuple) else (v,):
                    look(x[1] if isinstance(x, tuple) and len(x) == 2 else x)

        look(node)
        if found:
            frame = self.rows(found[0], env)
            value = frame.value if frame.type is None else frame.key
            return frame, self.scalar(node, frame, {**env, "__node__": (found[0], value)})
        frame = Frame(self.spark.range(1).select(F.lit(0).alias("__one")), env=env)
        return frame, self.scalar(node, frame, env)

    def asserted(self, node: A.Call, env: dict) -> Frame:
        frame = self.rows(node.args[0], env)
        named = dict(node.named)
        text = named["message"].value if "message" in named else {"assert_exists": "expected at least one element", "assert_single": "expected at most one element", "assert_distinct": "expected distinct elements"}[node.name]
        value = frame.value if frame.type is None else frame.key
        n, d = F.count(F.lit(1)), F.count_distinct(value)
        wrong = {"assert_exists": n == 0, "assert_single": n > 1, "assert_distinct": n > d}[node.name]
        test = frame.df.agg(F.when(wrong, F.raise_error(F.lit(text)).cast("boolean")).otherwise(True).alias("__ok"))
        if node.name == "assert_exists":
            df = F.broadcast(test).join(frame.df, F.lit(True), "left").where("__ok")
        else:
            df = frame.df.crossJoin(F.broadcast(test)).where("__ok")
        return replace(frame, df=df.drop("__ok"))

    # --- filter, order, limit

    def modified(self, frame: Frame, mods: A.Mods, env: dict, alias: str | None = None) -> Frame:
        if alias:
            env = {**env, alias: (A.Dot(), env)}
            if frame.type is None:
                env["__node__"] = (A.Name(alias), frame.value)
        if frame.mods.limit is not None or frame.mods.offset is not None:
            frame = replace(frame, df=self._cut(frame), mods=A.Mods())
        if mods.filter is not None:
            if frame.keys is not None:
                # a condition on group results is one on the shape's columns
                return replace(frame, mods=mods, env=env)
            frame = self.filtered(frame, mods.filter, env)
        new = A.Mods(None, mods.order or frame.mods.order, mods.offset, mods.limit)
        return replace(frame, mods=new, env={**(frame.env or {}), **env})

    def filtered(self, frame: Frame, cond: A.Node, env: dict) -> Frame:
        if isinstance(cond, A.Binary) and cond.op == "and":
            return self.filtered(self.filtered(frame, cond.left, env), cond.right, env)
        semi = self.quantified(frame, cond, env)
        if semi is not None:
            return semi
        c = self.scalar(cond, frame, env)
        return replace(frame, df=frame.df.where(c))

    def quantified(self, frame: Frame, cond: A.Node, env: dict) -> Frame | None:
        """The frame under a condition that is a semi or anti join, if it is."""
        negated = False
        while isinstance(cond, A.Unary) and cond.op == "not":
            cond, negated = cond.arg, not negated
        how = "left_anti" if negated else "left_semi"
        if isinstance(cond, A.Unary) and cond.op == "exists" or isinstance(cond, A.Call) and cond.name in ("any", "all"):
            arg = cond.arg if isinstance(cond, A.Unary) else cond.args[0]
            found = self.correlated(frame, arg, env)
            if found is None:
                return None
            child, parent, value = found
            df = child.df
            if isinstance(cond, A.Call):
                if cond.name == "all":
                    df, how = df.where(~F.coalesce(value, F.lit(False))), "left_semi" if negated else "left_anti"
                else:
                    df = df.where(value)
            ids = df.select(parent.alias("__of")).distinct()
            return replace(frame, df=frame.df.join(ids, frame.key == F.col("__of"), how))
        if isinstance(cond, A.Binary) and cond.op in ("in", "=") and self._is_set(cond.right, env) and not isinstance(cond.right, A.SetOf):
            other = self.rows(cond.right, env)
            if other.mods.limit is not None or other.mods.offset is not None:
                other = replace(other, df=self._cut(other), mods=A.Mods())
            value = other.value if other.type is None else other.key
            ids = other.df.select(value.alias("__in")).where("__in IS NOT NULL").distinct()
            left = self.scalar(cond.left, frame, env)
            return replace(frame, df=frame.df.join(ids, left == F.col("__in"), how))
        if isinstance(cond, A.Binary) and cond.op in ("=", "!=", "<", "<=", ">", ">=", "in", "like", "ilike"):
            found = self.correlated(frame, cond, env)  # a set on one side: any element may fit
            if found is not None:
                child, parent, value = found
                ids = child.df.where(value).select(parent.alias("__of")).distinct()
                return replace(frame, df=frame.df.join(ids, frame.key == F.col("__of"), how))
        return None

    def correlated(self, frame: Frame, node: A.Node, env: dict) -> tuple[Frame, Column, Column] | None:
        """The first set-valued path from the frame's object in an expression: its frame, its column with the
        object's key, and the expression's value there. None if there is no such path outside of aggregates."""
        if frame.type is None:
            return None
        hit: list[A.Node] = []

        def look(n) -> None:
            if hit or not isinstance(n, A.Node):
                return
            if isinstance(n, A.Call) and (n.name in AGGREGATES or n.name in ("any", "all")):
                return
            if isinstance(n, A.Step | A.Select | A.Shaped) and self._set_path(frame.type, n, env):
                hit.append(n)
                return
            for v in vars(n).values():
                for x in v if isinstance(v, tuple) else (v,):
                    look(x[1] if isinstance(x, tuple) and len(x) == 2 else x)

        look(node)
        if not hit:
            return None
        child, parent = self.walk(frame, hit[0], env)
        value = child.value if child.type is None else child.key
        whole = value if hit[0] is node else self.scalar(node, child, {**env, "__node__": (hit[0], value)})
        return child, parent, whole

    def _set_path(self, kind: ObjectType, node: A.Node, env: dict) -> bool:
        """Whether a path from an object of the type goes over a back link or a bridge link."""
        if isinstance(node, A.Select):
            return self._set_path(kind, node.source, env)
        if isinstance(node, A.Shaped):
            return self._set_path(kind, node.base, env)
        steps = []
        while isinstance(node, A.Step):
            steps.append(node)
            node = node.base
        if isinstance(node, A.Select):
            return self._set_path(kind, node, env)
        if not isinstance(node, A.Dot):
            return False
        for s in reversed(steps):
            if s.kind == "back":
                return True
            if s.kind == "forward" and s.name in kind.links:
                if kind.links[s.name].many:
                    return True
                kind = self.schema.types[kind.links[s.name].target]
            elif s.kind == "forward" and s.name in kind.computed:
                if self._set_path(kind, parse(kind.computed[s.name]), env):
                    return True
                return False
        return False

    def _single(self, kind: ObjectType, node: A.Node) -> bool:
        """Whether a set-valued path has one element at most: it is limited to one, or starts at a computed link that is."""
        if isinstance(node, A.Select):
            return node.mods.limit == A.Lit(1, "int64")
        if isinstance(node, A.Shaped):
            return self._single(kind, node.base)
        steps = self._steps(node)
        if not steps or steps[0].name not in kind.computed or not self._single(kind, parse(kind.computed[steps[0].name])):
            return False
        return all(s.kind == "forward" for s in steps[1:])

    def walk(self, frame: Frame, node: A.Node, env: dict) -> tuple[Frame, Column]:
        """A set-valued path from the frame's object: a frame of its own and its column with that object's key."""
        if isinstance(node, A.Select):
            child, parent = self.walk(frame, node.source, env)
            child = self.modified(child, node.mods, env)
            if child.mods.limit is not None or child.mods.offset is not None:
                child = self.cut_within(child, parent, env)
            return child, parent
        if isinstance(node, A.Shaped):
            child, parent = self.walk(frame, node.base, env)
            return replace(child, elements=node.elements), parent
        if isinstance(node, A.Step) and isinstance(node.base, A.Dot) and node.name in frame.type.computed and node.kind == "forward":
            return self.walk(frame, parse(frame.type.computed[node.name]), env)
        base = node.base
        only = None
        if node.kind == "is" and isinstance(base, A.Step) and base.kind == "back":
            only, node, base = node.name, base, base.base
        if not self._set_path(frame.type, base, env):
            # single links first, from a fresh scan of the object, so that its key stays in reach
            start = self.scan(frame.type.name)
            if isinstance(base, A.Dot):
                return self.dependent(start, node, only)
            inner = start
            for s in self._steps(base):
                inner = self.follow(inner, s.name)
            child, parent = self.dependent(inner, node, only)
            df = inner.df.join(child.df, inner.key == parent)
            return replace(child, df=df, joined={**inner.joined, **child.joined}), start.key
        child, parent = self.walk(frame, base, env)
        if only is not None:
            grand, up = self.dependent(child, node, only)
            return replace(grand, df=child.df.join(grand.df, child.key == up)), parent
        return self.step(child, node), parent

    @staticmethod
    def _steps(node: A.Node) -> list[A.Step]:
        out = []
        while isinstance(node, A.Step):
            out.append(node)
            node = node.base
        return out[::-1]

    def _order(self, frame: Frame, env: dict, names: set[str] = frozenset()) -> list[Column]:
        out = []
        for e, down, first in frame.mods.order:
            if isinstance(e, A.Step) and isinstance(e.base, A.Dot) and e.name in names:
                c = F.col(f"`{e.name}`")
            else:
                c = self.scalar(e, frame, frame.env or env)
            out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        return out

    def number(self, node: A.Node) -> int:
        if isinstance(node, A.Lit):
            return int(node.value)
        if isinstance(node, A.Param):
            return int(self.param(node.name))
        return int(self.spark.range(1).select(self.scalar(node, Frame(self.spark.range(1)), {})).first()[0])

    def _cut(self, frame: Frame) -> DataFrame:
        order = self._order(frame, frame.env or {})
        df = frame.df
        if order:
            df = df.orderBy(*order)
        if frame.mods.offset is not None:
            df = df.offset(self.number(frame.mods.offset))
        if frame.mods.limit is not None:
            df = df.limit(self.number(frame.mods.limit))
        return df

    def cut_within(self, frame: Frame, parent: Column, env: dict) -> Frame:
        order = self._order(frame, env) or [(frame.key if frame.type else frame.value).asc()]
        n = self.fresh("n")
        lo = self.number(frame.mods.offset) if frame.mods.offset is not None else 0
        df = frame.df.withColumn(n, F.row_number().over(Window.partitionBy(parent).orderBy(*order)))
        if frame.mods.limit is not None:
            df = df.where(F.col(n) <= lo + self.number(frame.mods.limit))
        if lo:
            df = df.where(F.col(n) > lo)
        return replace(frame, df=df.drop(n), mods=replace(frame.mods, limit=None, offset=None))

    # --- groups and loops

    def grouped(self, node: A.Group, env: dict) -> Frame:
        base = self.rows(node.source, env)
        using = dict(node.using)
        keys = {}
        for name in node.by:
            keys[name] = self.scalar(using[name], base, env) if name in using else self.scalar(A.Step(A.Dot(), name), base, env)
        return replace(base, keys=keys, keys_of=node.by, env=env)

    def loop(self, node: A.For, env: dict) -> Frame:
        if isinstance(node.source, A.Group):
            body = node.body
            if isinstance(body, A.Select) and isinstance(self._root(body.source), A.Name) and self._root(body.source).name == node.name:
                group = self.grouped(node.source, env)
                base = replace(group, keys=None, keys_of=(), elements=body.source.elements if isinstance(body.source, A.Shaped) else group.elements, mods=body.mods, env=env)
                if body.mods.filter is not None:
                    base = self.filtered(base, body.mods.filter, env)
                if body.mods.limit is None and body.mods.offset is None:
                    return replace(base, mods=A.Mods())
                n = self.fresh("n")
                order = self._order(base, env) or [base.key.asc()]
                lo = self.number(body.mods.offset) if body.mods.offset is not None else 0
                df = base.df.withColumn(n, F.row_number().over(Window.partitionBy(*group.keys.values()).orderBy(*order)))
                df = df.where(F.col(n) > lo) if lo else df
                df = df.where(F.col(n) <= lo + self.number(body.mods.limit)) if body.mods.limit is not None else df
                return replace(base, df=df.drop(n), mods=A.Mods())
            shape = body.source if isinstance(body, A.Select) else body
            if isinstance(shape, A.Shaped) and isinstance(shape.base, A.SetOf):
                here = _renamed(shape.elements, node.name)
                return replace(self.grouped(node.source, env), elements=here, mods=body.mods if isinstance(body, A.Select) else A.Mods(), env=env)
            raise QueryError("the body of a loop over groups selects from the group's elements, or is a free object")
        if isinstance(node.body, A.Insert | A.Update | A.Delete):
            return self.written(node)
        return self._looped(self.rows(node.source, env), node, env)

    def _looped(self, source: Frame, node: A.For, env: dict) -> Frame:
        """The body of a loop for each row of `source`."""
        name = self.fresh("x")
        if source.type is None:
            source = Frame(source.df.withColumn(name, source.value).drop("value"), value=F.col(name))
        inner = {**env, node.name: (source, env)}
        body = node.body
        if isinstance(body, A.For):
            one = source.value if source.type is None else replace(source, df=None)
            outer = {**env, node.name: (one, env)}
            if isinstance(body.source, A.Call) and body.source.name in stdlib.SET_RETURNING:
                args = [self.scalar(a, source, outer) for a in body.source.args]
                got = self.fresh("v")
                both = Frame(source.df.select("*", stdlib.SET_RETURNING[body.source.name](*args).alias(got)), value=F.col(got))
            else:
                second = self.rows(body.source, env)
                both = replace(second, df=second.df.crossJoin(source.df))
            inner = replace(both, df=both.df)
            return self._looped(inner, body, outer)
        if isinstance(body, A.Select) and self._is_set(body.source, env):
            target = self.rows(body.source, env)
            df = target.df.join(source.df, F.lit(True)) if not node.optional else source.df.join(target.df, F.lit(True), "left")
            inner[node.name] = (source.value if source.type is None else replace(source, df=None), env)
            return self.modified(replace(target, df=df, env=inner), body.mods, inner)
        inner[node.name] = (source.value if source.type is None else replace(source, df=None), env)
        if isinstance(body, A.Select):
            body = body.source
        if isinstance(body, A.SetOf):
            return self.values([replace(source, value=self.scalar(i, source, inner), type=None) for i in body.items])
        if isinstance(body, A.Shaped) and isinstance(body.base, A.SetOf):
            return replace(source, type=None, elements=body.elements, env=inner)
        return replace(source, value=self.scalar(body, source, inner), type=None)

    # --- scalars

    def param(self, name: str):
        if name not in self.params:
            raise QueryError(f"missing parameter ${name}")
        return self.params[name]

    def scalar(self, node: A.Node, frame: Frame, env: dict) -> Column:
        """The value of an expression for each row of the frame; joins that it needs are added to the frame."""
        known = env.get("__node__")
        if known is not None and known[0] is node or known is not None and known[0] == node and isinstance(node, A.Step | A.Name):
            return known[1]
        if isinstance(node, A.Lit):
            return stdlib.literal(node.value, node.type)
        if isinstance(node, A.Param):
            v = self.params.get(node.name) if node.optional else self.param(node.name)
            return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        if isinstance(node, A.Global):
            if node.name in self.globals:
                return F.lit(self.globals[node.name])
            if node.name in self.schema.globals:
                return self.scalar(parse(self.schema.globals[node.name]).source, frame, {})
            raise QueryError(f"unknown global '{node.name}'")
        if isinstance(node, A.Dot):
            return frame.value if frame.type is None else frame.key
        if isinstance(node, A.Name):
            return self.named(node, frame, env)
        if isinstance(node, A.Step):
            return self.path(node, frame, env)
        if isinstance(node, A.Unary):
            return self.unary(node, frame, env)
        if isinstance(node, A.Binary):
            return self.binary(node, frame, env)
        if isinstance(node, A.If):
            return F.when(self.scalar(node.cond, frame, env), self.scalar(node.then, frame, env)).otherwise(self.scalar(node.other, frame, env))
        if isinstance(node, A.Cast):
            return stdlib.cast(self.scalar(node.arg, frame, env), node.type, self.kind(frame))
        if isinstance(node, A.Is):
            names = [t.name for t in self.schema.concrete(node.type)] if node.type in self.schema.types else None
            if names is None:
                raise QueryError(f"unknown type '{node.type}'")
            target = frame if isinstance(node.arg, A.Dot) or isinstance(node.arg, A.Name) else self.object_at(node.arg, frame)
            c = target.col("__type__").isin(*names)
            return ~c if node.negated else c
        if isinstance(node, A.SetOf):
            if len(node.items) == 1:
                return self.scalar(node.items[0], frame, env)
            return F.lit(None) if not node.items else F.array(*[self.scalar(i, frame, env) for i in node.items])
        if isinstance(node, A.ArrayOf):
            return F.array(*[self.scalar(i, frame, env) for i in node.items])
        if isinstance(node, A.TupleOf):
            return F.struct(*[self.scalar(v, frame, env).alias(n) for n, v in node.items])
        if isinstance(node, A.Index):
            base = self.scalar(node.base, frame, env)
            at = None if node.at is None else self.scalar(node.at, frame, env)
            if node.slice:
                return stdlib.sliced(base, at, None if node.to is None else self.scalar(node.to, frame, env), self.kind(frame))
            return stdlib.indexed(base, at, self.kind(frame))
        if isinstance(node, A.Call):
            return self.call(node, frame, env)
        if isinstance(node, A.Select | A.With) and not self._depends(node):
            return self.constant(node, env, frame)
        if isinstance(node, A.Select):
            found = self.correlated(frame, node, env)
            if found is not None:
                return self.attached(frame, found, F.first)
        raise QueryError(f"{type(node).__name__.lower()} can't stand here")

    def _depends(self, node: A.Node) -> bool:
        return isinstance(self._root(node.source if isinstance(node, A.Select) else node), A.Dot)

    def constant(self, node: A.Node, env: dict, frame: Frame) -> Column:
        """A set that doesn't depend on the row, joined as one value."""
        rows = self.rows(node, env)
        rows = replace(rows, df=self._cut(rows)) if rows.mods.limit is not None else rows
        value = rows.value if rows.type is None else rows.key
        name = self.fresh("c")
        one = rows.df.select(value.alias(name)).agg(F.first(name, ignorenulls=True).alias(name))
        frame.df = frame.df.crossJoin(F.broadcast(one))
        return F.col(name)

    def kind(self, frame: Frame):
        """What type a column has on the frame."""
        return lambda c: frame.df.select(c.alias("x")).schema["x"].dataType

    def named(self, node: A.Name, frame: Frame, env: dict) -> Column:
        if node.name in env:
            bound, own = env[node.name]
            if isinstance(bound, Column):
                return bound
            if isinstance(bound, Frame):
                return bound.value if bound.type is None else bound.key
            if isinstance(bound, A.Dot):
                return frame.value if frame.type is None else frame.key
            if isinstance(bound, A.SetOf) and len(bound.items) != 1:
                raise QueryError(f"'{node.name}' is a set of several values; select from it, or test with 'in'")
            if self._is_set(bound, own) or isinstance(bound, A.Select):
                return self.constant(bound, own, frame)
            return self.scalar(bound, frame, own)
        parts = node.name.split("::")
        raise QueryError(f"unknown name '{node.name}'") if len(parts) == 1 else QueryError(f"unknown enum or name '{node.name}'")

    def object_at(self, node: A.Node, frame: Frame) -> Frame:
        for s in self._steps(node):
            if s.kind == "is":
                continue
            frame = self.follow(frame, s.name)
        return frame

    def path(self, node: A.Step, frame: Frame, env: dict) -> Column:
        steps = self._steps(node)
        root = self._root(node)
        if isinstance(root, A.Name):
            if root.name in self.schema.enums and len(steps) == 1:
                if steps[0].name not in self.schema.enums[root.name]:
                    raise QueryError(f"enum '{root.name}' has no member '{steps[0].name}'")
                return F.lit(steps[0].name)
            if root.name in env:
                bound, own = env[root.name]
                if isinstance(bound, Column):
                    for s in steps:
                        bound = bound.getField(s.name)
                    return bound
                if isinstance(bound, A.Dot):
                    return self.path(self._rebased(steps, A.Dot()), frame, env)
                if isinstance(bound, Frame):
                    inner = replace(bound, df=frame.df, joined=frame.joined)
                    if bound.type is None:
                        out = bound.value
                        for s in steps:
                            out = out.getField(s.name)
                        return out
                    out = self.path(self._rebased(steps, A.Dot()), inner, env)
                    frame.df = inner.df
                    return out
            if root.name not in env and root.name not in self.schema.types:
                raise QueryError(f"unknown name '{root.name}'")
            return self.constant(node, env, frame)
        if isinstance(root, A.Select) and not self._depends(root):
            return self.constant(node, env, frame)
        if not isinstance(root, A.Dot):
            out = self.scalar(root, frame, env)
            for s in steps:
                out = out.getField(s.name)
            return out
        if frame.keys is not None and steps[0].name == "key":
            if len(steps) == 1:
                return F.struct(*[c.alias(k) for k, c in frame.keys.items()])
            if steps[1].name not in frame.keys:
                raise QueryError(f"the group has no key '{steps[1].name}'")
            return frame.keys[steps[1].name]
        if frame.keys is not None and steps[0].name == "elements":
            return self.path(self._rebased(steps[1:], A.Dot()), frame, env) if len(steps) > 1 else frame.key
        if frame.type is None:
            out = frame.value
            for s in steps:
                out = out.getField(s.name)
            return out
        here = frame
        for k, s in enumerate(steps):
            kind = here.type
            if s.kind == "property":
                prefix, props = here.link or (None, {})
                if s.name not in props:
                    raise QueryError(f"there is no link property '@{s.name}' here")
                return F.col(prefix + s.name)
            if s.kind == "is":
                names = [t.name for t in self.schema.concrete(s.name)]
                nxt = steps[k + 1]
                own = f"{here.prefix}{s.name}.{nxt.name}"
                c = F.col(f"`{own}`") if own in here.df.columns else here.col(nxt.name)
                return F.when(here.col("__type__").isin(*names), c)
            if s.kind == "back" or s.name in kind.links and kind.links[s.name].many:
                return self.attached(frame, self.correlated(frame, node, env), F.collect_list)
            if s.name in kind.computed and here is frame and self._set_path(kind, A.Step(A.Dot(), s.name), env):
                return self.attached(frame, self.correlated(frame, node, env), F.first if self._single(kind, node) else F.collect_list)
            if s.name in kind.links:
                if k == len(steps) - 1:
                    out = here.col(f"{s.name}__fk")
                    break
                up = self.follow(here, s.name)
                frame.df = here.df = up.df = here.df
                here = up
                continue
            out = self.member(here, s.name, env)
            if here is not frame:
                frame.df = here.df
            for rest in steps[k + 1 :]:
                out = out.getField(rest.name)
            break
        else:
            out = here.key
        return out

    @staticmethod
    def _rebased(steps: list[A.Step], root: A.Node) -> A.Node:
        for s in steps:
            root = A.Step(root, s.name, s.kind)
        return root

    def member(self, frame: Frame, name: str, env: dict) -> Column:
        kind = frame.type
        if name in kind.properties:
            return frame.col(name)
        if name == "id":
            return frame.key
        if name == "__type__":
            return frame.col("__type__")
        if name in kind.computed:
            return self.scalar(parse(kind.computed[name]).source, frame, {})
        for e in frame.elements or ():
            if e.name == name and e.value is not None:
                return self.scalar(e.value, frame, frame.env or env)
        known = ", ".join(sorted([*kind.properties, *kind.links, *kind.computed]))
        raise QueryError(f"'{kind.name}' has no link or property '{name}' (it has {known})")

    def attached(self, frame: Frame, found: tuple[Frame, Column, Column], how, in_order: bool = False) -> Column:
        """An aggregate of a dependent set, joined to the frame by the object's key."""
        child, parent, value = found
        of, out = self.fresh("k"), self.fresh("a")
        order = tuple(self._order(child, {})) or child.order
        if in_order and order:
            at = self.fresh("n")
            child = replace(child, df=child.df.withColumn(at, F.rank().over(Window.partitionBy(parent).orderBy(*order))))
            how = lambda c: self._in_order(F.col(at), c)
        per = child.df.groupBy(parent.alias(of)).agg(how(value).alias(out))
        frame.df = frame.df.join(per, frame.key == F.col(of), "left")
        return F.col(out)

    def unary(self, node: A.Unary, frame: Frame, env: dict) -> Column:
        if node.op == "not":
            return ~self.scalar(node.arg, frame, env)
        if node.op == "-":
            return -self.scalar(node.arg, frame, env)
        if node.op == "exists":
            found = self.correlated(frame, node.arg, env)
            if found is not None:
                return F.coalesce(self.attached(frame, found, lambda c: F.count(c) > 0), F.lit(False))
            if self._is_set(node.arg, env):
                return F.coalesce(self.constant(A.Select(A.Call("count", (node.arg,))), env, frame) > 0, F.lit(False))
            return self.scalar(node.arg, frame, env).isNotNull()
        if node.op == "detached" and self._is_set(node.arg, {}):
            return self.constant(node.arg, {}, frame)
        return self.scalar(node.arg, frame, {} if node.op == "detached" else env)

    def binary(self, node: A.Binary, frame: Frame, env: dict) -> Column:
        op = node.op
        if op in ("in", "=", "!=") and isinstance(node.right, A.SetOf) and len(node.right.items) != 1 and op == "in":
            return self.scalar(node.left, frame, env).isin(*[self.scalar(i, frame, env) for i in node.right.items])
        if op == "in":
            if self._is_set(node.right, env) and not isinstance(node.right, A.SetOf):
                rows = self.rows(node.right, env)
                name = self.fresh("c")
                value = rows.value if rows.type is None else rows.key
                left = self.scalar(node.left, frame, env)
                frame.df = frame.df.join(rows.df.select(value.alias(name)).distinct(), left == F.col(name), "left")
                return F.col(name).isNotNull()
            right = self.scalar(node.right, frame, env)
            return self.scalar(node.left, frame, env) == right
        a, b = self.scalar(node.left, frame, env), self.scalar(node.right, frame, env)
        return stdlib.operator(op, a, b, self.kind(frame))

    def call(self, node: A.Call, frame: Frame, env: dict) -> Column:
        name = node.name
        if name in AGGREGATES and len(node.args) == 1:
            arg, distinct = node.args[0], False
            if isinstance(arg, A.Unary) and arg.op == "distinct":
                arg, distinct = arg.arg, True
            if frame.keys is not None:
                if isinstance(arg, A.Select):
                    cond = self.scalar(arg.mods.filter, frame, env)
                    return AGGREGATES[name](F.when(cond, self.scalar(arg.source, frame, env)), distinct)
                return AGGREGATES[name](self.scalar(arg, frame, env), distinct)
            found = self.correlated(frame, arg, env)
            if found is not None:
                out = self.attached(frame, found, lambda c: AGGREGATES[name](c, distinct), in_order=name == "array_agg" and not distinct)
                return stdlib.of_nothing(name, out)
            if self._is_set(arg, env):
                return self.constant(A.Select(node), env, frame)
            if self._names_set(arg, env):
                inner, value = self.ranged(arg, env)
                out = self.fresh("c")
                frame.df = frame.df.crossJoin(F.broadcast(inner.df.agg(AGGREGATES[name](value, distinct).alias(out))))
                return F.col(out)
        fn = self.schema.functions.get(name)
        if fn is not None:
            if len(fn.params) != len(node.args):
                raise QueryError(f"function '{name}' takes {len(fn.params)} arguments, {len(node.args)} given")
            inner = {p: (self.scalar(a, frame, env), env) for p, a in zip(fn.params, node.args, strict=True)}
            body = parse(fn.body)
            return self.scalar(body.source if isinstance(body, A.Select) and body.mods == A.Mods() else body, frame, inner)
        if name in ("sequence_next", "sequence_reset"):
            return self.sequence(node, frame)
        args = [self.scalar(a, frame, env) for a in node.args]
        if name in stdlib.SET_RETURNING:
            if frame.type is not None:
                return stdlib.AS_ARRAY[name](*args)
            out = self.fresh("v")
            frame.df = frame.df.select("*", stdlib.SET_RETURNING[name](*args).alias(out))
            return F.col(out)
        named = {k: self.scalar(v, frame, env) for k, v in node.named}
        return stdlib.call(name, args, named, self.kind(frame))

    def sequence(self, node: A.Call, frame: Frame) -> Column:
        """Numbers of a sequence that the engine counts; a block for each statement, in no order."""
        name = node.args[0].name if isinstance(node.args[0], A.Name) else str(node.args[0].value)
        if self.engine is None:
            raise QueryError("sequences belong to an engine")
        if node.name == "sequence_reset":
            self.engine.sequences[name] = int(node.args[1].value) if len(node.args) > 1 else 0
            return F.lit(self.engine.sequences[name]).cast("bigint")
        start, n = self.engine.sequences.get(name, 0), frame.df.count()
        self.engine.sequences[name] = start + n
        return F.lit(start + 1).cast("bigint") if n == 1 else F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("bigint") + start

    def written(self, node: A.Node) -> Frame:
        """The rows that a statement writes, or takes away, as a set."""
        if self.engine is None:
            raise QueryError("a statement that writes can't stand here")
        from ..operators.mutate import mutate

        target = node.body if isinstance(node, A.For) else node
        before = self.scan(target.type) if isinstance(target, A.Delete) else None
        ids = mutate(self.engine, node, self.params).select(F.col("id").alias("__done"))
        frame = before or self.scan(target.type)
        return replace(frame, df=frame.df.join(ids, frame.key == F.col("__done"), "left_semi"))

    # --- results

    def finished(self, frame: Frame, env: dict) -> DataFrame:
        """The result of a query: the columns of its shape, or id, or value, in the order that the query asks for."""
        env = frame.env if frame.env is not None else env
        if frame.keys is not None:
            return self.grouped_result(frame, env)
        if frame.elements is None:
            df = self._cut(frame) if frame.mods != A.Mods() else frame.df
            value, name = (frame.value, "value") if frame.type is None else (frame.key, "id")
            out = df.select(value.alias(name))
            return out.where(F.col(name).isNotNull()) if frame.type is None else out
        cols = self.shape(frame, frame.elements, env)
        order = self._order(frame, env)
        df = frame.df
        if order:
            df = df.orderBy(*order)
        if frame.mods.offset is not None:
            df = df.offset(self.number(frame.mods.offset))
        if frame.mods.limit is not None:
            df = df.limit(self.number(frame.mods.limit))
        return df.select(*[c.alias(n) for n, c in cols])

    def grouped_result(self, frame: Frame, env: dict) -> DataFrame:
        keys = [c.alias(f"__k_{n}") for n, c in frame.keys.items()]
        if frame.elements is None or not any(isinstance(e.value, A.Node) for e in frame.elements):
            inner = self.shape(frame, frame.elements, env) if frame.elements else [("id", frame.key)]
            keys = [c.alias(f"__k_{n}") for n, c in frame.keys.items()]
            df = frame.df.groupBy(*keys).agg(F.collect_list(F.struct(*[c.alias(n) for n, c in inner])).alias("elements"))
            return df.select(F.struct(*[F.col(f"__k_{n}").alias(n) for n in frame.keys]).alias("key"), F.array(*[F.lit(n) for n in frame.keys_of]).alias("grouping"), "elements")
        plain, aggs = {}, {}
        for e in frame.elements:
            v = e.value
            steps = self._steps(v) if isinstance(v, A.Step) else []
            if steps and isinstance(self._root(v), A.Dot) and steps[0].name == "key" and len(steps) == 2:
                if steps[1].name not in frame.keys:
                    raise QueryError(f"the group has no key '{steps[1].name}'")
                plain[e.name] = f"__k_{steps[1].name}"
            else:
                if isinstance(v, A.Shaped) and isinstance(v.base, A.Step) and v.base.name == "elements":
                    aggs[e.name] = F.collect_list(F.struct(*[c.alias(n) for n, c in self.shape(frame, v.elements, env)]))
                    continue
                aggs[e.name] = self.scalar(v, frame, env)
        df = frame.df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]) if aggs else frame.df.select(*keys).distinct()
        df = df.select(*[F.col(plain[e.name]).alias(e.name) if e.name in plain else F.col(f"`{e.name}`") for e in frame.elements])
        result = Frame(df, value=F.struct(*[F.col(f"`{c}`") for c in df.columns]), mods=replace(frame.mods, filter=None))
        if frame.mods.filter is not None:
            result = replace(result, df=df.where(self.scalar(frame.mods.filter, result, env)))
        return self._cut(replace(result, env=env))

    def shape(self, frame: Frame, elements: tuple[A.Element, ...], env: dict) -> list[tuple[str, Column]]:
        out: list[tuple[str, Column]] = []
        for e in elements:
            if e.kind == "splat":
                names = list(self.schema.types[e.only].properties) if e.only else ["id", *frame.type.properties]
                out += [(n, self.path(A.Step(A.Step(A.Dot(), e.only, "is"), n), frame, env) if e.only else self.member(frame, n, env)) for n in names]
                if e.name == "**":
                    out += [(n, F.struct(frame.col(f"{n}__fk").alias("id"))) for n, k in frame.type.links.items() if k.column]
                continue
            if e.only:
                out.append((e.name, self.path(A.Step(A.Step(A.Dot(), e.only, "is"), e.name), frame, env)))
                continue
            if e.kind == "property":
                prefix, props = frame.link or (None, {})
                if e.name not in props:
                    raise QueryError(f"there is no link property '@{e.name}' here")
                out.append((e.name, F.col(prefix + e.name)))
                continue
            out.append((e.name, self.element(frame, e, env)))
        return out

    def element(self, frame: Frame, e: A.Element, env: dict) -> Column:
        kind = frame.type
        node = e.value if e.value is not None else A.Step(A.Dot(), e.name)
        if isinstance(node, A.Call) and node.name in ("assert_exists", "assert_single", "assert_distinct") and kind is not None:
            return self.asserted_element(frame, e, node, env)
        single = kind is not None and isinstance(node, A.Step | A.Select | A.Shaped) and self._single(kind, node)
        if e.mods is not None and e.mods != A.Mods():
            node = A.Select(A.Shaped(node, e.shape) if e.shape else node, e.mods)
        elif e.shape:
            node = A.Shaped(node, e.shape)
        if kind is not None and isinstance(node, A.Step | A.Select | A.Shaped) and self._set_path(kind, node, env):
            return self.nested(frame, node, env, single)
        if isinstance(node, A.Shaped) and isinstance(node.base, A.Step) and kind is not None:
            target = self.object_at(node.base, frame)
            frame.df = target.df
            inner = self.shape(target, node.elements, env)
            frame.df = target.df
            return F.when(target.key.isNotNull(), F.struct(*[c.alias(n) for n, c in inner]))
        if kind is not None and e.value is None and e.name in kind.links:
            return F.when(frame.col(f"{e.name}__fk").isNotNull(), F.struct(frame.col(f"{e.name}__fk").alias("id")))
        if isinstance(node, A.Select) and node.mods == A.Mods():
            node = node.source
        return self.scalar(node, frame, env)

    def asserted_element(self, frame: Frame, e: A.Element, node: A.Call, env: dict) -> Column:
        """A pointer of which each object must have what is asserted."""
        value = self.element(frame, replace(e, value=node.args[0]), env)
        named = dict(node.named)
        text = named["message"].value if "message" in named else f"'{e.name}' doesn't hold what '{node.name}' asserts"
        many = isinstance(frame.df.select(value.alias("x")).schema["x"].dataType, T.ArrayType)
        if node.name == "assert_exists":
            wrong = F.size(value) == 0 if many else value.isNull()
        else:
            wrong = (F.size(value) > 1 if node.name == "assert_single" else F.size(value) > F.size(F.array_distinct(value))) if many else F.lit(False)
        out = F.get(value, F.lit(0)) if many and node.name == "assert_single" else value
        return F.when(wrong, F.raise_error(F.lit(text))).otherwise(out)

    def nested(self, frame: Frame, node: A.Node, env: dict, single: bool) -> Column:
        """A dependent set as an array in the order that it asks for, empty where there is none. Only a pointer that is
        single by what it is, and not by a limit on its elements, is one value."""
        child, parent = self.walk(frame, node, env)
        if child.elements is not None:
            value = F.struct(*[c.alias(n) for n, c in self.shape(child, child.elements, env)])
        else:
            value = child.value if child.type is None else F.struct(child.key.alias("id"))
        order = self._order(child, env)
        of, at, out = self.fresh("k"), self.fresh("n"), self.fresh("a")
        df = child.df
        if order:
            df = df.withColumn(at, F.row_number().over(Window.partitionBy(parent).orderBy(*order)))
            got = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), value.alias("v")))), lambda s: s["v"])
        else:
            got = F.collect_list(value)
        per = df.groupBy(parent.alias(of)).agg((F.element_at(got, 1) if single else got).alias(out))
        frame.df = frame.df.join(per, frame.key == F.col(of), "left")
        return F.col(out) if single else F.coalesce(F.col(out), F.array())

