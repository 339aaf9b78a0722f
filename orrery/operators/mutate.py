"""Insert, update and delete as new versions of immutable tables.

A statement reads the versions that it finds and registers new ones with the engine when it is done; no table is
changed in place. Rows that a statement makes are fixed at once, as Parquet in the shared folder, so that a later
reading gives the same. Loops, nested inserts and multi links are sets: nothing is done row by row.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ast as A
from ..plans.compile import Compiler, Frame
from ..plans.lexer import QueryError
from ..plans.parser import parse


def frozen(df: DataFrame) -> DataFrame:
    """`df` written once and read from then on."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[[^\]]*\])?\Z", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-versions-"))
        path = spark.sparkContext.getCheckpointDir()
    at = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _column(kind, name: str) -> str:
    if name in kind.properties:
        return kind.properties[name]
    if name in kind.links and kind.links[name].column:
        return kind.links[name].column
    if name == "id":
        return kind.key
    raise QueryError(f"'{kind.name}' has no property or single link '{name}'")


def _many(kind, name: str) -> bool:
    return name in kind.links and kind.links[name].many


def mutate(engine, node: A.Node, params: dict) -> DataFrame:
    """Runs a statement; the ids of the objects that it wrote or took away."""
    compiler = engine.compiler(params)
    env: dict = {}
    source = Frame(engine.spark.range(1).select(F.lit(0).alias("__one")))
    if isinstance(node, A.For):
        found = compiler.rows(node.source, {})
        if found.type is None:
            found = Frame(found.df.select(found.value.alias("__item")), value=F.col("__item"))
        source, env, node = found, {node.name: (found.value if found.type is None else replace(found, df=None), {})}, node.body
    if node.type not in engine.schema.types:
        raise QueryError(f"unknown type '{node.type}'")
    kind = engine.schema.types[node.type]
    if kind.interface and not isinstance(node, A.Insert):
        parts = [mutate(engine, type(node)(t.name, *[getattr(node, f) for f in list(vars(node))[1:]]), params) for t in engine.schema.concrete(kind.name)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    with engine.transaction():
        if isinstance(node, A.Insert):
            return _insert(engine, compiler, kind, node, source, env).select("id")
        if env:
            raise QueryError("only inserts can be the body of a loop")
        return _update(engine, compiler, kind, node) if isinstance(node, A.Update) else _delete(engine, compiler, kind, node)


# --- insert


def _insert(engine, compiler: Compiler, kind, node: A.Insert, source: Frame, env: dict) -> DataFrame:
    """(id, __it): what was inserted for each row of the source."""
    table = engine.table(kind.table)
    if kind.key not in table.columns:
        raise QueryError(f"'{kind.name}' has a composed key and takes no inserts")
    if "__it" not in source.df.columns:
        at = F.lit(1).cast("bigint") if "__one" in source.df.columns else F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("bigint")
        source = replace(source, df=frozen(source.df.withColumn("__it", at)), joined={})
    frame = replace(source, joined=dict(source.joined))
    values = {name: value for name, op, value in node.values}
    missing = {n: parse(e).source for n, e in kind.defaults.items() if n not in values}
    cols, links = {}, {}
    for name, value in {**missing, **values}.items():
        if _many(kind, name):
            links[name] = value
            continue
        if isinstance(value, A.Insert):
            target = engine.schema.types[value.type]
            inner = _insert(engine, compiler, target, value, frame, env).select(F.col("id").alias(f"__in_{name}"), F.col("__it").alias(f"__at_{name}"))
            frame.df = frame.df.join(inner, frame.df["__it"] == F.col(f"__at_{name}"))
            cols[_column(kind, name)] = F.col(f"__in_{name}")
        elif isinstance(value, A.SetOf) and not value.items:
            cols[_column(kind, name)] = F.lit(None)
        else:
            cols[_column(kind, name)] = compiler.scalar(value, frame, env)
    if kind.key not in cols:
        cols[kind.key] = _new_keys(engine, kind, table, frame.df)
    new = frame.df.select("__it", *[(cols[c] if c in cols else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    new = frozen(_rewritten(compiler, kind, new, "insert"))
    if node.guarded:
        on = [kind.key] if node.conflict is None else [_column(kind, s.name) for s in ([v for _, v in node.conflict.items] if isinstance(node.conflict, A.TupleOf) else [node.conflict])]
        taken = table.select(*[F.col(c).alias(f"__on_{c}") for c in on])
        same = [F.col(c) == F.col(f"__on_{c}") for c in on]
        if node.otherwise is not None and new.join(taken, same, "left_semi").limit(1).count():
            return engine.run(node.otherwise, compiler.params).withColumn("__it", F.lit(1).cast("bigint"))
        new = new.join(taken, same, "left_anti")
        if node.conflict is not None:
            new = new.dropDuplicates(on)
    engine.store[kind.table] = table.unionByName(new.drop("__it"))
    _check(engine, compiler, kind, new.drop("__it"))
    ids = new.select(F.col(kind.key).alias("id"), "__it")
    for name, value in links.items():
        _write_links(engine, compiler, kind, name, ":=", value, ids.select(F.col("id").alias("__source"), "__it"), frame, env)
    _fire(engine, kind, "insert", "__new__", ids.select("id"))
    return ids


def _new_keys(engine, kind, table: DataFrame, rows: DataFrame):
    if table.schema[kind.key].dataType.simpleString() == "string":
        return F.uuid()
    if kind.table not in engine.next_key:  # one scan for each table, not one for each insert
        engine.next_key[kind.table] = table.agg(F.max(kind.key)).first()[0] or 0
    start = engine.next_key[kind.table]
    engine.next_key[kind.table] += rows.agg(F.max("__it")).first()[0] or 0
    return F.lit(start) + F.col("__it")


def _write_links(engine, compiler: Compiler, kind, name: str, op: str, value: A.Node, sources: DataFrame, frame: Frame | None, env: dict) -> None:
    """Replaces (:=), adds to (+=) or takes from (-=) a multi link of the objects (__source[, __it])."""
    link = kind.links[name]
    bridge = engine.table(link.through)
    own, other = link.source_column, link.target_column
    props = {}
    pairs = sources.select("__source").crossJoin(engine.spark.range(0).select(F.col("id").alias("__target")))
    if not (isinstance(value, A.SetOf) and not value.items):
        while isinstance(value, A.Shaped) or isinstance(value, A.Select) and isinstance(value.source, A.Shaped):
            shaped = value if isinstance(value, A.Shaped) else value.source
            props |= {e.name: e.value for e in shaped.elements if e.kind == "written"}
            value = shaped.base if isinstance(value, A.Shaped) else replace(value, source=shaped.base)
        if isinstance(value, A.Insert):
            at = frame if frame is not None else Frame(engine.spark.range(1).select(F.lit(0).alias("__one")))
            made = _insert(engine, compiler, engine.schema.types[value.type], value, at, env)
            pairs = sources.join(made.select(F.col("id").alias("__target"), "__it"), "__it") if "__it" in sources.columns else sources.crossJoin(made.select(F.col("id").alias("__target")))
        else:
            found = compiler.rows(value, {k: v for k, v in env.items() if not isinstance(v[0], Frame | type(F.lit(1)))})
            if found.mods.limit is not None or found.mods.offset is not None:
                found = replace(found, df=compiler._cut(found), mods=A.Mods())
            target = [compiler.scalar(v, found, env).alias(f"__p_{n}") for n, v in props.items()]
            if op == "-=":
                _take_links(engine, link, sources, found.df.select(found.key.alias("__target")))
                return
            pairs = sources.select("__source").crossJoin(found.df.select(found.key.alias("__target"), *target).dropDuplicates(["__target"]))
    cols = [F.col("__source").cast(bridge.schema[own].dataType).alias(own), F.col("__target").cast(bridge.schema[other].dataType).alias(other)]
    plain = {link.properties[n]: F.col(f"__p_{n}") for n in props}
    new = pairs.select(*cols, *[(plain[c] if c in plain else F.lit(None)).cast(bridge.schema[c].dataType).alias(c) for c in bridge.columns if c not in (own, other)])
    new = frozen(new)
    keys = new.select(F.col(own).alias("__a"), F.col(other).alias("__b"))
    both = (F.col(own) == F.col("__a")) & (F.col(other) == F.col("__b"))
    if op == "-=":
        engine.store[link.through] = bridge.join(keys, both, "left_anti")
        return
    if op == ":=":
        kept = bridge.join(sources.select(F.col("__source").alias("__a")).distinct(), F.col(own) == F.col("__a"), "left_anti")
    else:  # a pair that is there already gets the new properties
        kept = bridge.join(keys, both, "left_anti")
    engine.store[link.through] = kept.unionByName(new)


def _take_links(engine, link, sources: DataFrame, targets: DataFrame) -> None:
    """Takes away the links of the objects (__source) to the objects (__target). The bridge is joined to either set, as
    there may be far more pairs of them than links."""
    bridge = engine.table(link.through)
    own, other = link.source_column, link.target_column
    to = frozen(targets.select(F.col("__target").cast(bridge.schema[other].dataType).alias("__b")).distinct().withColumn("__to", F.lit(True)))
    by = sources.select(F.col("__source").cast(bridge.schema[own].dataType).alias("__a")).distinct().withColumn("__by", F.lit(True))
    marked = bridge.join(to, F.col(other) == F.col("__b"), "left").join(by, F.col(own) == F.col("__a"), "left")
    engine.store[link.through] = marked.where("__to IS NULL OR __by IS NULL").select(*bridge.columns)


# --- update, delete


def _update(engine, compiler: Compiler, kind, node: A.Update) -> DataFrame:
    table = engine.table(kind.table)
    frame = compiler.modified(compiler.scan(kind.name), node.mods, {})
    if frame.mods.limit is not None or frame.mods.offset is not None:
        frame = replace(frame, df=compiler._cut(frame), mods=A.Mods())
    new, links = {}, []
    for name, op, value in node.values:
        if _many(kind, name):
            links.append((name, op, value))
        elif op != ":=":
            raise QueryError(f"'{op}' is for multi links; '{name}' holds one value")
        elif any(c.kind == "readonly" and name in c.fields for c in kind.constraints):
            raise QueryError(f"'{kind.name}.{name}' is read-only")
        else:
            new[_column(kind, name)] = F.lit(None) if isinstance(value, A.SetOf) and not value.items else compiler.scalar(value, frame, {})
    found = frozen(frame.df.select(frame.key.alias("__id"), *[c.cast(table.schema[n].dataType).alias(f"__new_{n}") for n, c in new.items()]).withColumn("__hit", F.lit(True)))
    rewritten = any("update" in r.on for r in kind.rewrites)
    if new or rewritten:  # links alone leave the objects' own table as it is
        both = table.withColumn("__key", F.expr(kind.key)).join(found, F.col("__key") == F.col("__id"), "left")
        cols = [(F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) if c in new else F.col(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns]
        changed = both.select("__hit", *cols)
        if rewritten:
            hit = _rewritten(compiler, kind, changed.where("__hit"), "update")
            changed = changed.where("__hit IS NULL").unionByName(hit)
        engine.store[kind.table] = changed.drop("__hit")
    if new:
        _check(engine, compiler, kind, changed.where("__hit").drop("__hit"))
    ids = found.select(F.col("__id").alias("id"))
    for name, op, value in links:
        _write_links(engine, compiler, kind, name, op, value, ids.select(F.col("id").alias("__source")), None, {})
    _fire(engine, kind, "update", "__new__", ids)
    return ids


def _delete(engine, compiler: Compiler, kind, node: A.Delete) -> DataFrame:
    frame = compiler.modified(compiler.scan(kind.name), node.mods, {})
    if frame.mods.limit is not None or frame.mods.offset is not None:
        frame = replace(frame, df=compiler._cut(frame), mods=A.Mods())
    ids = frozen(frame.df.select(frame.key.alias("id")))
    _fire(engine, kind, "delete", "__old__", ids)
    _remove(engine, kind, ids, set())
    return ids


def _remove(engine, kind, ids: DataFrame, busy: set) -> None:
    """Takes objects away, and what the policies of their links and of links to them ask for."""
    gone = ids.select(F.col("id").alias("__gone"))
    table = engine.table(kind.table)
    rows = table.withColumn("__key", F.expr(kind.key))
    dying = rows.join(gone, F.col("__key") == F.col("__gone"), "left_semi")
    after = []
    for link in kind.links.values():
        if link.on_source_delete in ("delete_target", "delete_target_if_orphan"):
            if link.many:
                led = engine.table(link.through).join(gone, F.expr(link.source_column) == F.col("__gone"), "left_semi").select(F.expr(link.target_column).alias("id"))
            else:
                led = dying.select(F.expr(link.column).alias("id"))
            after.append((link, frozen(led.where("id IS NOT NULL").distinct())))
    reachable = {kind.name, *kind.bases}
    for source in engine.schema.types.values():
        for name, link in source.links.items():
            if link.target not in reachable or source.interface:
                continue
            if link.many:
                held = engine.table(link.through)
                if link.on_target_delete in ("restrict", "deferred_restrict") and held.join(gone, F.expr(link.target_column) == F.col("__gone"), "left_semi").limit(1).count():
                    raise QueryError(f"'{kind.name}' objects are still linked from '{source.name}.{name}'")
                if link.on_target_delete == "delete_source" and source.name not in busy:
                    up = held.join(gone, F.expr(link.target_column) == F.col("__gone"), "left_semi").select(F.expr(link.source_column).alias("id")).distinct()
                    _remove(engine, source, frozen(up), busy | {kind.name})
                if link.on_target_delete != "allow" or link.through not in {t.table for t in engine.schema.types.values()}:
                    engine.store[link.through] = engine.table(link.through).join(gone, F.expr(link.target_column) == F.col("__gone"), "left_anti")
                continue
            own = engine.table(source.table)
            held = own.join(gone, F.expr(link.column) == F.col("__gone"), "left_semi")
            if source.name == kind.name:
                held = held.withColumn("__key", F.expr(kind.key)).join(gone, F.col("__key") == F.col("__gone"), "left_anti")
            if link.on_target_delete in ("restrict", "deferred_restrict") and held.limit(1).count():
                raise QueryError(f"'{kind.name}' objects are still linked from '{source.name}.{name}'")
            if link.on_target_delete == "delete_source" and source.name not in busy:
                _remove(engine, source, frozen(held.select(F.expr(source.key).alias("id"))), busy | {kind.name})
            elif link.on_target_delete == "allow" and link.column in own.columns and link.column != source.key:
                hit = own.join(gone.withColumn("__hit", F.lit(True)).distinct(), F.col(link.column) == F.col("__gone"), "left")
                engine.store[source.table] = hit.withColumn(link.column, F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(link.column))).select(*own.columns)
    table = engine.table(kind.table)
    engine.store[kind.table] = table.withColumn("__key", F.expr(kind.key)).join(gone, F.col("__key") == F.col("__gone"), "left_anti").select(*table.columns)
    for link in kind.links.values():
        if link.many and link.through not in {t.table for t in engine.schema.types.values()}:
            engine.store[link.through] = engine.table(link.through).join(gone, F.expr(link.source_column) == F.col("__gone"), "left_anti")
    for link, led in after:
        if link.on_source_delete == "delete_target_if_orphan":
            held = engine.table(link.through).select(F.expr(link.target_column).alias("__held")) if link.many else engine.table(kind.table).select(F.expr(link.column).alias("__held"))
            led = frozen(led.join(held, F.col("id") == F.col("__held"), "left_anti"))
        _remove(engine, engine.schema.types[link.target], led, busy | {kind.name})


# --- rewrites, constraints, triggers


def _frame_of(compiler: Compiler, kind, rows: DataFrame) -> Frame:
    prefix = compiler.fresh("w")
    cols = [F.expr(kind.key).alias(f"{prefix}__key"), F.lit(kind.name).alias(f"{prefix}__type__")]
    cols += [F.expr(e).alias(prefix + p) for p, e in kind.properties.items()]
    cols += [F.expr(k.column).alias(f"{prefix}{n}__fk") for n, k in kind.links.items() if k.column]
    return Frame(rows.select("*", *cols), kind, prefix)


def _rewritten(compiler: Compiler, kind, rows: DataFrame, event: str) -> DataFrame:
    for r in kind.rewrites:
        if event in r.on:
            frame = _frame_of(compiler, kind, rows)
            c = _column(kind, r.field)
            value = compiler.scalar(parse(r.expression).source, frame, {}).cast(rows.schema[c].dataType)
            rows = frame.df.withColumn(c, value).select(*rows.columns)
    return rows


def _check(engine, compiler: Compiler, kind, changed: DataFrame) -> None:
    """Constraints of the type and of its interfaces, on the rows that a statement wrote."""
    held = [(kind, c) for c in kind.constraints] + [(engine.schema.types[b], c) for b in kind.bases for c in engine.schema.types[b].constraints]
    for owner, c in held:
        what = ", ".join(c.fields)
        if c.kind == "exclusive":
            parts = [t for t in engine.schema.concrete(owner.name)]  # of an interface, over all that implement it
            every = None
            for t in parts:
                rows = engine.table(t.table)
                if c.unless:
                    frame = _frame_of(compiler, t, rows)
                    free = F.coalesce(compiler.scalar(parse(c.unless).source, frame, {}), F.lit(False))
                    rows = frame.df.where(~free)
                rows = rows.select(*[F.expr(_column(t, f)).alias(f) for f in c.fields])
                every = rows if every is None else every.unionByName(rows)
            mine = changed.select(*[F.expr(_column(kind, f)).alias(f) for f in c.fields]).dropna().distinct()
            if every.join(mine, list(c.fields), "left_semi").groupBy(*c.fields).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
                raise QueryError(f"'{owner.name}' has a second object with this {what}")
            continue
        if c.kind == "readonly":
            continue
        frame = _frame_of(compiler, kind, changed)
        if c.kind == "expression":
            good = compiler.scalar(parse(str(c.arg)).source, frame, {})
        else:
            v = frame.col(c.fields[0])
            good = {
                "min": lambda: v >= c.arg, "max": lambda: v <= c.arg, "min_ex": lambda: v > c.arg, "max_ex": lambda: v < c.arg, "min_len": lambda: F.char_length(v) >= c.arg,
                "max_len": lambda: F.char_length(v) <= c.arg, "regexp": lambda: v.rlike(str(c.arg)), "one_of": lambda: v.isin(*c.arg),
            }[c.kind]()
        if frame.df.where(~F.coalesce(good, F.lit(True))).limit(1).count():
            raise QueryError(f"'{kind.name}' has an object that breaks the constraint {c.kind} on {what or 'its expression'}")


def _fire(engine, kind, event: str, row: str, ids: DataFrame) -> None:
    for t in kind.triggers:
        if event in t.on:
            node = parse(t.handler)
            compiler = engine.compiler()
            frame = compiler.scan(kind.name)
            frame = replace(frame, df=frame.df.join(ids.select(F.col("id").alias("__fired")), frame.key == F.col("__fired"), "left_semi"))
            if not isinstance(node, A.Insert):
                raise QueryError("triggers insert")
            _insert(engine, compiler, engine.schema.types[node.type], node, frame, {row: (replace(frame, df=None), {})})
