"""The entry point: an engine that runs queries against tables registered under an object schema."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import ast as A
from .plans.compile import Compiler
from .plans.lexer import QueryError
from .plans.parser import parse, parse_script
from .schema import INTERVALS, Schema


def parameters(node) -> set[str]:
    if isinstance(node, A.Param):
        return {node.name}
    if isinstance(node, A.Node):
        return parameters(tuple(vars(node).values()))
    return {n for x in node for n in parameters(x)} if isinstance(node, tuple) else set()


class Engine:
    """Compiles query texts to DataFrames. `tables` gives the DataFrame of a table by name; `channels` those of notify."""

    def __init__(self, spark: SparkSession, schema: Schema, tables: Callable[[str], DataFrame] | dict[str, DataFrame], globals_: dict | None = None, channels: dict | None = None):
        self.spark, self.schema, self.globals = spark, schema, dict(globals_ or {})
        self._tables = tables if callable(tables) else None
        self.store: dict[str, DataFrame] = {} if callable(tables) else dict(tables)
        self.channels, self.sequences, self.next_key = dict(channels or {}), {}, {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        if name not in self.store:
            self.store[name] = self._tables(name)
        return self.store[name]

    def query(self, text: str, **params) -> DataFrame:
        return self.run(parse(text), params)

    def compiler(self, params: dict | None = None) -> Compiler:
        out = Compiler(self.spark, self.schema, self.table, params, self.globals)
        out.engine = self
        return out

    def run(self, node: A.Node, params: dict | None = None) -> DataFrame:
        extra = set(params or {}) - parameters(node)
        if extra:
            raise QueryError(f"unknown parameter ${sorted(extra)[0]}")
        if isinstance(node, A.Analyze):
            return self.spark.createDataFrame([(line,) for line in self._plan(self.run(node.body, params)).splitlines()], "plan string")
        if isinstance(node, A.Insert | A.Update | A.Delete) or isinstance(node, A.For) and isinstance(node.body, A.Insert | A.Update | A.Delete):
            from .operators.mutate import mutate

            return mutate(self, node, params or {})
        if isinstance(node, A.Select) and isinstance(node.source, A.Call) and node.source.name in ("notify", "notify_raw"):
            return self._notify(node.source, params)
        compiler = self.compiler(params)
        return compiler.finished(compiler.rows(node, {}), {})

    def _notify(self, call: A.Call, params: dict | None) -> DataFrame:
        """`select notify(Channel, payload)`, or notify_raw with the name as text: the payload goes to the channel."""
        first, payload = call.args
        name = first.name if isinstance(first, A.Name) else str(first.value)
        if name not in self.channels:
            raise QueryError(f"unknown channel '{name}'")
        if isinstance(payload, A.Lit) and len(str(payload.value).encode()) >= 8000:
            raise QueryError("the payload of a notification has less than 8000 bytes")
        rows = self.run(A.Select(payload), params)
        self.channels[name].notify(rows)
        return rows

    def script(self, text: str, **params) -> list[DataFrame]:
        """The results of a script's statements, run in their order."""
        return [self.run(n, {k: v for k, v in params.items() if k in parameters(n)}) for n in parse_script(text)]

    @staticmethod
    def _plan(df: DataFrame) -> str:
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def analyze(self, text: str, **params) -> str:
        """The plan of a query as Spark explains it."""
        return self._plan(self.query(text, **params))

    def sql(self, text: str, **args) -> DataFrame:
        """Spark SQL over the engine's tables, by their names."""
        for name in {t.table for t in self.schema.types.values() if t.table}:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args or None)

    @contextmanager
    def transaction(self) -> Iterator[Engine]:
        """Statements that take effect together: an error brings back the versions from before."""
        before = (dict(self.store), dict(self.next_key))
        try:
            yield self
        except BaseException:
            self.store, self.next_key = before
            raise

    def save(self, kind: str, *objects: dict) -> list:
        """Writes objects, each a dict of properties and single links: those with an id are updated, others inserted.
        An object as a link's value is saved first. The ids, in order."""
        out = []
        with self.transaction():
            for o in objects:
                links = self.schema.types[kind].links
                flat = {k: self.save(links[k].target, v)[0] if isinstance(v, dict) else v for k, v in o.items()}
                fields = [k for k in flat if k != "id"]
                sets = ", ".join(f"{k} := ${k}" for k in fields)
                if flat.get("id") is not None:
                    self.query(f"update {kind} filter .id = $id set {{ {sets} }}", **flat).collect()
                    out.append(flat["id"])
                else:
                    out.append(self.query(f"insert {kind} {{ {sets} }}", **{k: flat[k] for k in fields}).first()["id"])
        return out

    def dump(self, path: str) -> None:
        """All tables as Parquet, those of partitioned types by their interval."""
        for t in self.schema.types.values():
            if t.table and not t.interface:
                df, parts = self.table(t.table), []
                if t.partition:
                    df = df.withColumn("__part", F.date_trunc(INTERVALS[t.partition[1]], F.expr(t.properties[t.partition[0]])).cast("date"))
                    parts = ["__part"]
                df.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/{t.table}")

    def restore(self, path: str) -> None:
        """The tables that `dump` wrote."""
        for name in {t.table for t in self.schema.types.values() if t.table and not t.interface}:
            df = self.spark.read.parquet(f"{path}/{name}")
            self.store[name] = df.drop("__part")
        self.next_key = {}
