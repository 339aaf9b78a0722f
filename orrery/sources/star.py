"""The object schema over the star-shaped test tables, and an engine that reads them from Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import Function, Link, ObjectType, Schema
from ..session import Engine


def _own(prefix: str, names: str) -> dict[str, str]:
    return {n: prefix + n for n in names.split()}


SCHEMA = Schema(
    [
        ObjectType("Party", interface=True, properties={"name": "name", "acctbal": "acctbal"}),
        ObjectType("Region", "region", "r_regionkey", _own("r_", "name")),
        ObjectType("Nation", "nation", "n_nationkey", _own("n_", "name"), {"region": Link("Region", "n_regionkey")}),
        ObjectType("Customer", "customer", "c_custkey", _own("c_", "name acctbal mktsegment"), {"nation": Link("Nation", "c_nationkey")}, {"recent": "select .<customer[is Order] order by .orderdate desc then .id limit 1", "place": "select .nation.region.name"}, ("Party",)),
        ObjectType("Supplier", "supplier", "s_suppkey", _own("s_", "name acctbal"), {"nation": Link("Nation", "s_nationkey")}, bases=("Party",)),
        ObjectType("Part", "part", "p_partkey", _own("p_", "name brand type size retailprice")),
        ObjectType("Order", "orders", "o_orderkey", _own("o_", "orderstatus totalprice orderdate orderpriority"), {
            "customer": Link("Customer", "o_custkey"),
            "parts": Link("Part", through="lineitem", source_column="l_orderkey", target_column="l_partkey", properties={"quantity": "l_quantity", "discount": "l_discount"}),
        }),
        ObjectType("LineItem", "lineitem", "l_orderkey * 8 + l_linenumber", _own("l_", "linenumber quantity extendedprice discount tax returnflag linestatus shipdate"), {"order": Link("Order", "l_orderkey"), "part": Link("Part", "l_partkey"), "supplier": Link("Supplier", "l_suppkey")}),
        ObjectType("Event", "events", "event_id", {n: n for n in "ts user_id event_type value props".split()}),
        ObjectType("Document", "documents", "doc_id", {n: n for n in "text lang source n_chars".split()}),
        ObjectType("Label", "labels", "doc_id", {n: n for n in "quality toxic".split()}, {"doc": Link("Document", "doc_id")}),
        ObjectType("Embedding", "embeddings", "vec_id", {n: n for n in "embedding label".split()}),
        ObjectType("Page", "pages", "page_id", {n: n for n in "url html".split()}),
        ObjectType("Benchmark", "benchmark", "item_id", {"text": "text"}),
        ObjectType("Turn", "conversations", "conv_id * 1000 + turn", {n: n for n in "conv_id turn role text".split()}),
    ],
    aliases={"RichCustomer": "select Customer filter .acctbal > 9000.0"},
    functions=[Function("net", ("price", "discount"), "select price * (1 - discount)"), Function("label_of", ("n",), "select if n > 5000.0 then 'high' else 'low'")],
    globals_={"rate": "select 0.5"},
    enums={"Flag": ("A", "N", "R")},
)


def engine(spark: SparkSession, sf_dir: str, **globals_) -> Engine:
    return Engine(spark, SCHEMA, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), globals_)
