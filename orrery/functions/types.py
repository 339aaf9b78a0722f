"""Types of the query language and of Spark."""

from __future__ import annotations

from pyspark.sql import types as T

# Scalar types of the language and the Spark types that hold them.
SCALARS = {
    "str": "string", "bool": "boolean", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double",
    "decimal": "decimal(38,18)", "bigint": "decimal(38,0)", "uuid": "string", "bytes": "binary", "datetime": "timestamp",
    "geometry": "string", "geography": "string", "duration": "interval day to second", "cal::local_datetime": "timestamp_ntz", "cal::local_date": "date", "cal::local_time": "string", "json": "variant",
}
INTEGERS = (T.ShortType, T.IntegerType, T.LongType, T.ByteType)
FLOATS = (T.FloatType, T.DoubleType)


def spark_type(name: str) -> str:
    name = name.removeprefix("std::")
    if name.startswith("array<"):
        return f"array<{spark_type(name[6:-1])}>"
    if name.startswith("tuple<"):
        return "struct<" + ",".join(f"`{k}`:{spark_type(t)}" for k, t in enumerate(name[6:-1].split(","))) + ">"
    if name not in SCALARS:
        raise ValueError(f"unknown type '{name}'")
    return SCALARS[name]


def is_integer(t) -> bool:
    return isinstance(t, INTEGERS) or isinstance(t, T.DecimalType) and t.scale == 0
