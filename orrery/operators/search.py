"""Search operators: exact nearest neighbours and weighted full-text scores, as built-in expressions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.stdlib import FUNCTIONS
from ..plans import ast as A
from ..plans.lexer import QueryError

METRICS = {"l2": "pgvector::l2_distance", "cosine": "pgvector::cosine_distance", "ip": "pgvector::inner_product", "l1": "pgvector::l1_distance"}


def searched(compiler, node: A.Call, env: dict):
    """`vector::search(set, vector)` with .object and .distance, or `fts::search(set, text)` with .object and .score."""
    frame = compiler.rows(node.args[0], env)
    named = dict(node.named)
    if node.name == "vector::search":
        field = named["field"].value if "field" in named else next((p for p in frame.type.properties if "embedding" in p), None)
        if field is None:
            raise QueryError(f"'{frame.type.name}' has no vector property")
        metric = named["metric"].value if "metric" in named else "l2"
        query = compiler.scalar(node.args[1], frame, env)
        name, value = "distance", FUNCTIONS[METRICS[metric]]([frame.col(field), query], {}, None)
    else:
        fields = [p for p in frame.type.properties if p in ("text", "name", "title")] if "field" not in named else [named["field"].value]
        words = [w for w in str(node.args[1].value if isinstance(node.args[1], A.Lit) else compiler.param(node.args[1].name)).lower().split() if w]
        found = [F.coalesce(F.regexp_count(F.lower(frame.col(p)), F.lit(rf"\b{w}\b")), F.lit(0)) for p in fields for w in words]
        total = sum(found[1:], found[0])
        every = [sum((F.coalesce(F.regexp_count(F.lower(frame.col(p)), F.lit(rf"\b{w}\b")), F.lit(0)) for p in fields), F.lit(0)) > 0 for w in words]
        for e in every:
            frame = replace(frame, df=frame.df.where(e))
        name, value = "score", total.cast("double") / (1 + F.log(F.lit(1.0) + sum((F.char_length(frame.col(p)) for p in fields), F.lit(0))))
    out = compiler.fresh("s")
    df = frame.df.withColumn(out, value)
    kind = replace(frame.type, properties={**frame.type.properties, name: name}, links={**frame.type.links})
    return replace(frame, df=df.withColumnRenamed(out, frame.prefix + name), type=kind)
