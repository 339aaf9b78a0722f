"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) with label the least node of the component, for all nodes of `edges` (a, b, of one type that has
    an order), and of `labels`, the components that were found before, if given: then only their labels are joined
    further.

    Each round takes the least label among a node and its neighbours, and then the label's own label, so paths shorten
    by halves. Labels stay on the executors; each round is written to the shared folder, and only whether there was a
    change comes to the driver.
    """
    if labels is not None:
        known = labels.withColumnRenamed("node", "of").withColumnRenamed("label", "up")
        left = edges.join(known, F.col("a") == F.col("of"), "left").select(F.coalesce("up", "a").alias("a"), "b")
        both = left.join(known, F.col("b") == F.col("of"), "left").select("a", F.coalesce("up", "b").alias("b"))
        found = components(both)
        joined = found.withColumnRenamed("node", "of").withColumnRenamed("label", "up")
        old = labels.join(joined, F.col("label") == F.col("of"), "left").select("node", F.coalesce("up", "label").alias("label"))
        out = written(old.unionByName(joined.select(F.col("of").alias("node"), F.col("up").alias("label"))).groupBy("node").agg(F.min("label").alias("label")), "labels")
        discard(found, labels)
        return out
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    kind = both.schema["a"].dataType
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast(kind).alias("was"))
        step = heard.unionByName(labels.withColumn("was", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        own = labels.select(F.col("node").alias("of"), F.col("label").alias("up"))
        new = written(step.join(own, step["label"] == own["of"], "left").select("node", "was", F.least("label", "up").alias("label")), "labels")
        discard(labels)
        labels = new.select("node", "label")
        labels._written = new._written
        if not new.where("was <> label").limit(1).count():
            discard(both)
            return labels
