"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, the source's target over its size.
Documents of a source stand in one fixed order; the expected copies are summed up along it, one random
offset is added, and a document is emitted once for each integer that its own stretch of the sum crosses.
The order is by size class first, so the copies that are taken hold about the expected number of words.

The running sum needs no task that sees a whole source: rows are ranked inside (source, size class, salt)
groups, and a small table of group counts gives each group the number of rows before it.

Defined results: a null text has size 0; a null source is a source of its own and comes last; rows with a
null or repeated doc_id are rows like others; an empty table gives an empty result; columns other than the
three that are named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
SALTS_HEX = 2  # hexadecimal digits of the hash: 256 salts


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    """The number of binary digits and the four leading ones: sizes of a class differ by an eighth at most."""
    digits = F.length(F.bin(size))
    return (digits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: its size, its target and the copies that each of its documents may expect.

    The targets are the fixed point of handing out the total by weight and handing on what goes beyond
    `cap` times a source's size. Sorted by cap x size / weight, the sources that are cut off come first;
    running sums over that order say where they end. The table has a row for each source.
    """
    per = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    share = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    per = per.withColumn("weight", share.cast("decimal(38,0)")).withColumn("capped_at", (F.col("source_size") * cap).cast("decimal(38,0)"))
    order = Window.orderBy((F.col("capped_at").cast("double") / F.col("weight").cast("double")), F.col("source").isNull(), "source")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast("decimal(38,0)")
    per = (
        per.withColumn("left", (F.sum("source_size").over(everything) - F.coalesce(F.sum("capped_at").over(before), none)).cast("decimal(38,0)"))
        .withColumn("left_weight", (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), none)).cast("decimal(38,0)"))
        .withColumn("cut", F.min((F.col("capped_at").cast("double") * F.col("left_weight").cast("double") < F.col("left").cast("double") * F.col("weight").cast("double")).cast("int")).over(upto))
    )
    # the first source that isn't cut off has the greatest weight left: what is left there goes to it and all after it
    first_open = F.max(F.when(F.col("cut") == 0, F.struct(F.col("left_weight"), F.col("left")))).over(everything)
    per = per.withColumn("open", first_open)
    target = F.when(F.col("cut") == 1, F.col("capped_at").cast("double")).otherwise(F.col("weight").cast("double") * F.col("open.left").cast("double") / F.col("open.left_weight").cast("double"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.col("skey"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return per.select(
        "skey", "source_size", target.alias("target"), offset.alias("offset"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def copies(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, and `hash`, by which equal ids are told apart no further."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
    )
    sized = sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn("class", _size_class(F.col("size")))
    sized = sized.withColumn("hash", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))).withColumn("salt", F.substring("hash", 1, SALTS_HEX))
    sized = written(sized, "mix-sizes")
    group = ["skey", "class", "salt"]
    counts = sized.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("skey").orderBy("class", "salt")) - F.col("n")
    counts = counts.select(*group, before.alias("before")).join(source_targets(sized, weights, cap), "skey")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("hash", "doc_id", "size")) - 1
    ranked = sized.withColumn("at", rank).join(counts, group).withColumn("at", F.col("at") + F.col("before"))
    taken = F.floor((F.col("at") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("at") * F.col("rate") + F.col("offset"))
    return ranked.select("doc_id", "size", "source_size", "target", F.least(taken, F.lit(cap)).cast("long").alias("copies"), "hash", "source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`.

    Copies are joined on (doc_id, size, source). Rows that agree in all three share the copies of those rows evenly.
    """
    own = [F.col(c) for c in docs.columns]
    made = copies(docs, **options).groupBy("doc_id", "size", "source").agg(F.sum("copies").alias("__n"), F.count(F.lit(1)).alias("__m"))
    made = made.select(F.col("doc_id").alias("__id"), F.col("size").alias("__of"), F.col("source").alias("__src"), "__n", "__m")
    sized = docs.withColumn("__size", word_count(F.col(options.get("text_col", "text"))))
    same = sized[options.get("id_col", "doc_id")].eqNullSafe(made["__id"]) & (sized["__size"] == made["__of"])
    rows = sized.join(made, same & sized[options.get("source_col", "source")].cast("string").eqNullSafe(made["__src"]))
    single = rows.where("__m = 1").withColumn("__each", F.col("__n"))
    nth = F.row_number().over(Window.partitionBy("__id", "__of", "__src").orderBy(options.get("text_col", "text")))
    several = rows.where("__m > 1").withColumn("__each", F.expr("__n div __m") + (nth <= F.col("__n") % F.col("__m")).cast("long"))
    out = single.unionByName(several)
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(True), F.col("__each").cast("int")))).select(*own)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def sql(docs: str = "documents") -> str:
    """The same in DuckDB's SQL, without a final select: ends in the table `mixed`."""
    weights = "[" + ", ".join(str(w) for w in WEIGHTS) + "]"
    return f"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce('s' || source, 'n') AS skey, md5('{SEED}' || coalesce(doc_id::VARCHAR, 'null')) AS hash
  FROM {docs}),
placed AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)::BIGINT) AS class, substr(hash, 1, {SALTS_HEX}) AS salt FROM sized),
per AS (SELECT skey, any_value(source) AS source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY skey),
weighed AS (
  SELECT *, ({weights})[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1)::INT]::HUGEINT AS weight, source_size * {CAP} AS capped_at FROM per),
lefts AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(capped_at) OVER w, 0))::DOUBLE AS left_size, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS left_weight
  FROM weighed WINDOW w AS (ORDER BY capped_at::DOUBLE / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (
  SELECT *, min((capped_at::DOUBLE * left_weight < left_size * weight::DOUBLE)::INT) OVER (ORDER BY capped_at::DOUBLE / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM lefts),
open AS (SELECT max(left_weight) AS w, arg_max(left_size, left_weight) AS s FROM cuts WHERE cut = 0),
targets AS (
  SELECT skey, source_size, CASE WHEN cut = 1 THEN capped_at::DOUBLE ELSE weight::DOUBLE * s / w END AS target,
         ('0x' || substr(md5('{SEED}' || skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM cuts LEFT JOIN open ON true),
ranked AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY class, salt, hash, doc_id, size) - 1 AS rank_at FROM placed),
mixed AS (
  SELECT doc_id, source, size, source_size::BIGINT AS source_size, target,
         least(floor((rank_at + 1)::DOUBLE * rate + u) - floor(rank_at::DOUBLE * rate + u), {CAP})::BIGINT AS copies
  FROM ranked JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate FROM targets) USING (skey))"""


SQL = "WITH " + sql().lstrip() + "\nSELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM mixed"
