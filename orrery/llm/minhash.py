"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its set of shingles of five words, a shingle that occurs c times weighing 1.05 - 0.05/c. Elements arrive at
the registers as Poisson processes whose rates are their weights; an arrival goes to a random register and the first
at each register stays. Arrivals are made in order of time up to a bound by which all registers are nearly sure to be
filled, which ends almost all processes early; documents with an empty register are taken up again with twice the
bound, so the result doesn't depend on it. Two registers agree with the probability Jaccard similarity.

Bands of four registers give candidates. In each bucket members are compared with one of their own, the hub, instead
of with each other, twice. Documents in buckets that then still hold several components, texts that are alike but
mostly less than the threshold, are taken together where they share buckets. In such a cluster the shingles that more
than half of its documents have are its centre c, and a document x is written as its difference D(x) from c. For a
pair at the threshold |D(x) - D(y)| both ways is at most (|x| + |y|)/9, so with slack g(x) = |D(x)| - |x|/9:

* if g(x) + g(y) <= 0 the pair is surely linked, and both are linked to the document m of least slack. So all are
  compared with m, which is linear;
* else the differences share (g(x) + g(y))/2 elements at least. So, elements being ordered from rare to common, the
  first |D| - that + 1 of both have one in common: a join on these prefixes finds every such pair. A change that only
  one document has joins with nothing, so far copies of one text fall away without being compared in pairs.

What follows banding is therefore exact. Whatever the counts, a pair at the threshold has a probability Jaccard similarity of
0.76 at least and shares a bucket with probability 0.99994 at least. A link is
a pair of different texts whose sets of shingles have a Jaccard similarity of 0.8 or more; classes are the
connected components of links and of equal texts.

Defined results: equal texts, empty ones too, share a class; a null text is a class of its own; a text of one to four
words is one shingle; different texts under one doc_id are different documents; class_id is the least doc_id of a
class, and null where no row of it has one; columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, byte_rows, chunks, discard, mix64, table, unit, word_hashes, written
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
CHUNK = 1 << 20
_ROUND = U64(0xD1B54A32D192ED03)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles over all rows: (row, hash, count), sorted by row."""
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    rows = np.repeat(np.arange(len(count)), count)
    h, r = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(words) >= n:
        h = np.zeros(len(words) - n + 1, U64)
        for j in range(n):
            h += words[j : len(words) - n + 1 + j] * mix64(np.array([j + 1], U64))
        whole = rows[: len(h)] == rows[n - 1 :]
        h, r = mix64(h[whole]), rows[: len(h)][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), U64)
        for j in range(n - 1):
            has = count[short] > j
            extra[has] += words[at[short[has]] + j] * mix64(np.array([j + 101], U64))
        h, r = np.concatenate([h, mix64(extra)]), np.concatenate([r, short])
    _, first, times = np.unique(mix64(h + r.astype(U64) * _ROUND), return_index=True, return_counts=True)
    order = np.argsort(r[first], kind="stable")
    return r[first][order], h[first][order], times[order]


def _turn(k: int) -> np.uint64:
    return U64(k * int(_ROUND) & 0xFFFFFFFFFFFFFFFF)


def registers(row: np.ndarray, h: np.ndarray, w: np.ndarray, n_rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """The element at each of the m registers of each row; rows without elements keep zeros."""
    out = np.zeros(n_rows * m, U64)
    total = np.bincount(row, w, n_rows)
    todo, bound = total > 0, np.zeros(n_rows)
    bound[todo] = m * (np.log(m) + 6) / total[todo]
    first = -np.log(unit(mix64(h ^ U64(0xA0761D6478BD642F)))) / w
    while todo.any():
        live = np.flatnonzero(todo[row] & (first < bound[row]))
        t, turn = first[live], 0
        found = []
        while len(live):
            cell = row[live] * m + (mix64(h[live] + _turn(turn)) % U64(m)).astype(np.int64)
            found.append((t, cell, h[live]))
            turn += 1
            t = t - np.log(unit(mix64((h[live] ^ U64(0xE7037ED1A0B428DB)) + _turn(turn)))) / w[live]
            on = t < bound[row[live]]
            live, t = live[on], t[on]
        if found:
            t, cell, who = (np.concatenate(x) for x in zip(*found, strict=True))
            late_first = np.argsort(-t, kind="stable")
            hit = np.zeros(n_rows * m, bool)
            hit[cell] = True
            out[cell[late_first]] = who[late_first]
            todo &= ~hit.reshape(n_rows, m).all(1)
        bound[todo] *= 2
    return out.reshape(n_rows, m)


def band_keys(regs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.zeros((len(regs), bands), U64)
    for j in range(rows):
        key = mix64(key * U64(0x9FB21C651E98DF25) + regs[:, j::rows])
    return (key + np.arange(1, bands + 1, dtype=U64) * _ROUND).view(np.int64)


def weights(count: np.ndarray) -> np.ndarray:
    """From 1 to 1.05, so at set Jaccard 0.8 the probability Jaccard is at least 0.8 / 1.05."""
    return 1.05 - 0.05 / count


def _signatures(batches):
    for b in batches:
        data, offsets = byte_rows(b.column("text"))
        keys = []
        for lo, hi in chunks(offsets, CHUNK):
            part = offsets[lo : hi + 1]
            row, h, c = shingles(data[part[0] : part[-1]], part - part[0])
            k = band_keys(registers(row, h, weights(c), hi - lo))
            some = np.bincount(row, minlength=hi - lo) > 0
            keys += [x.tolist() if y else [] for x, y in zip(k, some, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])


def node():
    """What names a text: its digest."""
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def _texts(docs: DataFrame) -> DataFrame:
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return some.where("text IS NOT NULL").select("doc_id", F.unhex(F.md5("text")).alias("node"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands) of the documents that have a text."""
    return _texts(docs).mapInArrow(_signatures, "doc_id long, node binary, bands array<long>")


def _sets(batches):
    for b in batches:
        data, offsets = byte_rows(b.column("text"))
        for lo, hi in chunks(offsets, CHUNK):
            part = offsets[lo : hi + 1]
            row, h, _ = shingles(data[part[0] : part[-1]], part - part[0])
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=hi - lo))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), lists], ["node", "shingles"])


def shingle_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, shingles) of the texts that `members` names, each once."""
    texts = _texts(docs).groupBy("node").agg(F.first("text").alias("text"))  # copies meet before the shuffle
    return texts.join(members, "node", "left_semi").mapInArrow(_sets, "node binary, shingles array<long>")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The row of each element of a list column, and the elements."""
    size = np.asarray(column.value_lengths()).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), np.asarray(column.flatten()).view(U64)


def _verified(threshold: float):
    def run(batches):
        for b in batches:
            joint = np.asarray(b.column("sa").value_lengths()).astype(np.int64) + np.asarray(b.column("sb").value_lengths())
            for lo, hi in chunks(np.append(0, np.cumsum(joint)), CHUNK):
                part, n = b.slice(lo, hi - lo), hi - lo
                sides = [_flat(part.column(c)) for c in ("sa", "sb")]
                marked = [mix64(h + r.astype(U64) * _ROUND) for r, h in sides]
                both = np.intersect1d(*marked, assume_unique=True, return_indices=True)[1]
                common = np.bincount(sides[0][0][both], minlength=n)
                union = joint[lo:hi] - common
                ok = pa.array((common > 0) & (common >= threshold * union - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. `sets`: node and its distinct shingles."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_verified(threshold), "a binary, b binary")


def _open(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows (key, node) of buckets in which there are several components, with their labels."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return rows.join(several, "key")


def differences(sets: DataFrame, cluster_of: DataFrame, threshold: float) -> DataFrame:
    """(cluster, node, n, d, a, g): the sets of the clusters' nodes as differences d from the cluster's centre, of a
    elements, with their slack g. `cluster_of`: node and cluster."""
    own = sets.join(cluster_of, "node")
    sizes = cluster_of.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    counts = own.select("cluster", F.explode("shingles").alias("h")).groupBy("cluster", "h").agg(F.count(F.lit(1)).alias("c"))
    # a centre has at most twice as many shingles as the cluster's documents have on average
    centre = counts.join(sizes, "cluster").where("2 * c > k").groupBy("cluster").agg(F.collect_list("h").alias("centre"))
    both = own.join(centre, "cluster", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    d = F.concat(F.array_except("shingles", "centre"), F.array_except("centre", "shingles"))
    out = both.select("cluster", "node", F.size("shingles").alias("n"), d.alias("d"))
    share = (1 - threshold) / (1 + threshold)
    return out.select("*", F.size("d").alias("a"), (F.size("d") - F.col("n") * share).alias("g"))


def close_pairs(diff: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of a cluster with different labels whose differences have an element in common within the
    prefixes that the threshold leaves. Pairs of slack g(a) + g(b) <= 0 needn't be among them."""
    least = diff.groupBy("cluster").agg(F.min("g").alias("low"), F.min_by("node", "g").alias("m"))
    known = diff.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    docs = diff.join(known, "node").join(least, "cluster")
    core = docs.where("node = m").select("cluster", F.col("label").alias("core"))
    docs = docs.join(core, "cluster")
    # who has another label than m isn't linked to m, so that its slack is over -low
    partner = F.when(F.col("label") == F.col("core"), F.greatest("low", -F.col("low"))).otherwise(F.col("low"))
    docs = docs.withColumn("most", F.col("a") - F.greatest(F.lit(1), F.ceil((F.col("g") + partner) / 2 - 1e-9)) + 1).where("most > 0")
    each = docs.select("cluster", "node", "label", "n", "a", "g", "most", F.explode("d").alias("h"))
    often = each.groupBy("cluster", "h").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    each = each.join(often, ["cluster", "h"])
    mine = Window.partitionBy("node")
    rank = F.row_number().over(mine.orderBy("often", "h"))
    each = each.select("*", rank.alias("rank"), F.count(F.lit(1)).over(mine).alias("shared"))
    each = each.withColumn("at", F.col("a") - F.col("shared") + F.col("rank")).where("at <= most")
    each = written(each.select("cluster", "h", "node", "label", "n", "a", "g", "at"), "prefixes")
    other = each.select("cluster", "h", *[F.col(c).alias(c + "_b") for c in ("node", "label", "n", "a", "g", "at")])
    share = F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("g_b")) / 2 - 1e-9))
    fits = (F.col("label") < F.col("label_b")) & (F.col("n") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n") - 1e-9)
    fits = fits & (F.col("at") <= F.col("a") - share + 1) & (F.col("at_b") <= F.col("a_b") - share + 1)
    on = (each["cluster"] == other["cluster"]) & (each["h"] == other["h"]) & fits
    pairs = each.join(other, on).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    return pairs


def clusters(rows: DataFrame) -> DataFrame:
    """(node, cluster): the nodes that are together in the buckets (key, node), directly or over others.

    Each node stands behind the least of its buckets' least nodes, so components are looked for among those alone."""
    least = rows.groupBy("key").agg(F.min("node").alias("hub"))
    hubs = rows.select("key", "node").join(least, "key")
    own = written(hubs.groupBy("node").agg(F.min("hub").alias("own"), F.collect_set("hub").alias("hubs")), "hubs")
    found = components(own.select(F.col("own").alias("a"), F.explode("hubs").alias("b")).where("a <> b").distinct())
    of = found.select(F.col("node").alias("own"), "label")
    out = written(own.join(of, "own", "left").select("node", F.coalesce("label", "own").alias("cluster")), "clusters")
    discard(own, found)
    return out


def _linked(sig: DataFrame, docs: DataFrame, threshold: float) -> DataFrame | None:
    """(node, label) for the texts that have links; None if no two share a bucket."""
    same = sig.groupBy("node").agg(F.first("bands").alias("bands"))
    every = written(same.select("node", F.explode("bands").alias("key")), "bands")
    full = every.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    rows = written(every.join(full, "key"), "buckets")
    discard(every)
    sets = written(shingle_sets(docs, rows.select("node").distinct()), "candidates")
    labels = None

    def joined(pairs: DataFrame) -> None:
        nonlocal labels
        new = written(verified(pairs, sets, threshold), "links")
        if labels is None or new.limit(1).count():
            labels = components(new, labels)
        discard(new)

    left = None
    for pick in (F.min("node"), F.max("node")):
        old, left = left, written(_open(rows, labels), "open-buckets")
        discard(old)
        if not left.limit(1).count():
            break
        of = left.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")).distinct()
        pairs = left.join(left.groupBy("key").agg(pick.alias("hub")), "key").select("hub", "node", "label").distinct().join(of, "hub")
        joined(pairs.where("label <> hub_label").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    else:
        discard(left)
        left = written(_open(rows, labels), "open-buckets")
        if left.limit(1).count():
            cluster_of = clusters(left)
            diff = written(differences(sets, cluster_of, threshold), "differences")
            m = diff.groupBy("cluster").agg(F.min_by("node", "g").alias("m"))
            pairs = diff.select("cluster", "node").join(m, "cluster").where("node <> m").select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b"))
            joined(pairs)
            joined(close_pairs(diff, labels, threshold))
            discard(cluster_of, diff)
    discard(rows, sets, left)
    return labels


def with_classes(docs: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row with a text, and (node, label, class_id, keep): of every text the class, its least
    doc_id and whether the row of that doc_id has this text."""
    sig = written(signatures(docs), "signatures")
    labels = _linked(sig, docs, threshold)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    per = sig.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    per = per.withColumn("label", F.col("node")) if labels is None else per.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = written(per, "texts")
    discard(labels)
    first = per.groupBy("label").agg(least.alias("first")).select("label", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("kept"))
    found = per.join(first, "label").select("node", "label", "class_id", (F.col("node") == F.col("kept")).alias("keep"))
    return sig.select("doc_id", "node"), found


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id for every row of `docs`."""
    rows, found = with_classes(docs, threshold)
    own = F.col("doc_id").cast("long")
    none = docs.where(F.col("text").isNull()).select(own.alias("doc_id"), own.alias("class_id"))
    return rows.join(found, "node").select("doc_id", "class_id").unionByName(none)


def deduplicated(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` of which each class keeps one, that of the least doc_id, or any if no row of the class has
    one. Rows with a null text all stay."""
    _, found = with_classes(docs, threshold)
    keep = found.where("keep").select(F.col("node").alias("__keep"), F.col("class_id").alias("__least"))
    rows = docs.where(F.col("text").isNotNull()).withColumn("__node", node())
    rows = rows.join(keep, (F.col("__node") == F.col("__keep")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__least")), "left_semi")
    out = rows.dropDuplicates(["__node"]).select(*docs.columns)
    return out.unionByName(docs.where(F.col("text").isNull()))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumn("representative", F.col("doc_id") == F.col("class_id"))
