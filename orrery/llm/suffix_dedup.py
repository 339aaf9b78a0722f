"""Removal of long strings that occur more than once, on the UTF-8 bytes of whole texts.

A byte goes if it lies in a string of `length` bytes (a window) that also starts anywhere else, in the same document
or another. Windows are sharded by content: a window belongs to its anchor, the least of the hashes of its `GRAM`-byte
substrings, leftmost if tied, so equal windows meet in one shard. The windows of an anchor at one place are
consecutive; their text is the anchor's context.

Each different context goes once, with a mark if it occurs more than once, to suffix arrays of about `BLOCK` bytes:
induced sorting puts equal windows side by side, permuted common prefixes of `length` or more show which are repeated,
and a marked context is repeated as a whole. All bytes that go are found by these arrays; digests only tell which contexts are
equal. An anchor with more than `MOST` different contexts would be too much for one task: its contexts are split by the place of
the anchor in the window, and the windows of each half are anchored anew by the text that all of that half share.
Equal windows stay together in this, and at the latest single windows are one group of one text each.

Where strings of a shorter length are looked for as well, that goes first: a string of `length` bytes occurs again only
if all the shorter ones in it do, so windows need to be looked at only in unbroken rows of repeated shorter ones.

Defined results: a null text is an empty one; texts shorter than `length` lose nothing; rows with equal doc_id and
text lose the same; repeated rows are repeated strings; columns that aren't named are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_INV, U64, byte_rows, chunks, discard, mix64, powers, prefix_hash, release, table, written
from .suffix_array import common_prefixes, suffix_array

LENGTH = 400
GRAM = 128
PASSAGE = 240  # passages of more than 50 words rarely have fewer bytes, and often fewer than 400
CHUNK = 1 << 18
SEGMENT = 1 << 22
BLOCK = 1 << 20
MOST = 1500
_LOW = U64((1 << 24) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each position on, as far as there are so many."""
    n = len(values)
    rows = -(-n // width)
    v = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    v[:n] = values
    v = v.reshape(rows, width)
    ahead = np.minimum.accumulate(v, 1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, number of windows, offset of the anchor from the first window, hash); positions count within `data`."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    p = prefix_hash(data)
    m = len(data) - gram + 1
    h = mix64((p[gram:] - p[:m]) * powers(BASE_INV, m))
    packed = (h & ~_LOW) | np.arange(m, dtype=U64)
    at = (_least(packed, length - gram + 1) & _LOW).astype(np.int64)
    size = np.diff(offsets)
    rows = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    first = np.repeat(offsets[:-1] - np.append(0, np.cumsum(np.maximum(size - length + 1, 0)))[:-1], np.maximum(size - length + 1, 0))
    starts = np.arange(len(rows)) + first
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    at = at[starts]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])))
    return rows[new], starts[new], np.diff(np.append(new, len(starts))), at[new] - starts[new], h[at[new]].view(np.int64)


def _digest(x: bytes | memoryview) -> int:
    return int.from_bytes(hashlib.md5(x).digest()[:8], "little", signed=True)


def _cut(offsets: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of pieces of rows longer than SEGMENT that have each window in one piece."""
    out = []
    for r in np.flatnonzero(np.diff(offsets) > SEGMENT):
        a, end = int(offsets[r]), int(offsets[r + 1])
        while a + length <= end:
            out.append((int(r), a, min(end, a + SEGMENT + length - 1)))
            a += SEGMENT
    return out


def _stretches(spans_: pa.ListArray, shorter: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the stretches of at least `length` bytes whose strings of `shorter` bytes all lie in `spans_`,
    which cover whole runs of them."""
    row = np.repeat(np.arange(len(spans_)), np.asarray(spans_.value_lengths().fill_null(0)))
    each = spans_.flatten()
    first = (row << 32) + np.asarray(each.field("from"))
    last = (row << 32) + np.asarray(each.field("to")) - shorter
    order = np.argsort(first)
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.append(True, first[1:] > reach[:-1] + 1)[: len(first)])
    first, reach = first[new], reach[np.append(new[1:], len(reach))[: len(new)] - 1]
    keep = reach - first >= length - shorter
    row, first, reach = first[keep] >> 32, first[keep], reach[keep]
    return row, first - (row << 32), reach - (row << 32) + shorter


def _occurrences(length: int, gram: int, shorter: int | None = None):
    """Anchors of whole texts or, with `shorter`, of the stretches of texts that column `spans` has of strings as long."""

    def found(data, offsets):
        for lo, hi in chunks(offsets, CHUNK):
            if offsets[hi] - offsets[lo] <= SEGMENT:
                part = offsets[lo : hi + 1]
                r, s, n, off, h = anchors(data[part[0] : part[-1]], part - part[0], length, gram)
                yield r + lo, s + part[0], n, off, h
        for row, a, b in _cut(offsets, length):
            r, s, n, off, h = anchors(data[a:b], np.array([0, b - a]), length, gram)
            yield r + row, s + a, n, off, h

    def run(batches):
        release()
        for b in batches:
            data, offsets = byte_rows(b.column("text"))
            ids, keys = b.column("id"), b.column("th")
            row, base = np.arange(len(b)), np.zeros(len(b), np.int64)
            if shorter is not None:
                row, base, end = _stretches(b.column("spans"), shorter, length)
                parts = [data[x:y] for x, y in zip((offsets[row] + base).tolist(), (offsets[row] + end).tolist(), strict=True)]
                data, offsets = np.concatenate([np.zeros(0, np.uint8), *parts]), np.append(0, np.cumsum(end - base))
            whole = memoryview(data)
            for r, s, n, off, h in found(data, offsets):
                digests = [_digest(whole[x : x + y]) for x, y in zip(s.tolist(), (n + length - 1).tolist(), strict=True)]
                take = pa.array(row[r])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(s - offsets[r] + base[r]), pa.array(n), pa.array(off), pa.array(h), pa.array(digests, pa.int64())], ["id", "th", "at", "n", "off", "key", "ctx"],
                )
        release()

    return run


_OCC = "id long, th long, at long, n long, off long, key long, ctx long"


def _texts(length: int):
    """Context texts for the rows (text, need: array of at, n, off, key, ctx, many)."""

    def run(batches):
        for b in batches:
            text = b.column("text").to_pylist()
            need = b.column("need")
            each = need.flatten()
            row = np.repeat(np.arange(len(need)), np.asarray(need.value_lengths()))
            at, n = np.asarray(each.field("at")), np.asarray(each.field("n"))
            step = 4000
            for k in range(0, len(row), step):
                part = slice(k, k + step)
                got = [text[r][a : a + m + length - 1] for r, a, m in zip(row[part].tolist(), at[part].tolist(), n[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[each.field(c)[part] for c in ("key", "ctx", "n", "off", "many")], pa.array(got, pa.binary())], ["key", "ctx", "n", "off", "many", "text"])

    return run


_CONTEXT = "key long, ctx long, n long, off long, many boolean, text binary"


def _repeated(texts: list[bytes], n: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, last window) of the runs of windows that occur twice among the contexts, of which those
    in `many` stand for several."""
    size = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # 0xFF is in no UTF-8 text
    start = np.append(0, np.cumsum(size))[:-1]
    piece = np.repeat(np.arange(len(texts)), size)
    inside = np.arange(len(data)) - start[piece]
    window = inside < n[piece]
    order = suffix_array(data, length)
    order = order[window[order]]
    follows = window & (inside > 0)
    before, common = common_prefixes(data, order, size[piece] - 1 - inside, follows)
    hit = common >= length
    hit[before[hit]] = True
    hit |= window & many[piece]
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.append(True, (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return piece[at[first]], inside[at[first]], inside[at[last]]


def _sorted_blocks(length: int):
    """(key, ctx, lo, hi): runs of repeated windows, from contexts that come sorted by key; whole keys gather until a
    block is full."""

    def verdicts(keep):
        who, lo, hi = _repeated([k[3] for k in keep], np.array([k[2] for k in keep]), np.array([k[4] for k in keep], bool), length)
        if len(who):
            keys, ctxs = np.array([k[0] for k in keep], np.int64), np.array([k[1] for k in keep], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[who]), pa.array(ctxs[who]), pa.array(lo), pa.array(hi)], ["key", "ctx", "lo", "hi"])

    def run(batches):
        release()
        keep, held, last = [], 0, None
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("key", "ctx", "n", "text", "many")], strict=True):
                if row[0] != last and held >= BLOCK:
                    yield from verdicts(keep)
                    keep, held = [], 0
                last = row[0]
                keep.append(row)
                held += len(row[3])
        if keep:
            yield from verdicts(keep)

    return run


_VERDICT = "key long, ctx long, lo long, hi long"


def _halves(length: int, width: int):
    """Each context split by the offset of the anchor, in ranges of `width`, and keyed by the text that all windows
    with an anchor in that range share; `shift` is the part's place in the context (of, of_ctx)."""

    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "ctx", "n", "off", "many", "text")]
            out = []
            for key, ctx, n, off, many, text in zip(*cols, strict=True):
                for j in range((off - n + 1) // width, off // width + 1):
                    lo, hi = off - min(off, (j + 1) * width - 1), off - max(off - n + 1, j * width) + 1
                    part = text[lo : hi + length - 1]
                    shared = text[off - j * width : off - (j + 1) * width + 1 + length]
                    out.append((key, ctx, lo, _digest(b"%d|%d|" % (width, j) + shared), _digest(part), hi - lo, off - lo, many, part))
            for k in range(0, len(out), 4000):
                cs = list(zip(*out[k : k + 4000], strict=True))
                kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cs, kinds, strict=True)], ["of", "of_ctx", "shift", "key", "ctx", "n", "off", "many", "text"])

    return run


def _bytes():
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with __id and __th, which name a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"), F.xxhash64(text).alias("__th"))


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, within: tuple[int, DataFrame] | None = None) -> DataFrame:
    """(id, th, from, to): bytes to remove, in spans that may overlap. `within`: a shorter length and what this function
    gave for it, if that is known; the result is the same."""
    texts = keyed(docs.select("doc_id", "text")).select(F.col("__id").alias("id"), F.col("__th").alias("th"), _bytes().alias("text")).where(F.length("text") >= length)
    looked = texts if within is None else texts.join(_listed(within[1], "spans"), ["id", "th"])
    every = written(looked.mapInArrow(_occurrences(length, gram, within and within[0]), _OCC), "anchors")
    # written, so that both sides of the next join are plain shuffles, whose hot keys adaptive execution splits
    again = written(every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "repeated-keys")
    occ = written(every.join(again, "key"), "repeated-anchors")
    discard(every, again)
    # several rows of one text are several occurrences, so contexts count rows and not places
    contexts = occ.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("c"), F.first(F.struct("id", "th", "at", "n", "off")).alias("one"))
    need = contexts.select("one.id", "one.th", F.struct("one.at", "one.n", "one.off", "key", "ctx", (F.col("c") > 1).alias("many")).alias("x"))
    need = need.groupBy("id", "th").agg(F.collect_list("x").alias("need"))
    got = texts.join(need, ["id", "th"]).mapInArrow(_texts(length), _CONTEXT)
    open_ = written(got.dropDuplicates(["key", "ctx"]), "context-texts")
    places, found = None, []
    width = 1 << (length - gram).bit_length()
    while True:
        sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
        hot = written(sizes.where(F.col("k") > most).select("key"), "hot-keys")
        any_hot = hot.limit(1).count() > 0
        few = open_.join(hot, "key", "left_anti") if any_hot else open_
        made = written(few.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_blocks(length), _VERDICT), "verdicts")
        found.append(made if places is None else made.join(places, ["key", "ctx"]).select(F.col("top").alias("key"), F.col("top_ctx").alias("ctx"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi")))
        if not any_hot:
            discard(open_, hot)
            break
        width //= 2
        halves = written(open_.join(hot, "key").mapInArrow(_halves(length, width), "of long, of_ctx long, shift long, " + _CONTEXT), "halves")
        under = halves.select("of", "of_ctx", F.col("shift").alias("more"), "key", "ctx")
        if places is None:
            places = under.select("key", "ctx", F.col("of").alias("top"), F.col("of_ctx").alias("top_ctx"), F.col("more").alias("shift"))
        else:
            up = places.select(F.col("key").alias("of"), F.col("ctx").alias("of_ctx"), "top", "top_ctx", "shift")
            places = under.join(up, ["of", "of_ctx"]).select("key", "ctx", "top", "top_ctx", (F.col("shift") + F.col("more")).alias("shift"))
        places = written(places, "places")
        discard(open_, hot)
        equal = halves.groupBy("key", "ctx").agg(F.first(F.struct("n", "off", "text")).alias("one"), (F.max("many") | (F.count(F.lit(1)) > 1)).alias("many"))
        open_ = written(equal.select("key", "ctx", "one.n", "one.off", "many", "one.text"), "open-halves")
        discard(halves)
    verdicts = found[0]
    for f in found[1:]:
        verdicts = verdicts.unionByName(f)
    if len(found) > 1:
        verdicts = written(verdicts, "all-verdicts")
    out = occ.join(verdicts, ["key", "ctx"]).select("id", "th", (F.col("at") + F.col("lo")).alias("from"), (F.col("at") + F.col("hi") + length).alias("to"))
    out = written(out, "spans")
    discard(occ, verdicts, found[0], places)
    return out


def _runs(spans_: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans_ or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return text
    at, parts = 0, []
    for a, b in runs:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _listed(found: DataFrame, name: str) -> DataFrame:
    """(id, th, `name`: the different spans)."""
    return found.groupBy("id", "th").agg(F.collect_set(F.struct("from", "to")).alias(name))


def _attached(docs: DataFrame, **found: DataFrame) -> DataFrame:
    rows = keyed(docs)
    for name, spans_ in found.items():
        rows = rows.join(_listed(spans_, name).withColumnsRenamed({"id": "__id", "th": "__th"}), ["__id", "__th"], "left")
    return rows.drop("__id", "__th").withColumn("__bytes", _bytes())


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with the bytes of their text as __bytes and the spans to remove as __spans (null: none)."""
    return _attached(docs, __spans=spans(docs, **options))


def with_passages(docs: DataFrame) -> DataFrame:
    """As `with_spans`, and the spans of repeated strings of `PASSAGE` bytes as __passages."""
    passages = spans(docs, length=PASSAGE, gram=PASSAGE // 3)
    return _attached(docs, __spans=spans(docs, within=(PASSAGE, passages)), __passages=passages)


_DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
_PASSAGES = "n_passage_bytes long, passage_text string"


def _merged(spans_: pa.ListArray) -> list[list[tuple[int, int]]]:
    """The runs of each row, as `_runs` has them."""
    row, first, end = _stretches(spans_, 1, 1)
    cut = np.searchsorted(row, np.arange(len(spans_) + 1)).tolist()
    runs = list(zip(first.tolist(), end.tolist(), strict=True))
    return [runs[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _digests(batches):
    for b in batches:
        texts, rows = b.column("text").to_pylist(), []
        merged = _merged(b.column("spans"))
        for text, runs in zip(texts, merged, strict=True):
            kept = _kept(text, runs)
            rows.append((len(text), sum(z - a for a, z in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
        if "passages" in b.schema.names:
            for k, runs in enumerate(_merged(b.column("passages"))):
                same = runs == merged[k]
                rows[k] += (sum(z - a for a, z in runs), rows[k][4] if same else _kept(texts[k], runs).decode("utf-8", "ignore"))
            kinds += [pa.int64(), pa.string()]
            names += ["n_passage_bytes", "passage_text"]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """`docs` with repeated strings cut out of `text`, and n_chars, where it is a column, counted anew. Bytes of
    characters that a cut leaves in part are dropped. Null texts stay null."""

    @F.pandas_udf("string")
    def cut(text, found):
        return text.combine(found, lambda t, s: t if s is None else _kept(t, _runs(list(s)))).map(lambda t: bytes(t).decode("utf-8", "ignore"))

    out = with_spans(docs, **options)
    text = F.when(F.col("__spans").isNull(), F.col("text").cast("string")).otherwise(cut("__bytes", "__spans"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The columns of the contract, and `text`, what remains, without bytes of characters cut in part. Repeated strings
    of `PASSAGE` bytes, which the contract leaves in, are counted and cut in columns of their own."""
    rows = with_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = {"__bytes": "text", "__spans": "spans", "__passages": "passages"}
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(n) for c, n in names.items()])
    return rows.mapInArrow(_digests, f"{_DIGESTS}, {_PASSAGES}")
