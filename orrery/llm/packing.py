"""Packing documents into sequences of tokens by cutting-stock column generation.

A document's tokens and an end token are cut after each full sequence; what is left over is shorter. Up to `CLASSES`
different lengths are planned as they are; if there are more, neighbours share a class that reserves the longest of
them, those first whose rounding costs the fewest tokens. A linear program over patterns, the ways to fill a sequence with
lengths, minimises the number of sequences; a knapsack by dynamic programming prices new patterns by the program's
dual values until none helps, or until the bound that the prices give is within `GAP`. Pattern counts are rounded
down, and first fit decreasing packs the rest of the histogram, at most about one sequence for each class.

The driver sees the histogram and the patterns only, which the number of classes bounds. Pieces are ranked within
their class, in salted groups whose counts are summed up in a small table, and a pattern takes ranges of ranks; so
any piece's sequence follows from its class and rank.

Defined results: a null text is an empty one and gives its end token only; repeated rows and null doc_ids are packed
like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_pairs import BytePairs
from .common import chunks, discard, release, table, written

SIZE = 4096
CLASSES = 320
END = 2
GAP = 5e-4
SALTS = 64
CACHE = 1_000_000
CHUNK = 8 << 20

_encoders: dict[str, tuple] = {}


class Encoder:
    """Token ids of texts, those of each lower-case word kept in arrays: `words`, and by `at` their part of `ids`.

    The vocabulary's normaliser composes (NFC), collapses white space and lowers case by characters, and no token
    goes over white space; so a text is encoded word by word, on arrays where the vocabulary has the form for it. The
    few texts where that would differ are encoded whole: those with the strings of special tokens, as they are or in
    lower case, those that are not composed any more in lower case (U+0130 before some marks), and those with U+001C to
    U+001F, which are space to some and not to others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.pairs = BytePairs.of(path)
        self.special = {t.content: n for n, t in self.whole.get_added_tokens_decoder().items()}
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.at = pa.array([""], pa.large_string()), np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def learn(self, words: pa.Array) -> None:
        """Encodes words, those that arrays can't a hundred at a time with a special token between them, which no word has."""
        done, own, counts = self.pairs.encode(words) if self.pairs else (np.zeros(len(words), bool), self.ids[:0], np.zeros(0, np.int64))
        texts, ids, sizes = words.filter(pa.array(~done)).to_pylist(), [self.ids[:0]], [np.zeros(0, np.int64)]
        if not self.special:
            codes = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            ids += codes
            sizes.append(np.array([len(c) for c in codes], np.int64))
        else:
            between, number = next(iter(self.special.items()))
            for k in range(0, len(texts), 100):
                got = np.array(self.whole.encode(between.join(texts[k : k + 100]), add_special_tokens=False).ids, "<u4")
                sign = got == number
                ids.append(got[~sign])
                sizes.append(np.diff(np.flatnonzero(np.concatenate([[True], sign, [True]]))) - 1)
        length = np.empty(len(words), np.int64)
        length[done], length[~done] = counts, np.concatenate(sizes)
        mine = np.repeat(done, length)
        new = np.empty(len(mine), "<u4")
        new[mine], new[~mine] = own, np.concatenate(ids)
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, new])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(length)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 offsets of the texts in them."""
        odd_signs = (*self.special, *_SEPARATORS)
        plain = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        odd = {k: t for k, (t, p) in enumerate(zip(texts, plain, strict=True)) if any(s in t for s in odd_signs) or any(s in p for s in self.special) or not unicodedata.is_normalized("NFC", p)}
        for k in odd:
            plain[k] = ""
        split = pa.compute.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        each = split.flatten().dictionary_encode()
        if len(self.words) > CACHE:
            self.forget()
        number = pa.compute.index_in(each.dictionary, value_set=self.words)
        known, new = len(self.words), each.dictionary.filter(number.is_null())
        if len(new):
            self.learn(new)
            place = number.fill_null(-1).to_numpy().astype(np.int64)
            place[place < 0] = known + np.arange(len(new))
        else:
            place = number.to_numpy()
        start, size = self.at[place], self.at[place + 1] - self.at[place]
        flat = self.ids
        at = each.indices.to_numpy(zero_copy_only=False)
        length = size[at]
        ends = np.cumsum(length)
        ids = flat[np.repeat(start[at] - ends + length, length) + np.arange(int(length.sum()))]
        offsets = np.append(0, ends)[np.append(0, np.cumsum(np.asarray(split.value_lengths())))]
        if odd:
            parts = [ids[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            for k, t in odd.items():
                parts[k] = np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4")
            ids, offsets = np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
        return ids, offsets


_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, size: int, end: int):
    def run(batches):
        encoder = _encoder(path)
        for b in batches:
            ids, text = b.column("doc_id"), b.column("text")
            bytes_ = np.append(0, np.cumsum(pa.compute.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)))
            for lo, hi in chunks(bytes_, CHUNK):
                codes, at = encoder.encode(text.slice(lo, hi - lo).to_pylist())
                n = hi - lo
                at = at + np.arange(n + 1)  # an end token after each document
                every = np.full(at[-1], end, "<u4")
                own = np.ones(at[-1], bool)
                own[at[1:] - 1] = False
                every[own] = codes
                raw = memoryview(every.tobytes())
                tokens = np.diff(at)
                times = -(-tokens // size)
                row = np.repeat(np.arange(n), times)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)) * size
                length = np.minimum(size, tokens[row] - start)
                first = (at[:-1][row] + start) * 4
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                cols = [ids.take(pa.array(row + lo)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        release()

    return run


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(_pieces(path, size, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def length_classes(histogram: dict[int, int], most: int = CLASSES) -> dict[int, int]:
    """The class of each length, the greatest length in it."""
    up = sorted(histogram)
    count = [histogram[s] for s in up]
    after, before, alive = list(range(1, len(up) + 1)), list(range(-1, len(up) - 1)), [True] * len(up)
    cost = [(count[k] * (up[k + 1] - up[k]), k, k + 1, count[k]) for k in range(len(up) - 1)]
    heapq.heapify(cost)
    left = len(up)
    while left > most:
        _, k, n, times = heapq.heappop(cost)
        if not alive[k] or after[k] != n or count[k] != times:
            continue
        alive[k] = False
        count[n] += count[k]
        before[n] = before[k]
        left -= 1
        if before[k] >= 0:
            after[before[k]] = n
            heapq.heappush(cost, (count[before[k]] * (up[n] - up[before[k]]), before[k], n, count[before[k]]))
        if after[n] < len(up):
            heapq.heappush(cost, (count[n] * (up[after[n]] - up[n]), n, after[n], count[n]))
    out, at = {}, 0
    for k in reversed(range(len(up))):
        at = up[k] if alive[k] else at
        out[up[k]] = at
    return out


def _best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within `room` of the greatest value, by dynamic programming over the room."""
    good = np.flatnonzero(value > 1e-12)
    order = good[np.argsort(sizes[good])]
    s, v = sizes[order], value[order]
    best, pick, many = np.zeros(room + 1), np.full(room + 1, -1), np.zeros(room + 1, np.int64)
    for k in range(len(s)):
        times = 1
        while times * s[k] <= room:
            step = times * s[k]
            got = best[:-step] + times * v[k]
            at = np.flatnonzero(got > best[step:] + 1e-15)
            best[at + step], pick[at + step], many[at + step] = got[at], k, times
            times *= 2
    counts, r = np.zeros(len(sizes), np.int64), room
    while r > 0 and pick[r] >= 0:
        counts[order[pick[r]]] += many[r]
        r -= many[r] * s[pick[r]]
    return float(best[room]), counts


def plan(histogram: dict[int, int], room: int, gap: float = GAP, turns: int = 20_000) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, pieces of each class) for all patterns in use; every piece of the histogram has a place."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([histogram[int(k)] for k in sizes], float)
    m = len(sizes)
    columns = [np.where(np.arange(m) == k, room // s, 0) for k, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    inverse = np.diag(1.0 / np.diag(basis))
    x = need / np.diag(basis)
    bound = float(sizes @ need) / room  # no plan can have fewer sequences than this, nor than the prices say
    for turn in range(turns):
        duals = inverse.sum(0)
        worth, new = _best_pattern(duals, sizes, room)
        bound = max(bound, x.sum() / worth)
        if worth <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        some = np.flatnonzero(new)
        direction = (inverse[:, some] * new[some]).sum(1)
        at = np.flatnonzero(direction > 1e-9)
        if not len(at):
            break
        ratios = np.maximum(x[at], 0) / direction[at]
        out = at[int(ratios.argmin())]
        step = float(ratios.min())
        x = x - step * direction
        x[out] = step
        columns[out] = new
        basis[:, out] = new
        if turn % 500 == 499:
            inverse = np.linalg.inv(basis)
            x = inverse @ need
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
    left = {int(s): int(n) for s, n in zip(sizes, need, strict=True)}
    out_: list[tuple[int, dict[int, int]]] = []
    for column, times in sorted(zip(columns, x, strict=True), key=lambda p: -p[1]):
        pattern = {int(sizes[k]): int(column[k]) for k in np.flatnonzero(column)}
        times = min([int(times + 1e-6), *(left[s] // n for s, n in pattern.items())])
        if times > 0:
            out_.append((times, pattern))
            for s, n in pattern.items():
                left[s] -= n * times
    while any(left.values()):  # first fit decreasing, whole equal sequences at a time
        free, pattern = room, {}
        for s in sorted(left, reverse=True):
            if n := min(left[s], free // s):
                pattern[s] = n
                free -= n * s
        times = min(left[s] // n for s, n in pattern.items())
        out_.append((times, pattern))
        for s, n in pattern.items():
            left[s] -= n * times
    return out_


def packed(docs: DataFrame, path: str, size: int = SIZE, most: int = CLASSES, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    cut = pieces(docs, path, size, end)
    cut = written(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int")), "pieces")
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    classes_df = spark.createDataFrame(list(length_classes(lengths, most).items()), "length long, class int")
    cut = cut.join(F.broadcast(classes_df), "length")
    groups = cut.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = groups.collect()  # at most most * SALTS rows
    histogram: dict[int, int] = {}
    before, at = [], {}
    for r in sorted(counts, key=lambda r: (r["class"], r["salt"])):
        before.append((r["class"], r["salt"], at.get(r["class"], 0)))
        at[r["class"]] = at.get(r["class"], 0) + r["n"]
    histogram = dict(at)
    taken: dict[int, int] = {}
    places, sequence = [], 0
    for times, pattern in plan(histogram, size):
        for s, n in pattern.items():
            lo = taken.get(s, 0)
            places.append((s, lo, lo + times * n, sequence, n))
            taken[s] = lo + times * n
        sequence += times
    before_df = spark.createDataFrame(before, "class int, salt int, before long")
    places_df = spark.createDataFrame(places, "class int, lo long, hi long, first long, each long")
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy(F.desc("length"), "ids_crc32", "doc_id", "start")) - 1
    ranked = cut.withColumn("rank", rank).join(F.broadcast(before_df), ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    p = F.broadcast(places_df.withColumnRenamed("class", "of"))
    placed = ranked.join(p, (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.expr("(rank - lo) div each"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("offset", F.sum("length").over(ahead) - F.col("length"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_path())
