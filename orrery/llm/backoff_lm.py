"""Log-probabilities of texts under a weighted backoff automaton of word n-grams, learned from the corpus.

The automaton has a state for each context of up to `order` - 1 tokens that training saw, and a root. In state h an arc
for token w bears the logarithm of (1 - L) c(h w) / c(h) + L P(w after h without its first token); where h has no arc
for w, its failure arc, of weight log L, leads to the state of h without its first token, and last to the root, whose
arc bears log P(w). P takes a discount from the count of each token and gives it to the unknown token; the L of a
length is the share of the occurrences of n-grams that training saw once only, and the discount is n1 / (n1 + 2 n2), all
kept from 0.05 to 0.95. All sums run over the whole training part. Reading w leads to the state of the longest context
that ends with w; so one traversal from left to right scores a text.

Counts are exchanged in bulk instead of a row for each n-gram. Documents are dealt to units of about `UNIT` bytes. A
unit sends its distinct n-grams, as sorted hashes with their counts in training texts, to buckets by the leading bits
of the hash; a bucket adds up and answers each unit with the totals in the unit's own order, and with its part of the
corpus sums; the unit, which knows its n-grams, then holds the part of the automaton that its texts can reach. So
no task and not the driver holds the whole model, and what is sent grows with the corpus. Beyond 2**`DIRECT` buckets a
unit doesn't write to each: relays, each for a range of buckets and as many units as there are ranges, merge what those
units ask, send it on, and hand the answers back, so that a unit's messages grow with the root of the corpus.

Within a bucket n-grams are told apart by 40 bits of a hash, tokens by 48. A bucket holds some two million n-grams, so two
or three in a million share their count with another, at every size.

Defined results: a null text is an empty one and has its end token only; with an empty training part every token is
unknown and has probability 1; repeated rows score alike; a null doc_id counts as the empty string when rows
are held out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_rows, crc_mod, mix64, table, word_hashes

MODULUS, HELD_OUT = 7, 2
ORDER = 3
UNIT = 6 << 20
BUCKET = 12 << 20
DIRECT = 12
_END, _START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of the width that costs least; those that don't fit follow in full."""
    d = np.diff(keys, prepend=U64(0))
    _, width = min((w * len(d) + 8 * int(np.count_nonzero(d >= U64(256**w - 1))), w) for w in range(2, 8))
    most = U64(256**width - 1)
    short = np.minimum(d, most).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return struct.pack("<IB", len(d), width) + short.tobytes() + d[d >= most].astype("<u8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", data)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, 5).reshape(n, width)
    d = out.view("<u8").ravel()
    d[d == U64(256**width - 1)] = np.frombuffer(data, "<u8", -1, 5 + n * width)
    return np.cumsum(d, dtype=U64)


def _pack_counts(c: np.ndarray) -> bytes:
    """A byte each; those of 255 or more follow in full."""
    return np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<i8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    big = out == 255
    out[big] = np.frombuffer(data, "<i8", -1, n)
    return out


def _width(order: int, bits: int) -> int:
    """How many bits of a key tell n-grams of a bucket apart, of the 64 that there are."""
    return min(48 if order == 1 else 40, 64 - bits)


def _split(keys: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of `bits` + `width` bits: where each of the 2**bits parts begins, and the end; and their low bits."""
    inner = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U64) << U64(width))
    return np.concatenate([[0], inner, [len(keys)]]), keys & U64((1 << width) - 1)


class Unit:
    """The tokens of a unit's texts, and for each length its distinct n-grams in order of their keys (`keys`), the number
    of the n-gram that ends at a token (`at`, -1 if the text is too short there), and a token for each (`example`)."""

    def __init__(self, text: pa.Array, order: int, bits: int):
        data, offsets = byte_rows(text)
        words, at = word_hashes(_LOWER[data], offsets)
        n = np.diff(at)
        self.order, self.n_tokens = order, n + 1
        last = np.cumsum(self.n_tokens) - 1  # the end tokens
        tokens = np.full(len(words) + len(n), _END, U64)
        is_word = np.ones(len(tokens), bool)
        is_word[last] = False
        tokens[is_word] = words
        self.doc = np.repeat(np.arange(len(n)), self.n_tokens)
        place = np.arange(len(tokens)) - np.repeat(last - n, self.n_tokens)
        self.first = place == 0
        token = mix64(tokens)
        self.end = int(last[0]) if len(n) else 0
        self.keys, self.at, self.example = [], [], []
        gram = token
        for length in range(1, order + 1):
            if length > 1:
                before = np.empty_like(gram)
                before[1:] = gram[:-1]
                if length == 2:
                    before[self.first] = mix64(np.array([_START], U64))[0]
                gram = mix64(before * U64(0x9FB21C651E98DF25) + token)
            there = place >= length - 2
            width = _width(length, bits)
            keys, number = np.unique(gram[there] >> U64(64 - bits - width), return_inverse=True)
            number_at, example = np.full(len(tokens), -1, np.int64), np.empty(len(keys), np.int64)
            number_at[there] = number
            example[number] = np.flatnonzero(there)
            self.keys.append(keys)
            self.at.append(number_at)
            self.example.append(example)


def _columns(order: int) -> list[str]:
    return [f"{c}{k}" for k in range(1, order + 1) for c in "kn"]


def _messages(g: int, buckets, cols: dict[str, list]) -> pa.Table:
    n = len(buckets)
    return pa.Table.from_arrays([pa.array([g] * n, pa.int64()), pa.array(buckets, pa.int64()), *[pa.array(c, pa.binary()) for c in cols.values()]], ["g", "bucket", *cols])


def _requests(order: int, bits: int, direct: int):
    """What a unit asks: a row for each of 2**direct ranges of buckets."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        unit = Unit(t.column("text").chunk(0) if t.num_rows else pa.array([], pa.binary()), order, bits)
        train = t.column("train").to_numpy(zero_copy_only=False).astype(float)[unit.doc]
        cols: dict[str, list] = {}
        for k in range(1, order + 1):
            there = unit.at[k - 1] >= 0
            counts = np.bincount(unit.at[k - 1][there], train[there], len(unit.keys[k - 1])).astype(np.int64)
            cut, low = _split(unit.keys[k - 1], direct, bits - direct + _width(k, bits))
            parts = list(zip(cut[:-1], cut[1:], strict=True))
            cols[f"k{k}"] = [_pack(low[a:z]) for a, z in parts]
            cols[f"n{k}"] = [_pack_counts(counts[a:z]) for a, z in parts]
        return _messages(t.column("g")[0].as_py(), range(1 << direct), cols)

    return run


class Merged:
    """N-grams of one length that several senders ask for: the distinct keys, their counts, and who asked for which."""

    def __init__(self, t: pa.Table, k: int):
        keys = [_unpack(x) for x in t.column(f"k{k}").to_pylist()]
        self.sizes = [len(x) for x in keys]
        local = [_unpack_counts(c, n) for c, n in zip(t.column(f"n{k}").to_pylist(), self.sizes, strict=True)]
        self.keys, self.number = np.unique(np.concatenate(keys), return_inverse=True)
        self.counts = np.bincount(self.number, np.concatenate(local), len(self.keys)).astype(np.int64)

    def answers(self, totals: np.ndarray) -> list[bytes]:
        return [_pack_counts(a) for a in np.split(totals[self.number], np.cumsum(self.sizes)[:-1])]


def _forward(order: int, bits: int, direct: int):
    """What a relay sends on for its units: a row for each bucket of its range."""

    def run(t: pa.Table) -> pa.Table:
        first = t.column("bucket")[0].as_py() << (bits - direct)
        cols: dict[str, list] = {}
        for k in range(1, order + 1):
            m = Merged(t, k)
            cut, low = _split(m.keys, bits - direct, _width(k, bits))
            parts = list(zip(cut[:-1], cut[1:], strict=True))
            cols[f"k{k}"] = [_pack(low[a:z]) for a, z in parts]
            cols[f"n{k}"] = [_pack_counts(m.counts[a:z]) for a, z in parts]
        return _messages(t.column("relay")[0].as_py(), range(first, first + (1 << (bits - direct))), cols)

    return run


def _replies(t: pa.Table, cols: dict[str, list], sums: list[int]) -> pa.Table:
    arrays = [t.column("g"), t.column("bucket"), *[pa.array(c, pa.binary()) for c in cols.values()], pa.array([sums] * t.num_rows, pa.list_(pa.int64()))]
    return pa.Table.from_arrays(arrays, ["g", "bucket", *cols, "sums"])


def _answers(order: int):
    """For each sender the totals of its n-grams of this bucket, and the bucket's part of the sums over the corpus."""

    def run(t: pa.Table) -> pa.Table:
        cols, sums = {}, []
        for k in range(1, order + 1):
            m = Merged(t, k)
            cols[f"n{k}"] = m.answers(m.counts)
            sums += [int(m.counts.sum()), *[int(np.count_nonzero(x)) for x in (m.counts > 0, m.counts == 1, m.counts == 2)]]
        return _replies(t, cols, sums)

    return run


def _gathered(rows: list[dict], k: int, cut: np.ndarray) -> np.ndarray:
    """The totals that the answers to one sender hold, in the order of its keys."""
    return np.concatenate([_unpack_counts(r[f"n{k}"], int(n)) for r, n in zip(rows, np.diff(cut), strict=True)])


def _hand_back(order: int, bits: int, direct: int):
    """The answers to a relay, dealt to the units that asked it."""

    def run(asked: pa.Table, answered: pa.Table) -> pa.Table:
        rows = sorted(answered.to_pylist(), key=lambda r: r["bucket"])
        cols = {}
        for k in range(1, order + 1):
            m = Merged(asked, k)
            cols[f"n{k}"] = m.answers(_gathered(rows, k, _split(m.keys, bits - direct, _width(k, bits))[0]))
        return _replies(asked, cols, np.sum([r["sums"] for r in rows], 0).tolist())

    return run


class Automaton:
    """The part of the automaton that a unit's texts reach. Arcs are given by the n-grams of the unit that training saw:
    `totals` are their counts, `arc` the logarithms that they bear, `failure` that of the failure arcs by the length of
    the n-grams that a state has arcs for."""

    def __init__(self, unit: Unit, totals: list[np.ndarray], sums: list[int]):
        self.unit, self.totals = unit, totals
        self.tokens, self.types, n1, n2 = sums[:4]
        discount = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        discount = min(max(discount, 0.05), 0.95)
        n = max(self.tokens, 1)
        unknown = discount * self.types / n if self.tokens else 1.0
        self.starts = int(totals[0][unit.at[0][unit.end]]) if len(unit.doc) else 0  # texts start as often as they end
        p = np.where(totals[0] > 0, np.maximum(totals[0] - discount, 0) / n, unknown)
        self.arc, self.failure = [np.log10(p)], [0.0]
        for k in range(2, unit.order + 1):
            many, once = sums[4 * k - 4], sums[4 * k - 2]
            share = min(max(once / many, 0.05), 0.95) if many else 1.0
            at = unit.example[k - 1]
            state = totals[k - 2][unit.at[k - 2][at - 1]]  # how often training left the state
            if k == 2:
                state = np.where(unit.first[at], self.starts, state)
            shorter = p[unit.at[k - 2][at]]
            p = np.where(state > 0, (1 - share) * totals[k - 1] / np.maximum(state, 1) + share * shorter, shorter)
            self.arc.append(np.log10(p))
            self.failure.append(math.log10(share))

    def traversed(self) -> np.ndarray:
        """log10 of what the traversal adds at each token of the unit."""
        u = self.unit
        seen = []  # by length, where the n-gram that ends at the token is one that training saw, as are its ends
        for at, total in zip(u.at, self.totals, strict=True):
            now = at >= 0
            now[now] = total[at[now]] > 0
            seen.append(now & seen[-1] if seen else now)
        state = np.zeros(len(u.doc), np.int64)  # how many tokens the context has that the token is read in
        for s in seen[:-1]:
            state[1:] += s[:-1]
        state[u.first] = int(u.order > 1 and self.starts > 0)
        out = np.zeros(len(u.doc))
        open_ = np.ones(len(u.doc), bool)
        for k in range(u.order, 1, -1):
            here = open_ & (state >= k - 1)
            by_arc = here & seen[k - 1]
            out[by_arc] += self.arc[k - 1][u.at[k - 1][by_arc]]
            out[here & ~by_arc] += self.failure[k - 1]
            open_ &= ~by_arc
        out[open_] += self.arc[0][u.at[0][open_]]
        return out


def _scores(order: int, bits: int, direct: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in _TYPES], _NAMES)
        unit = Unit(texts.column("text").chunk(0), order, bits)
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        totals = [_gathered(rows, k, _split(unit.keys[k - 1], direct, bits - direct + _width(k, bits))[0]) for k in range(1, order + 1)]
        sums = np.sum([r["sums"] for r in rows], 0).tolist()
        model = Automaton(unit, totals, sums)
        n_docs = texts.num_rows
        c = totals[0][unit.at[0]]
        base = np.log10((c + 1) / (model.tokens + model.types + 1))
        add = lambda v: np.bincount(unit.doc, v, n_docs)
        out = [
            texts.column("doc_id"), texts.column("held_out"), pa.array(unit.n_tokens, pa.int64()), pa.array(add(c > 0).astype(np.int64)),
            pa.array(np.full(n_docs, model.tokens), pa.int64()), pa.array(add(base)), pa.array(add(model.traversed())),
        ]
        return pa.Table.from_arrays(out, _NAMES)

    return run


_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, order: int = ORDER) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", modulus) == held_out).alias("held_out"), text.cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    units = max(1, math.ceil(total / UNIT))
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET))))
    direct = bits if bits <= DIRECT else bits // 2
    rows = rows.withColumn("train", ~F.col("held_out")).withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)))
    asks = "g long, bucket long, " + ", ".join(f"{c} binary" for c in _columns(order))
    replies = "g long, bucket long, " + ", ".join(f"n{k} binary" for k in range(1, order + 1)) + ", sums array<long>"
    asked = rows.groupBy("g").applyInArrow(_requests(order, bits, direct), asks)
    if direct == bits:
        answers = asked.groupBy("bucket").applyInArrow(_answers(order), replies)
    else:
        asked = asked.withColumn("relay", F.shiftleft(F.shiftright("g", direct), direct) + F.col("bucket"))
        sent = asked.groupBy("relay").applyInArrow(_forward(order, bits, direct), asks)
        answered = sent.groupBy("bucket").applyInArrow(_answers(order), replies).withColumnRenamed("g", "relay")
        answers = asked.groupBy("relay").cogroup(answered.groupBy("relay")).applyInArrow(_hand_back(order, bits, direct), replies)
    return rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_scores(order, bits, direct), _SCORES)


def op7_backoff_lm(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
