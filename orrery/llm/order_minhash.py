"""Document fingerprints by Order MinHash, which follow the edit distance and not only the set of substrings.

The k-mers of a text, numbered by occurrence so that each is an element of its own, are hashed once and fall into
`BINS` bins by the leading bits. Each bin selects its `PICK` least elements, puts them back into the order in which
they stand in the text, and hashes that tuple to 16 bits of the signature. An empty bin takes over the tuple of a bin
that a fixed sequence of probes finds. Two signatures agree in a bin if the same k-mers stand in the same order; the
likeness is the share of such bins to the power 1 / PICK, which puts it on the scale of the share of common k-mers.

The query compares each text with its edited text and with the next document. Documents are ranged and sorted by
doc_id once; each task streams its range, and only the first and last text of each range meet in a second step.

Defined results: a null text is an empty one; two empty texts have likeness 1, an empty and another one 0; null
doc_ids sort first; rows of one doc_id are ordered by a hash of the text, equal rows follow each other; a single
document is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, U64, mix64, powers, table, written

K = 12
BITS = 6
BINS = 1 << BITS
PICK = 2
_ROUND = U64(0xD1B54A32D192ED03)
_FIRST, _SECOND = U64(0x9FB21C651E98DF25), U64(0xA0761D6478BD642F)
_EDGES = (np.arange(BINS, dtype=U64) << U64(64 - BITS)).astype(U64)
_PROBES = np.array([np.random.default_rng(j).permutation(BINS) for j in range(BINS)])


def signature(text: str, k: int = K) -> np.ndarray:
    """BINS values of 16 bits; all zero for the empty text, and never zero otherwise."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(code)
    if not n:
        return np.zeros(BINS, np.uint16)
    k = min(k, max(1, n // 8))  # short texts have shorter k-mers
    p = np.zeros(n + 1, U64)
    np.cumsum((code.astype(U64) + U64(1)) * powers(BASE, n), out=p[1:])
    h = mix64((p[k:] - p[: n - k + 1]) * powers(BASE_INV, n - k + 1))
    order = np.argsort(h, kind="stable")
    hs = h[order]
    fresh = np.append(True, hs[1:] != hs[:-1])
    if fresh.all():
        e = mix64(hs)
    else:
        index = np.arange(len(hs))
        nth = index - np.maximum.accumulate(np.where(fresh, index, 0))
        e = mix64(hs + nth.astype(U64) * _ROUND)
    if len(e) > 16 * BINS:  # elements that are low in their bin; a bin that lacks some looks at all
        low = (e << U64(BITS)) < U64(int(12 * BINS / len(e) * 2**64))
        at = _select(e[low], order[low])
        if at is not None:
            return at
    return _select(e, order, complete=True)


def _select(e: np.ndarray, pos: np.ndarray, complete: bool = False) -> np.ndarray | None:
    by = np.argsort(e)
    e, pos = e[by], pos[by]
    start = np.searchsorted(e, _EDGES)
    count = np.append(start[1:], len(e)) - start
    if not complete and (count < PICK).any():
        return None
    one, two = np.minimum(start, len(e) - 1), np.minimum(start + 1, len(e) - 1)
    swap = pos[two] < pos[one]
    a, b = np.where(swap, e[two], e[one]), np.where(swap, e[one], e[two])
    sig = np.where(count >= 2, mix64(a * _FIRST + b * _SECOND), mix64(e[one] * _FIRST))
    sig = (sig >> U64(48)).astype(np.uint16) | np.uint16(1)
    for j in np.flatnonzero(count == 0):
        sig[j] = sig[next(q for q in _PROBES[j] if count[q])]
    return sig


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean()) ** (1 / PICK)


def fingerprint(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _row(doc_id, text: str, sig: np.ndarray, following: str, next_sig: np.ndarray) -> tuple:
    other = edited(text, following)
    s = sig if other == text else signature(other)
    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, fingerprint(sig), fingerprint(s), likeness(sig, s), likeness(sig, next_sig)


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PART = _OUT + ", part int, edge string, text string"


def _batch(rows: list[tuple], extra: tuple[int, str, str] | None = None):
    cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    arrays, names = [pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], list(_NAMES)
    for name, kind, k in (("part", pa.int32(), 0), ("edge", pa.string(), 1), ("text", pa.string(), 2)):
        arrays.append(pa.array([extra[k] if extra else None] * len(rows), kind))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def _ranges(batches):
    """Results for all but the last text of a sorted range, and the texts at its edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, rows = None, []
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            sig = signature(text)
            if last is None:
                yield _batch([(doc_id, *[None] * 6)], (part, "first", text))
            else:
                rows.append(_row(*last, text, sig))
            last = (doc_id, text, sig)
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)
    if last is not None:
        yield _batch([(last[0], *[None] * 6)], (part, "last", last[1]))


def _edges(batches):
    """The last text of each range with the first one of the next range that has any; the last range goes on to the first."""
    rows = [r for b in batches for r in b.select(["part", "edge", "doc_id", "text"]).to_pylist()]
    firsts = sorted((r["part"], r["text"]) for r in rows if r["edge"] == "first")
    lasts = sorted(((r["part"], r["doc_id"], r["text"]) for r in rows if r["edge"] == "last"), key=lambda r: r[0])
    for k, (_, doc_id, text) in enumerate(lasts):
        following = firsts[(k + 1) % len(firsts)][1]
        out = _batch([_row(doc_id, text, signature(text), following, signature(following))])
        yield out.select(list(_NAMES))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how alike they and the next document are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    made = written(ranged.mapInArrow(_ranges, _PART), "fingerprints")
    inner = made.where("edge IS NULL").select(*_NAMES)
    # two rows for each range, whatever the number of documents; all tasks look for them, one puts them in order
    ends = made.where("edge IS NOT NULL").repartition(1).mapInArrow(_edges, _OUT)
    return inner.unionByName(ends)


def op9_order_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
