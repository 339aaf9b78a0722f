"""Helpers that the operators of this subpackage share.

Words, wherever an operator splits text into them, are maximal runs of characters other than space
and U+0009 to U+000D.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: White space as Python's bytes.split() sees it is the same set as in WORD.
SPACES = " \t\n\x0b\x0c\r"

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where the session names none, a local session gets one of its own, and a
    cluster an error: its executors would write to disks that the others don't see."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-checkpoint-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends there, and any executor
    can be lost without computing it anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what `written` wrote, for tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_written", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Gives back to the system what earlier tasks of this Python worker left with its allocators."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(col: str, n: int):
    """crc32 of the column as text, modulo n; null counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64 values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """uint64 values as doubles in (0, 1]."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * (1.0 / 9007199254740992.0)


#: Odd multiplier of the polynomial hash over bytes, its inverse modulo 2**64, and the powers of both as far as needed.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i], times BASE_INV**i, the hash of bytes i to j."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def byte_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column without nulls, and the n + 1 offsets of its rows."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int):
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end
        start = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each row, in order, and the n + 1 offsets of the rows in words."""
    word = ~_SPACE[data]
    start = word.copy()
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    before = word[:-1].copy()
    if len(inner):
        before[inner[inner > 0] - 1] = False
    start[1:] &= ~before
    starts = np.flatnonzero(start)
    after = np.append(~word[1:], True) if len(word) else word
    if len(inner):
        after[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(word & after) + 1
    p = prefix_hash(data)
    h = (p[ends] - p[starts]) * powers(BASE_INV, len(data) + 1)[starts]
    return mix64(h + (ends - starts).astype(U64)), np.searchsorted(starts, offsets)
