"""Isotonic calibration, and bounded samples of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of the least-squares rising step function, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order].astype(float)
    xs, first, n = np.unique(s, return_index=True, return_counts=True)
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for x, total, w in zip(xs, np.add.reduceat(y, first) if len(y) else [], n, strict=True):
        blocks.append([total, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w2, _, x2 = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += w2
            blocks[-1][3] = x2
    kx = np.array([x for b in blocks for x in (b[2], b[3])])
    ky = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return kx, ky


def calibrated(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Between the knots linear, and tilted by a thousandth of the score itself so that order survives on steps."""
    kx, ky = knots
    if not len(kx):
        return np.full(len(score), 0.5)
    tilt = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return np.clip(0.998 * np.interp(score, kx, ky) + 0.002 * tilt, 0.0, 1.0)


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, n: int) -> list[tuple[str, int]]:
    """(text, label) of at most n training documents, those of the least hash of doc_id; rows without a label or an
    id are left out, and of several labels or texts for one id the least counts."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", modulus) != held_out))
    ids = ids.groupBy("doc_id").agg(F.min(label).alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__label").alias("__label"))
    return sorted((r["text"], int(r["__label"])) for r in one.select("text", "__label").toLocalIterator())
