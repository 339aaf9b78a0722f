"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of two lexicons, how near second-person words stand to lexicon words, and rates of capitals,
punctuation and obfuscation. The lexicons are learned from the training texts: words, and beginnings of words, that
stand in toxic texts far more often than in others. Words are compared in a plain form: lower case, with digits and
signs that replace letters put back, and doubled letters made single; a word that matches in its plain form only is
obfuscated. Trees are fitted to a bounded sample of `SAMPLE` training documents. Each half of them
gets its features from the other half's lexicons, so that trees see words as they meet them in new texts, and its
scores for calibration from the other half's trees.

Defined results: empty and null texts get the score of a text without features; repeated rows score alike; a null
doc_id counts as the empty string when rows are held out; without labels of both kinds all scores are the share of
toxic labels (0.5 without any); columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import calibrated, isotonic, labelled
from .common import crc_mod, table

SAMPLE = 8_000
THRESHOLD = 0.3
MODULUS, HELD_OUT = 4, 2
STEM = 5

# Second-person words of the four languages of the documents.
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus vosotros".split())
# Signs that often replace letters.
REPLACED = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"})
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_DOUBLE = re.compile(r"(.)\1+")


def plain(word: str) -> str:
    w = _TRIM.sub("", word.lower())
    if not w.isalpha():
        w = _INNER.sub("", w.translate(REPLACED))
    return _DOUBLE.sub(r"\1", w)

FEATURES = (
    "word_weight", "stem_weight", "word_density", "stem_density", "top_word", "top_stem", "distinct_hits", "near_you",
    "near_you_density", "you_density", "obfuscated", "log_words", "capitals", "punctuation", "signs_in_words",
)


class Lexicons:
    """Weights of whole words and of beginnings, and per distinct word what it matches."""

    def __init__(self, texts: list[str], labels: np.ndarray, least: int = 3, ratio: float = 8.0):
        self.seen: dict[str, tuple[float, float, bool, bool]] = {}
        bad, good = Counter(), Counter()
        stems_bad, stems_good = Counter(), Counter()
        for text, label in zip(texts, labels, strict=True):
            words = {plain(w) for w in text.split()}
            stems = {w[:STEM] for w in words if len(w) >= STEM}
            (bad if label else good).update(words)
            (stems_bad if label else stems_good).update(stems)
        p, n = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
        self.words = self._pick(bad, good, p, n, least, ratio)
        self.stems = self._pick(stems_bad, stems_good, p, n, least, ratio)

    @staticmethod
    def _pick(bad: Counter, good: Counter, p: int, n: int, least: int, ratio: float) -> dict[str, float]:
        out = {}
        for w, c in bad.items():
            odds = ((c + 0.5) / (p + 1)) / ((good[w] + 0.5) / (n + 1))
            if w and c >= least and odds >= ratio:
                out[w] = float(np.log(odds))
        return out

    def look(self, word: str) -> tuple[float, float, bool, bool]:
        """(word weight, stem weight, obfuscated, second person)"""
        got = self.seen.get(word)
        if got is None:
            w = plain(word)
            by_word, by_stem = self.words.get(w, 0.0), self.stems.get(w[:STEM], 0.0)
            surface = _DOUBLE.sub(r"\1", _TRIM.sub("", word.lower()))
            got = by_word, by_stem, bool(by_word or by_stem) and surface != w, w in SECOND_PERSON
            if len(self.seen) > 400_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def features(self, text: str) -> list[float]:
        words = text.split()
        n = max(1, len(words))
        look = self.look
        found = [look(w) for w in words]
        hits = [k for k, f in enumerate(found) if f[0] or f[1]]
        by_word = [found[k][0] for k in hits]
        by_stem = [found[k][1] for k in hits]
        you = np.array([k for k, f in enumerate(found) if f[3]])
        near = 0.0
        if len(you) and hits:
            after = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(hits - you[np.minimum(after, len(you) - 1)]), np.abs(hits - you[np.maximum(after - 1, 0)]))
            near = float((1.0 / (1.0 + gap)).sum())
        chars = max(1, len(text))
        return [
            sum(by_word), sum(by_stem), sum(by_word) / n, sum(by_stem) / n, max(by_word, default=0.0), max(by_stem, default=0.0),
            float(len({words[k].lower() for k in hits})), near, near / n, len(you) / n, float(sum(found[k][2] for k in hits)), float(np.log1p(n)),
            len(_UPPER.findall(text)) / chars, len(_PUNCTUATION.findall(text)) / chars, len(_SIGNS.findall(text)) / n,
        ]


_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PUNCTUATION = re.compile(r"[!?*#@$%&]")
_SIGNS = re.compile(r"\w[@$*!|0-9]\w")


class Trees:
    """Gradient boosting of small trees for the logistic loss, on features cut into at most 64 ranges."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.12, penalty: float = 2.0, leaf: float = 3.0):
        self.rounds, self.depth, self.rate, self.penalty, self.leaf = rounds, depth, rate, penalty, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.cuts = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, 63)[:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(cut, c, "right") for cut, c in zip(self.cuts, x.T, strict=True)], 1)
        score = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(codes, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._apply(tree, codes)
        return self

    def _grow(self, codes, g, h) -> list[tuple]:
        """Nodes (feature, code, left, right, value); feature -1: a leaf."""
        nodes: list[tuple] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(())
            gs, hs = g[rows].sum(), h[rows].sum()
            value = -self.rate * gs / (hs + self.penalty)
            best = (1e-6, -1, 0)
            if depth and len(rows) > 1:
                for k in range(codes.shape[1]):
                    c = codes[rows, k]
                    size = len(self.cuts[k]) + 1
                    gl, hl = np.cumsum(np.bincount(c, g[rows], size))[:-1], np.cumsum(np.bincount(c, h[rows], size))[:-1]
                    ok = (hl >= self.leaf / 8) & (hs - hl >= self.leaf / 8)
                    gain = np.where(ok, gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty), 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), k, int(gain.argmax()))
            if best[1] < 0:
                nodes[at] = (-1, 0, 0, 0, value)
                return at
            right = codes[rows, best[1]] > best[2]
            a, b = grow(rows[~right], depth - 1), grow(rows[right], depth - 1)
            nodes[at] = (best[1], best[2], a, b, 0.0)
            return at

        grow(np.arange(len(g)), self.depth)
        return nodes

    @staticmethod
    def _apply(tree: list[tuple], codes: np.ndarray) -> np.ndarray:
        feature, code, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(codes), np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            go = codes[np.arange(len(codes)), np.maximum(feature[at], 0)] > code[at]
            at = np.where(inner, np.where(go, right[at], left[at]), at)

    def decision(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(cut, c, "right") for cut, c in zip(self.cuts, x.T, strict=True)], 1)
        return self.start + sum(self._apply(t, codes) for t in self.trees)


class Model:
    def __init__(self, rows: list[tuple[str, int]]):
        y = np.array([r[1] for r in rows], float)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.lexicons = None
        if 0 < y.sum() < len(y):
            # each half's features come from the other half's lexicons, and its calibration from the other half's trees
            texts = [r[0] for r in rows]
            half = np.random.default_rng(0).permutation(len(rows)) % 2
            x = np.zeros((len(rows), len(FEATURES)))
            for k in (0, 1):
                other = Lexicons([t for t, z in zip(texts, half, strict=True) if z != k], y[half != k])
                for i in np.flatnonzero(half == k):
                    x[i] = other.features(texts[i])
            apart = np.zeros(len(rows))
            for k in (0, 1):
                apart[half == k] = Trees().fit(x[half != k], y[half != k]).decision(x[half == k])
            self.knots = isotonic(apart, y)
            self.trees = Trees().fit(x, y)
            self.lexicons = Lexicons(texts, y)
            self.lexicons.seen.clear()

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.lexicons is None or not texts:
            return np.full(len(texts), self.prior)
        return calibrated(self.trees.decision(np.array([self.lexicons.features(t) for t in texts])), self.knots)


def scorer(shared, threshold: float):
    """Scores of (doc_id, held_out, text) batches by a model with scores()."""

    def run(batches):
        model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                s = model.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"],
                )

    return run


def scored(docs: DataFrame, model, modulus: int, held_out: int, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted; the model, of a size that its sample bounds, goes to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", modulus) == held_out).alias("held_out"), text.alias("text"))
    return rows.mapInArrow(scorer(shared, threshold), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return scored(docs, Model(labelled(docs, labels, "toxic", MODULUS, HELD_OUT, sample)), MODULUS, HELD_OUT)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
