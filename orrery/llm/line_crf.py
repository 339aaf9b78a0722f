"""Quality of documents by a linear-chain conditional random field over their lines.

Every line with a word is good or bad. Its potential depends on its own features and on those of the lines before and
after it; neighbours are tied by a table of transitions. Forward-backward recursions give each line's marginal, and a
document's quality is the mean of the marginals weighted by line length, isotonically calibrated against labels.

The field is fitted to a bounded sample of `SAMPLE` training documents whose lines first bear the document's label.
Lines of bad documents that the fitted field takes for good, each by itself, are then relabelled, and the field is
fitted again. Calibration uses scores of each half of the sample by a field that was fitted to the other half.

Defined results: a text without a word, empty or null, gets the calibrated score of the share of good labels;
repeated rows score alike; a null doc_id counts as the empty string when rows are held out; without labels of both
kinds all scores are the share of good labels (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .calibration import calibrated, isotonic, labelled
from .common import table
from .toxicity import scored

SAMPLE = 8_000
MODULUS, HELD_OUT = 5, 0
BASIC = 11
OWN = 2 * BASIC
FEATURES = 3 * OWN + 3  # a line's own, those of both neighbours, a constant, and whether it is first or last

_SYMBOLS, _UPPER, _DIGITS, _STOPS = b"#*$%&<>@^~=_", bytes(range(65, 91)), b"0123456789", b".,;:?"


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Own features of each line that has a word, from 0 to 1, and the lines' lengths."""
    rows, lengths, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        b = line.encode("utf-8", "replace")
        n, size = len(words), len(line)
        bare = max(1, size - n + 1)
        count = lambda chars: len(b) - len(b.translate(None, chars))  # noqa: B023, E731
        rows.append((
            count(_SYMBOLS) / n, count(_UPPER) / bare, count(b"!") / n, count(b"|") / n, 1 - len(set(words)) / n, n / 200,
            bare / n / 20, count(_DIGITS) / bare, count(_STOPS) / n, 1.0 if line in seen else 0.0, (len(b) - size) / size,
        ))
        seen.add(line)
        lengths.append(size)
    x = np.minimum(np.array(rows, float).reshape(len(rows), BASIC), 1.0)
    return np.hstack([x, np.sqrt(x)]), np.array(lengths, float)


class Lines:
    """The lines of many documents in one table, documents with most lines first, so that the t-th lines of all that
    have as many are a prefix."""

    def __init__(self, texts: list[str]):
        found = [line_features(t) for t in texts]
        count = np.array([len(f[1]) for f in found], np.int64)
        self.order = np.argsort(-count, kind="stable")
        self.count = count[self.order]
        self.total = len(texts)
        own = np.vstack([found[k][0] for k in self.order] or [np.zeros((0, OWN))]) if len(texts) else np.zeros((0, OWN))
        self.length = np.concatenate([found[k][1] for k in self.order]) if len(texts) else np.zeros(0)
        self.start = np.append(0, np.cumsum(self.count))[:-1]
        doc = np.repeat(np.arange(len(texts)), self.count)
        first, last = np.append(True, doc[1:] != doc[:-1])[: len(doc)], np.append(doc[1:] != doc[:-1], True)[: len(doc)]
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[first], after[last] = 0, 0
        self.doc, self.first, self.last = doc, first, last
        self.x = np.hstack([own, before, after, np.ones((len(own), 1)), first[:, None], last[:, None]])

    def steps(self):
        """Places of the t-th lines, for each t."""
        for t in range(int(self.count[0]) if len(self.count) else 0):
            yield self.start[: int(np.searchsorted(-self.count, -t, "left"))] + t


class Field:
    def __init__(self):
        self.w, self.t = np.zeros(FEATURES), np.zeros((2, 2))

    def marginals(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected number of each transition."""
        u = lines.x @ self.w
        node = np.stack([np.zeros_like(u), u], 1)
        node = np.exp(node - node.max(1, keepdims=True))
        trans = np.exp(self.t - self.t.max())
        ahead, behind = np.zeros_like(node), np.ones_like(node)
        places = list(lines.steps())
        for t, at in enumerate(places):
            a = node[at] if t == 0 else (ahead[at - 1] @ trans) * node[at]
            ahead[at] = a / a.sum(1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(len(places) - 1, 0, -1):
            at = places[t]
            right = node[at] * behind[at]
            joint = ahead[at - 1][:, :, None] * trans[None] * right[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = right @ trans.T
            behind[at - 1] = b / b.sum(1, keepdims=True)
        both = ahead * behind
        return both[:, 1] / both.sum(1), pairs

    def fit(self, lines: Lines, y: np.ndarray, turns: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
        """Maximum likelihood of the labels y of lines, by Adam on all lines at once. Each document counts alike."""
        weight = 1.0 / np.maximum(lines.count, 1)
        weight = (weight / max(1, (lines.count > 0).sum()))[lines.doc]
        inner = np.flatnonzero(~lines.first)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1.0)
        n_pairs = max(1, len(inner))
        p = np.concatenate([self.w, self.t.ravel()])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for turn in range(1, turns + 1):
            self.w, self.t = p[:FEATURES], p[FEATURES:].reshape(2, 2)
            good, pairs = self.marginals(lines)
            grad = np.concatenate([((good - y) * weight) @ lines.x, ((pairs - seen) / n_pairs).ravel()]) + decay * p
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            p = p - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        self.w, self.t = p[:FEATURES], p[FEATURES:].reshape(2, 2)
        return self

    def quality(self, lines: Lines, empty: float) -> np.ndarray:
        """Length-weighted means of the marginals, in the order of the texts."""
        good, _ = self.marginals(lines)
        n = lines.total
        mass = np.bincount(lines.doc, lines.length, n)
        mean = np.bincount(lines.doc, lines.length * good, n) / np.maximum(mass, 1e-9)
        out = np.full(n, empty)
        out[lines.order[mass > 0]] = mean[mass > 0]
        return out


def _fitted(texts: list[str], y: np.ndarray) -> Field:
    lines = Lines(texts)
    label = y[lines.order][lines.doc]
    field = Field().fit(lines, label)
    alone = 1 / (1 + np.exp(-(lines.x @ field.w)))
    again = np.where((label == 0) & (alone > 0.9), 1.0, label)
    keeps_bad = np.bincount(lines.doc, again == 0, lines.total)[lines.doc] > 0
    return field.fit(lines, np.where(keeps_bad, again, label), turns=60, rate=0.05)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


class Model:
    def __init__(self, rows: list[tuple[str, int]]):
        texts, y = [r[0] for r in rows], np.array([r[1] for r in rows], float)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.field = None
        if 0 < y.sum() < len(y):
            half = np.random.default_rng(0).permutation(len(rows)) % 2
            apart = np.zeros(len(rows))
            for k in (0, 1):
                mine, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
                if 0 < y[other].sum() < len(other):
                    apart[mine] = _logit(_fitted([texts[i] for i in other], y[other]).quality(Lines([texts[i] for i in mine]), self.prior))
            self.knots = isotonic(apart, y)
            self.field = _fitted(texts, y)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.field is None or not texts:
            return np.full(len(texts), self.prior)
        return calibrated(_logit(self.field.quality(Lines(texts), self.prior)), self.knots)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return scored(docs, Model(labelled(docs, labels, "quality", MODULUS, HELD_OUT, sample)), MODULUS, HELD_OUT)


def op1_line_crf(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
