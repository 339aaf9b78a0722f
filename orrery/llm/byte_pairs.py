"""Byte-pair encoding of many words at once, on arrays.

For vocabularies of one form (`FORM`): normalised words fall into runs of letters, single digits, runs of other
characters and English contractions; the bytes of such a piece are merged pair by pair, always the pair that comes
first among the merges, the leftmost of equal ones. Here each round does that for thousands of pieces, one pair each.

Words that this can't decide are left to the tokenizer: those with characters that Unicode has added or put into
another category since version 3.2, or beyond the first plane, so that the tables of two libraries may not agree, and
those with a piece of more than `LONGEST` bytes.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa

LONGEST = 48
BLOCK = 1 << 13
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
LETTER, NUMBER, OTHER = 1, 2, 3  # 0: left to the tokenizer
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 18


def _kinds() -> np.ndarray:
    kinds = np.zeros(0x10001, np.uint8)
    old = unicodedata.ucd_3_2_0
    for c in map(chr, range(0x10000)):
        category = unicodedata.category(c)
        if category == old.category(c) and category not in ("Cn", "Cs", "Zs", "Zl", "Zp") and not c.isspace():
            kinds[ord(c)] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
    return kinds


def _alphabet() -> list[str]:
    """The character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class BytePairs:
    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.none = max(vocab.values()) + 1
        self.base = np.int64(self.none + 1)
        signs = _alphabet()
        self.signs = np.array([vocab[c] for c in signs] + [vocab[c + end] for c in signs], np.int32)  # within a piece, at its end
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs, self.ranks = np.full(1 << _BITS, -1, np.int64), np.full(1 << _BITS, _NONE, np.int32)
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in merges], np.int64)
        taken: dict[int, int] = {}
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while taken.setdefault(at, key) != key:
                at = (at + 1) & ((1 << _BITS) - 1)
            self.pairs[at], self.ranks[at] = key, rank
        self.kinds = _kinds()

    @classmethod
    def of(cls, path: str) -> BytePairs | None:
        """None if the file has another form."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        same = all(file.get(k) == v for k, v in FORM.items()) and all(model.get(k) == v for k, v in MODEL.items())
        if not same or not model.get("end_of_word_suffix") or not all(c in model["vocab"] and c + model["end_of_word_suffix"] in model["vocab"] for c in _alphabet()):
            return None
        return cls(model) if len(model["merges"]) < 1 << _BITS - 1 and len(model["merges"]) < 1 << 24 else None

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair of symbols among the merges."""
        key = left * self.base + right
        at = self._slot(key)
        have = self.pairs[at]
        out = self.ranks[at]
        out[have != key] = _NONE
        open_ = np.flatnonzero((have != key) & (have >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << _BITS) - 1)
            have = self.pairs[at[open_]]
            hit = have == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (have >= 0)]
        return out

    def _at(self, rank: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rank, then place, in one number."""
        return np.where(rank == _NONE, _NONE, (rank << 6) | row.astype(np.int32))

    def _merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols of pieces of about one size, a column each; `none` where there is no symbol."""
        most, n = int(size.max()), len(size)
        row = np.arange(most, dtype=np.int64)[:, None]
        byte = data[np.minimum(start + row, len(data) - 1)].astype(np.int64)
        symbol = np.full((most + 1, n), self.none, np.int32)  # the last row stands for what is before and after a piece
        symbol[:most] = np.where(row < size, self.signs[byte + 256 * (row == size - 1)], self.none)
        key = np.full((most + 1, n), _NONE, np.int32)
        if most > 1:
            key[: most - 1] = self._at(self.rank(symbol[: most - 1].ravel(), symbol[1:most].ravel()).reshape(most - 1, n), row[: most - 1])
        after = np.full((most + 1, n), most, np.int16)
        after[:most] = np.where(row + 1 < size, row + 1, most)
        before = np.full((most + 1, n), most, np.int16)
        before[1:most] = row[: most - 1]
        out, column = symbol, None
        while True:
            low = key.min(0)
            go = np.flatnonzero(low != _NONE)
            if not len(go):
                break
            if 3 * len(go) < 2 * n:  # finished pieces leave
                if column is None:
                    out, column = symbol.copy(), go
                else:
                    out[:, column] = symbol
                    column = column[go]
                symbol, key, after, before = (np.take(x, go, 1) for x in (symbol, key, after, before))
                low, n = low[go], len(go)
                go = np.arange(n)
            low = low[go]
            here_row = (low & 63).astype(np.int64)
            made = self.made[low >> 6]
            here = here_row * n + go
            s, k, a, b = symbol.ravel(), key.ravel(), after.ravel(), before.ravel()
            gone = a[here] * np.int64(n) + go
            next_row, last_row = a[gone].astype(np.int64), b[here].astype(np.int64)
            next_, last = next_row * n + go, last_row * n + go
            s[here], s[gone], k[gone] = made, self.none, _NONE
            a[here], b[next_] = next_row, here_row
            k[here] = self._at(self.rank(made, s[next_]), here_row)
            k[last] = self._at(self.rank(s[last], made), last_row)
        if column is not None:
            out[:, column] = symbol
        return out[:most]

    def merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and how many each has."""
        order = np.argsort(size, kind="stable")
        parts, counts = [], np.zeros(len(size), np.int64)
        for k in range(0, len(order), BLOCK):
            some = order[k : k + BLOCK]
            columns = self._merged(data, start[some], size[some]).T
            there = columns != self.none
            counts[some] = there.sum(1)
            parts.append(columns[there])
        flat = np.concatenate([np.zeros(0, np.int32), *parts])
        sorted_counts = counts[order]
        from_ = np.zeros(len(size), np.int64)
        from_[order] = np.cumsum(sorted_counts) - sorted_counts
        return flat[np.repeat(from_ - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))].astype("<u4"), counts

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are done here, the ids of these in order, and how many each of these has. No word may be empty
        or have white space, and all must be normalised."""
        words = words.cast(pa.large_string())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw = words.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        data, offsets = np.frombuffer(raw, np.uint8), offsets - offsets[0]
        points = np.frombuffer(raw.to_pybytes().decode().encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be"), np.uint32)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(byte_at, offsets[:-1])
        kind = self.kinds[np.minimum(points, 0x10000)]
        opens = np.zeros(len(points) + 4, bool)  # a word begins here; four more, so that looking ahead stays inside
        opens[first] = True
        opens[len(points) :] = True
        start = opens[:-3].copy()
        start[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        q = np.flatnonzero((points == ord("'")) & start[:-1])
        ahead = np.append(points, [0, 0, 0])
        one, two = np.where(opens[q + 1], 0, ahead[q + 1]), np.where(opens[q + 1] | opens[q + 2], 0, ahead[q + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[q[short | long] + 1] = False
        start[q[short] + 2] = True
        start[q[long] + 3] = True
        at = np.flatnonzero(start)  # the last is the end
        size = np.diff(byte_at[at])
        piece = np.searchsorted(at, first)
        done = np.logical_and.reduceat(kind != 0, first) & (np.maximum.reduceat(size, piece) <= LONGEST)
        each = np.diff(np.append(piece, len(size)))
        use = np.repeat(done, each)
        ids, counts = self.merged(data, byte_at[at[:-1]][use], size[use])
        ends = np.append(0, np.cumsum(counts))[np.cumsum(each[done])]
        return done, ids, np.diff(np.append(0, ends))
