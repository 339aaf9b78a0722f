"""Near-duplicate classes, repeated strings and fingerprints against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import minhash, order_minhash, suffix_dedup
from orrery.llm.graph import components
from orrery.llm.suffix_array import common_prefixes, suffix_array


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected_classes(rows):
    """Class by text: the least doc_id of all texts that links connect."""
    ids = defaultdict(list)
    for i, t, *_ in rows:
        if t is not None:
            ids[t].append(i)
    texts = list(ids)
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingle_set(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for k, t in enumerate(texts):
        least[top(k)] += [i for i in ids[t] if i is not None]
    return {t: min(least[top(k)], default=None) for k, t in enumerate(texts)}


def test_classes_against_brute_force(docs, rows):
    want = expected_classes(rows)
    got = Counter(tuple(r) for r in minhash.classes(docs).collect())
    assert got == Counter((i, i if t is None else want[t]) for i, t, *_ in rows)


def test_chains_and_groups_under_the_threshold(spark):
    """Links that no hub has, and a group of copies that are alike but mostly under the threshold."""
    rng = random.Random(7)
    base = ["b%d" % rng.randrange(5000) for _ in range(120)]
    rows = []
    for i in range(40):
        t = list(base)
        for k in rng.sample(range(120), 5):
            t[k] = "x%d_%d" % (i, k)
        rows.append((i, " ".join(t)))
        t[0] = "y%d" % i
        rows.append((100 + i, " ".join(t)))  # a near copy of the copy
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = expected_classes(rows)
    assert got == {i: want[t] for i, t in rows}


def test_deduplicated_keeps_one_of_each_class(docs, rows):
    want = expected_classes(rows)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    expected = {want[t] for _, t, *_ in rows if t is not None and want[t] is not None} | {i for i, t, *_ in rows if t is None and i is not None}
    assert {i for i in ids if i is not None} == expected and all(n == 1 for i, n in ids.items() if i is not None)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    n, m = 300, 1024
    ids = minhash.mix64(np.arange(400, dtype=np.uint64))
    a, b = ids[:n], ids[100:]
    w = 1 + rng.random(400)
    regs = minhash.registers(np.repeat([0, 1], n), np.concatenate([a, b]), np.concatenate([w[:n], w[100:]]), 2, m)
    wa, wb = np.append(w[:n], np.zeros(100)), np.append(np.zeros(100), w[100:])
    exact = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in range(100, 300))
    assert abs((regs[0] == regs[1]).mean() - exact) < 0.06


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("alphabet", [1, 2, 4, 250])
def test_suffix_array_and_prefixes(alphabet):
    rng = np.random.default_rng(alphabet)
    for _ in range(40):
        n = int(rng.integers(1, 80))
        data = rng.integers(0, alphabet, n).astype(np.uint8)
        b = data.tobytes()
        order = suffix_array(data, 10**6)
        assert list(order) == sorted(range(n), key=lambda i: b[i:])
        _, common = common_prefixes(data, order, n - np.arange(n), np.arange(n) > 0)
        for i, j in zip(order[1:], order[:-1], strict=True):
            k = 0
            while max(i, j) + k < n and b[i + k] == b[j + k]:
                k += 1
            assert common[i] == k


def expected_removal(texts, length):
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        yield len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("most", [1500, 1])
def test_removal_against_brute_force(docs, rows, most, monkeypatch):
    whole = suffix_dedup.spans
    monkeypatch.setattr(suffix_dedup, "spans", lambda d: whole(d, most=most))
    out = suffix_dedup.with_spans(docs).selectExpr("doc_id", "__bytes AS text", "__spans AS spans")
    got = Counter(tuple(r) for r in out.mapInArrow(suffix_dedup._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string").drop("text").collect())
    texts = [(r[1] or "").encode() for r in rows]
    assert got == Counter((r[0], *e) for r, e in zip(rows, expected_removal(texts, 400), strict=True))


def test_passages_of_over_fifty_words(spark, docs, rows, tmp_path):
    """Passages below the contract's 400 bytes go in columns of their own; the contract's columns stay as they were."""
    rng = random.Random(8)
    words = lambda n: " ".join("w%d" % rng.randrange(400) for _ in range(n))
    passage = words(56)
    assert suffix_dedup.PASSAGE < len(passage) < suffix_dedup.LENGTH
    more = [(900 + i, words(30) + " " + passage + " " + words(30)) for i in range(3)]
    whole = [(r[0], r[1]) for r in rows] + more
    docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    out = suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()
    texts = [(t or "").encode() for _, t in whole]
    cut = lambda k: [(n, h) for _, n, _, h in expected_removal(texts, k)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter((r["doc_id"], r["n_removed"], r["kept_sha256"], r["n_passage_bytes"]) for r in out)
    assert got == Counter((i, n, h, m) for (i, _), (n, h), (m, _) in zip(whole, cut(400), cut(240), strict=True))
    ascii_ = {i for i, t in whole if (t or "").isascii()}
    short = Counter((i, h) for (i, _), (_, h) in zip(whole, cut(240), strict=True) if i in ascii_)
    assert Counter((r["doc_id"], sha(r["passage_text"])) for r in out if r["doc_id"] in ascii_) == short
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] >= 900:
            assert passage in r["text"] and passage not in r["passage_text"] and r["n_removed"] == 0


@pytest.mark.parametrize("most", [1500, 1])
def test_longer_strings_within_shorter_ones(spark, most):
    """Few symbols, so that repeated strings of all lengths overlap and touch; one text in three rows."""
    rng = random.Random(most)
    rows = [(i, "".join(rng.choice("ab") * rng.randrange(1, 4) for _ in range(rng.randrange(200)))) for i in range(60)]
    rows += [(100 + i, rows[i][1][i : 40 + i] + rows[i + 1][1]) for i in range(20)] + [rows[0]] * 2
    made = spark.createDataFrame(rows, "doc_id long, text string")
    shorter = suffix_dedup.spans(made, length=16, gram=5, most=most)
    found = suffix_dedup.spans(made, length=24, gram=8, most=most, within=(16, shorter))
    marks = {}
    for r in found.collect():
        marks.setdefault(r["id"], set()).update(range(r["from"], r["to"]))
    for (i, text), (_, n, _, _) in zip(rows, expected_removal([t.encode() for _, t in rows], 24), strict=True):
        assert len(marks.get(i, ())) == n, (i, text)


def test_deduplicated_text_is_whole_characters(docs, rows):
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[70]["text"] is None and by[81]["text"].strip() in ("", by[81]["text"].strip()) and by[81]["n_chars"] == len(by[81]["text"])


def test_fingerprints(docs, rows):
    got = [r.asDict() for r in order_minhash.fingerprints(docs).collect()]
    assert len(got) == len(rows)
    plain = sorted((r for r in rows if r[0] is not None and r[0] != 5), key=lambda r: r[0])
    by = {r["doc_id"]: r for r in got}
    for a, b in zip(plain, plain[1:], strict=False):
        if a[0] == 4 or a[0] is None:
            continue
        t, nxt = a[1] or "", b[1] or ""
        m = len(t) // 4
        e = t[: len(t) - m] + nxt[:m]
        r = by[a[0]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == order_minhash.fingerprint(order_minhash.signature(t))
        assert r["near_edited"] == pytest.approx(order_minhash.likeness(order_minhash.signature(t), order_minhash.signature(e)))
        assert r["near_next"] == pytest.approx(order_minhash.likeness(order_minhash.signature(t), order_minhash.signature(nxt)))
    assert by[60]["fingerprint"] == by[3]["fingerprint"]


def test_order_matters():
    rng = random.Random(1)
    w = ["q%d" % rng.randrange(9000) for _ in range(300)]
    a = order_minhash.signature(" ".join(w))
    near = order_minhash.likeness(a, order_minhash.signature(" ".join(w[:280] + w[295:])))
    shuffled = order_minhash.likeness(a, order_minhash.signature(" ".join(w[150:] + w[:150])))
    other = order_minhash.likeness(a, order_minhash.signature(" ".join(reversed(w))))
    assert near > shuffled > other


def test_empty_tables(none):
    assert minhash.classes(none).count() == 0
    assert minhash.deduplicated(none).count() == 0
    assert suffix_dedup.with_spans(none).count() == 0
    assert order_minhash.fingerprints(none).count() == 0


def test_links_in_a_single_open_bucket(spark, monkeypatch):
    """Pairs that share one bucket only, with other documents in it, so that no hub has them."""
    rng = random.Random(11)
    rows = [(i, " ".join("v%d" % rng.randrange(10**6) for _ in range(60))) for i in range(20)]
    for i in range(2, 16, 2):
        rows[i + 1] = (i + 1, rows[i][1] + " end")
    one = lambda docs: docs.selectExpr("doc_id", "unhex(md5(text)) AS node", "array(7L) AS bands")
    monkeypatch.setattr(minhash, "signatures", one)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = expected_classes(rows)
    assert got == {i: want[t] for i, t in rows} and len(set(got.values())) == 13


def test_repeated_shingles_cost_few_shared_bands():
    """Pairs of set Jaccard 0.8 whose unshared shingles are all repeated."""
    rng = random.Random(5)
    texts = []
    for k in range(100):
        shared = " ".join("s%d" % rng.randrange(10**9) for _ in range(124))
        texts += [" ".join([shared, *["%s%d_%d" % (side, k, j) for j in range(11)] * 40]) for side in "ab"]
    a, b = shingle_set(texts[0]), shingle_set(texts[1])
    assert len(a & b) == 0.8 * len(a | b)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([b""] * 200), pa.array([t.encode() for t in texts])], ["doc_id", "node", "text"])
    bands = [r for out in minhash._signatures([batch]) for r in out.column("bands").to_pylist()]
    assert sum(len(set(x) & set(y)) for x, y in zip(bands[::2], bands[1::2], strict=True)) / 100 > 24 * 0.75**4
