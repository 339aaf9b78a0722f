"""Mixing, packing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from test_pairs import expected_classes

import corpus_pipeline
from orrery.llm import mixing, packing
from orrery.llm.common import written

WEIGHTS = (5, 2, 1)


def expected_targets(sizes):
    """By handing out and handing on until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * left / w for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_copies(docs, rows):
    made = mixing.copies(docs).collect()
    assert len(made) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in made:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3
    want = expected_targets(sizes)
    for r in made:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * largest[s]
    again = sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in mixing.copies(docs).collect())
    assert again == sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in made)


def test_mix_repeats_rows(docs, none):
    made, rows = mixing.copies(docs), mixing.mix(docs)
    assert rows.columns == docs.columns
    assert rows.count() == made.agg({"copies": "sum"}).first()[0]
    assert mixing.mix(none).count() == 0 and mixing.copies(none).count() == 0


def test_packing_round_trip(docs, rows, none):
    encoder = packing.Encoder(packing.default_path())
    want = {}
    for r in rows:
        ids = [*encoder.whole.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[(r[0], zlib.crc32(np.array(ids[:4096], "<u4").tobytes()))] = ids
    made = packing.packed(docs, packing.default_path()).collect()
    sequences = defaultdict(list)
    for p in made:
        sequences[p["sequence_id"]].append(p)
        ids = next(v for (i, _), v in want.items() if i == p["doc_id"] and len(v) == p["doc_tokens"] and zlib.crc32(np.array(v[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"])
        assert p["length"] <= 4096 and len(ids) == p["doc_tokens"]
    assert sum(p["length"] for p in made) == sum(len(next(v for (i, c), v in want.items() if i == r[0] and c == zlib.crc32(np.array([*encoder.whole.encode(r[1] or "", add_special_tokens=False).ids, 2][:4096], "<u4").tobytes()))) for r in rows)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert packing.packed(none, packing.default_path()).count() == 0


@pytest.mark.parametrize("text", ["It's 12 Fine-tuned, İΟΔΟΣ ẞ ﬁ", "a\x1cb\x85c d e", "<|endoftext|> and <|EndOfText|>", "﻿x ́y é", "", " \n\t"])
def test_encoder_agrees_with_the_tokenizer(text):
    e = packing.Encoder(packing.default_path())
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_plan_places_everything_with_little_waste():
    rng = np.random.default_rng(0)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(rng.lognormal(3, 1, 5000).astype(int) + 1, 128), return_counts=True), strict=True)}
    plan = packing.plan(histogram, 128)
    placed = defaultdict(int)
    for times, pattern in plan:
        assert sum(s * n for s, n in pattern.items()) <= 128
        for s, n in pattern.items():
            placed[s] += n * times
    assert dict(placed) == histogram
    assert sum(t for t, _ in plan) <= 1.01 * sum(s * n for s, n in histogram.items()) / 128 + 1
    assert packing.plan({}, 128) == []


def test_pipeline_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows, count = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = written(stage(spark, rows, str(tmp_path)), name)
        assert rows.columns == docs.columns
        if name != "mixing":
            assert rows.count() <= count
        count = rows.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_short_documents_fill_their_sequences(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["a"] * int(n))) for i, n in enumerate(rng.integers(0, 20, 3000))]
    made = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), packing.default_path()).collect()
    filled = sum(p["length"] for p in made)
    assert max(p["length"] for p in made) == 20 and len(made) == 3000
    assert len({p["sequence_id"] for p in made}) <= filled / 4096 + 2


def test_length_classes_cost_few_tokens():
    rng = np.random.default_rng(0)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(rng.lognormal(5.5, 1.2, 100_000).astype(int) + 1, 4096), return_counts=True), strict=True)}
    of = packing.length_classes(histogram)
    assert of.keys() == histogram.keys() and len(set(of.values())) <= packing.CLASSES and all(c >= s for s, c in of.items())
    assert sum((of[s] - s) * n for s, n in histogram.items()) < 0.01 * sum(s * n for s, n in histogram.items())


def removed_by_force(texts, length):
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        yield bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")


def test_pipeline_against_brute_force(spark, docs, labels, tmp_path):
    """Each stage on what the one before it kept, and `run` as a whole."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at.append(written(stage(spark, at[-1], str(tmp_path)), name))
    rows = [[(r["doc_id"], r["text"], r["source"]) for r in d.collect()] for d in at]
    # rules: none without ten words or with more than a fifth of its words in repeated windows
    for _, text, _ in rows[1]:
        words = (text or "").split()
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        count, marked = Counter(windows), set()
        for k, w in enumerate(windows):
            if count[w] > 1:
                marked.update(range(k, k + 5))
        assert len(words) >= 10 and 100 * len(marked) <= 20 * len(words)
    assert not Counter(rows[1]) - Counter(rows[0])
    # near duplicates: the least id of each class
    classes = expected_classes(rows[1])
    named = {classes[t] for _, t, _ in rows[1]} - {None}
    assert Counter(r[0] for r in rows[2] if r[0] is not None) == Counter(named) and not Counter(rows[2]) - Counter(rows[1])
    # repeated strings
    cut = removed_by_force([t.encode() for _, t, _ in rows[2]], corpus_pipeline.REPEAT_BYTES)
    assert Counter(rows[3]) == Counter((i, t, s) for (i, _, s), t in zip(rows[2], cut, strict=True))
    # mixing: whole documents, three times at most, each source near its target
    before, after = Counter(rows[3]), Counter(rows[4])
    assert set(after) <= set(before) and all(n <= 3 * before[r] for r, n in after.items())
    size = lambda t: len(t.split())
    sizes, taken = Counter(), Counter()
    for _, t, s in rows[3]:
        sizes[s] += size(t)
    for _, t, s in rows[4]:
        taken[s] += size(t)
    for s, goal in expected_targets(dict(sizes)).items():
        assert abs(taken[s] - goal) <= max(size(t) for _, t, of in rows[3] if of == s)
    # packing, after a whole run
    whole = tokenizers.Tokenizer.from_file(packing.default_path())
    tokens = {}
    for i, t, _ in rows[4]:
        tokens[i] = [*whole.encode(t, add_special_tokens=False).ids, 2]
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(p["length"] for p in made) == sum(len(tokens[i]) * n for i, n in Counter(r[0] for r in rows[4]).items())
    for p in made:
        ids = tokens[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    places = defaultdict(list)
    for p in made:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for run in places.values():
        end = 0
        for offset, length in sorted(run):
            assert offset == end
            end += length
        assert end <= 4096
