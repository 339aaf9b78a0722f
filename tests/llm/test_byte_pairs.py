import random

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import byte_pairs, packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_path())


def by_tokenizer(encoder, text):
    return encoder.whole.encode(text, add_special_tokens=False).ids


def encoded(encoder, texts):
    ids, at = encoder.encode(texts)
    return [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)]


def test_made_words_are_encoded_as_by_the_tokenizer(encoder):
    r = random.Random(5)
    signs = [chr(c) for c in range(33, 0x600)] + list("''''strevmld0123abc.,-<|>") * 20 + list("一丁世́’​😀İẞΣﬁ̸힣あ")
    texts = ["".join(r.choices(signs, k=r.randint(1, 14))) for _ in range(5000)] + ["".join(r.choices("'strevmld", k=r.randint(1, 9))) for _ in range(5000)]
    texts += [c * n for c in "aé$" for n in (23, 24, 25, 47, 48, 49, 100)] + [" ".join(texts[:200]), "it's 'till ''s's we'll", "Ị̇", "ԟİ͔m"]
    assert encoded(encoder, texts) == [by_tokenizer(encoder, t) for t in texts]


@pytest.mark.parametrize("text", ["<|EndOfText|>", "x<|StartOfText|>y", "<|endoftext|≯ <|endoftext|≯"])
def test_special_tokens_in_capitals_are_text(text):
    e = packing.Encoder(packing.default_path())
    assert encoded(e, [text]) == [by_tokenizer(e, text)]


def test_plain_words_do_not_need_the_tokenizer(encoder, monkeypatch):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzéñßж", k=r.randint(1, 15))) + r.choice(["", ".", ",", "###", "'s", "12"]) for _ in range(3000)]
    want = [by_tokenizer(encoder, w) for w in words]

    class Deaf:
        pass

    e = packing.Encoder(packing.default_path())
    monkeypatch.setattr(e, "whole", Deaf())
    assert encoded(e, words) == want


def test_words_left_to_the_tokenizer():
    done, ids, counts = byte_pairs.BytePairs.of(packing.default_path()).encode(pa.array(["ab", "ԟ", "a" * 49, "😀", "c d", "é"], pa.large_string()))
    assert done.tolist() == [True, False, False, False, False, True] and len(ids) == counts.sum() and np.all(counts > 0)


def test_another_form_of_vocabulary_is_refused(tmp_path):
    with open(packing.default_path(), encoding="utf-8") as f:
        text = f.read()
    (tmp_path / "other.json").write_text(text.replace('"Lowercase"', '"NFKC"'), encoding="utf-8")
    assert byte_pairs.BytePairs.of(str(tmp_path / "other.json")) is None
