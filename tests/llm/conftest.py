import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, words string, label string, id string, key string"


def words(rng, n, vocabulary=400):
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, copies, near copies, shared passages, repeated rows and null ids."""
    rng = random.Random(3)
    passage = words(rng, 90)
    out = [(i, words(rng, rng.randrange(12, 120)), "en", "s%d" % (i % 4), 1) for i in range(40)]
    out += [(40 + i, words(rng, 30) + " " + passage + " " + words(rng, 20), "en", "s0", 1) for i in range(5)]
    base = words(rng, 200).split()
    for i in range(6):
        near = list(base)
        near[i * 7] = "changed%d" % i
        out.append((50 + i, " ".join(near), "en", "s0", 1))
    out += [(60, out[3][1], "en", "s1", 1), (61, out[3][1], None, None, None)]
    out += [(70, None, None, None, None), (71, "", "en", "s2", 0), (72, "", "en", "s2", 0), (73, "a b", "en", None, 3), (None, None, None, None, None), (None, words(rng, 50), "en", "s1", 9)]
    out += [(80, words(rng, 6000), "fr", "s3", 1), (81, "é ü\nß " * 300, "de", "s3", 1), (82, "word " * 500, "en", "s3", 1), (83, "x" * 3000, "en", "s1", 1)]
    return out + [out[5], out[5]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, rows):
    data = [(r[0], 0 if r[0] and r[0] % 3 == 0 else 1, 1 if r[0] and r[0] % 5 == 0 else 0) for r in rows] + [(1, None, None), (None, 1, 1), (1, 1, 0)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
