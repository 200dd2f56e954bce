"""Every stage that keeps documents: columns with any names and their values, empty tables, very long texts."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.llm import decontam, lines, quality, secrets, simhash

NAMES = ["doc", "score", "row", "node", "fp", "size", "bands", "sketch", "s1", "s2", "k", "k1", "k2", "runs", "_w", "_b", "_bits", "_hit", "__row", "__fp", "__score", "__text", "__id", "__bad", "bad", "id", "a.b"]
FREQUENT = "this line stands in several documents"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    own = [prose(rng, 120) + "." for _ in range(12)]
    texts = [*own, own[0], own[1] + " more", *(f"{prose(rng, 60)}\n{FREQUENT}\n{prose(rng, 20)}" for _ in range(4)), prose(rng, 30_000), None, ""]
    return [(i, t, *(f"{n} {i}" for n in NAMES)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in NAMES)])).repartition(3).cache()


def stages(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    found = spark.createDataFrame([(3, True, "abc")], "doc_id long, is_secret boolean, finding string")
    return {
        "quality": lambda d: quality.without_low_quality(d, labels),
        "lines": lambda d: lines.without_repeated_lines(d),
        "near": lambda d: simhash.without_near_duplicates(d),
        "benchmark": lambda d: decontam.without_contaminated(d, items),
        "redact": lambda d: secrets.redact(d, found),
    }


@pytest.mark.parametrize("name", ["quality", "lines", "near", "benchmark", "redact"])
def test_columns_and_values(spark, docs, rows, name):
    out = stages(spark, docs)[name](docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = {r[0]: tuple(r) for r in out.collect()}
    want = {r[0]: r for r in rows}
    if name == "near":
        assert set(got) == set(want) - {12, 13, 20}  # the copy, the near copy, and of the null and the empty text one
    if name in ("benchmark", "lines", "redact"):
        assert set(got) == set(want)
    for i, r in got.items():
        assert r[2:] == want[i][2:]
        if name == "lines" and i in (14, 15, 16):
            assert r[1] == want[i][1].replace("\n" + FREQUENT, "")
        elif name == "redact" and i == 3:
            assert r[1] == want[i][1].replace("abc", "<SECRET>")
        else:
            assert r[1] == want[i][1]


@pytest.mark.parametrize("name", ["quality", "lines", "near", "benchmark", "redact"])
def test_empty_tables(spark, docs, name):
    none = spark.createDataFrame([], docs.schema)
    out = stages(spark, none)[name](none)
    assert out.columns == docs.columns and out.count() == 0


def test_contamination_of_a_repeated_word(spark):
    text = "word " * 20_000
    docs = spark.createDataFrame([(1, text), (2, "another " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "word " * 1_500)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontam.contamination(docs, items).collect()}
    assert got == {1: True, 2: False}


def test_sketches_lose_no_pair(spark):
    """Pairs at and over the limit pass, unlike ones mostly don't."""
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (20, 146, 1_000, 12_000):
        for share, most in ((0.8, 1.0), (0.9, 1.0), (0.5, 0.01)):
            both = round(2 * n * share / (1 + share))
            pairs = []
            for _ in range(40 if n > 5_000 else 150):
                x = rng.integers(2**64, size=2 * n - both, dtype=np.uint64)
                pairs.append((np.sort(x[:n]), np.sort(x[n - both :])))
            pairs = [(a, b) for a, b in pairs if share < 0.8 or simhash.similarity(a, b) >= 0.8]
            words = [np.stack([np.frombuffer(simhash.sketch(p[i]), np.uint64) for p in pairs]) for i in (0, 1)] if pairs else None
            if pairs:
                size = np.full(len(pairs), float(n))
                ok = simhash.may_be_alike(*words, size, size, 0.8).mean()
                assert ok == 1.0 if share >= 0.8 else (ok <= most or n < 100)
