"""Groups of near-duplicates that need every candidate pair, against all pairs compared in plain Python."""

import random

import pytest

from stratalog.llm import simhash

SCHEMA = "doc_id long, text string"


def sets(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, least=0.8):
    """(ids that stay, pairs of different sets that are alike)."""
    s, up, pairs = [sets(t) for _, t in rows], list(range(len(rows))), []

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(s[i] & s[j]) >= least * len(s[i] | s[j]):
                up[root(i)] = root(j)
                if s[i] != s[j]:
                    pairs.append((i, j))
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(d, best.get(root(i), d))
    return sorted(best.values()), pairs


def kept(spark, rows):
    return sorted(r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def edited(rng, words, n):
    w = list(words)
    for p in rng.sample(range(len(w)), n):
        w[p] = f"e{rng.randrange(10**6)}"
    return w


@pytest.fixture(scope="module")
def rng():
    return random.Random(5)


def fresh(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_variants_alike_to_a_base_alone(spark, rng):
    base = fresh(rng, 400)
    rows = [(i, " ".join(edited(rng, base, 7))) for i in range(60)]
    rows.insert(30, (1000, " ".join(base)))
    want, pairs = brute(rows)
    assert want == [0] and len(pairs) < 0.2 * 60 * 60 / 2
    assert kept(spark, rows) == want


def test_copies_behind_another_order_of_words(spark, rng):
    base = fresh(rng, 200)
    other = base[:]
    rng.shuffle(other)
    rows = [(0, " ".join(other)), (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(edited(rng, base, 1)))]
    assert brute(rows)[0] == [0, 1] and kept(spark, rows) == [0, 1]


def test_recall_at_the_limit(spark, rng):
    """Tails cut and words replaced, so that similarities lie between 0.8 and 0.9."""
    rows = []
    for i in range(150):
        base = fresh(rng, rng.randint(100, 600))
        copy = base[: round(len(base) * 0.85)] if i % 2 else edited(rng, base, max(1, len(base) // 50))
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(copy))]
    want, pairs = brute(rows)
    got = kept(spark, rows)
    assert len(pairs) > 100 and set(got) >= set(want) and len(got) - len(want) <= 0.02 * len(pairs)


def test_limit_is_met_on_whole_texts(spark, rng):
    """Sets a little over and under 0.8, by tails of so many shingles."""
    rows = []
    for i in range(60):
        base = fresh(rng, 504)
        size = 400 if i % 2 else 398  # of 500 shingles
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base[: size + 4]))]
    want, pairs = brute(rows)
    assert len(pairs) == 30
    assert kept(spark, rows) == want
