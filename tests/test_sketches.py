"""Sketches, fingerprints, Merkle trees and encodings against plain Python."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import hashing
from stratalog.operators import fingerprints, merkle, sketches


def test_bloom(spark):
    assert sketches.bloom_params(1000, 0.1) == (4792, 3) and sketches.bloom_params(100, 0.01) == (958, 6) and sketches.bloom_params(1, 0.1) == (4, 2)
    assert sketches.bloom_params(1000, 0.5, compat=True) == (1442, 0) and sketches.bloom_params(1000, 0.5)[1] == 1
    for bad in ((0, 0.1), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            sketches.bloom_params(*bad)
    rows = spark.createDataFrame([(f"k{i}",) for i in range(100)] + [(None,)], "v string")
    bloom = sketches.bloom_build(rows, "v", 100, 0.01)
    bits = {int.from_bytes(hashlib.md5(f"k{i}".encode() + bytes.fromhex(hashing.seed_hex(j))).digest()[:8], "big") % 958 for i in range(100) for j in range(6)}
    assert {r.pos for r in bloom.collect()} == bits
    probes = spark.createDataFrame([(f"k{i}",) for i in range(300)], "v string")
    got = {r.value: r.present for r in sketches.bloom_check(probes, "v", bloom, 100, 0.01).collect()}
    assert all(got[f"k{i}"] for i in range(100)) and sum(got.values()) < 115


def test_cms(spark):
    assert sketches.cms_params(0.1, 0.1) == (28, 3) and sketches.cms_params(0.01, 0.01) == (272, 5)
    rows = spark.createDataFrame([(f"k{i % 10}",) for i in range(100)] + [("hot",)] * 50, "v string")
    halves = [rows.where(c) for c in ("v = 'hot'", "v <> 'hot'")]
    whole, joined = sketches.cms_build(rows, "v", 0.01, 0.01), sketches.cms_merge(*[sketches.cms_build(h, "v", 0.01, 0.01) for h in halves])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, joined.collect()))
    got = {r.value: r.estimate for r in sketches.cms_estimate(rows, "v", whole, 0.01, 0.01).collect()}
    assert got["hot"] >= 50 and all(got[f"k{i}"] >= 10 for i in range(10))


def fnv(data: bytes) -> int:
    h = hashing.FNV_OFFSET
    for b in data:
        h = (h * hashing.FNV_PRIME) % 2**64 ^ b
    return h


def test_fnv_and_hll(spark):
    words = ["a", "", "héllo", "x" * 40]
    rows = spark.createDataFrame([(w,) for w in words], "v string")
    got = {r.v: r.h % 2**64 for r in rows.select("v", hashing.fnv1_64("v").alias("h")).collect()}
    assert got == {w: fnv(w.encode()) for w in words} and got["a"] == 0xAF63BD4C8601B7BE
    for p in (3, 17, 260):
        with pytest.raises(ValueError):
            sketches.hll_registers(rows, "v", p)
    numbers = spark.range(10000).selectExpr("cast(id as string) v")
    assert round(sketches.hll_estimate(sketches.hll_registers(numbers, "v", 10), 10).first()[0]) == 18
    assert sketches.hll_estimate(sketches.hll_registers(numbers.limit(0), "v", 10), 10).first()[0] == 0


def test_bits(spark):
    rows = spark.createDataFrame([(0,), (1,), (8,), (-1,), (-(2**63),), (96,)], "h long")
    got = {r.h: (r.t, r.z) for r in rows.select("h", hashing.top_bits(rows.h, 4).alias("t"), hashing.trailing_zeros(rows.h).alias("z")).collect()}
    assert got == {0: (0, 64), 1: (0, 0), 8: (0, 3), -1: (15, 0), -(2**63): (8, 63), 96: (0, 5)}
    sizes = spark.createDataFrame([(0,), (127,), (128,), (2**14 - 1,), (2**14,), (2**32,)], "x long")
    assert [r[0] for r in sizes.select(hashing.varint_size(sizes.x)).collect()] == [1, 1, 2, 2, 3, 5]
    pair = spark.createDataFrame([(5, 3)], "a long, b long")
    assert pair.select(hashing.hamming(pair.a, pair.b)).first()[0] == 2


def plain_fingerprint(text: str) -> int:
    import re

    sums = [0] * 63
    for w in re.findall(r"\w+", text, re.ASCII):
        if w not in fingerprints.STOP_WORDS:
            low = int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "big")
            for i in range(63):
                sums[i] += 1 if low >> i & 1 else -1
    return sum(2 ** (i + 1) for i in range(63) if sums[i] >= 0)


def test_fingerprints(spark):
    texts = {1: "", 2: "the and", 3: "The and", 4: "to be or not to be that is the question", 5: "one two two three", 6: "naïve café"}
    got = {r.id: r.fp % 2**64 for r in fingerprints.fingerprint(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text").collect()}
    assert got == {i: plain_fingerprint(t) for i, t in texts.items()}
    assert got[1] == got[2] == 2**64 - 2 and got[3] != got[2]


def plain_root(leaves: list[bytes]) -> bytes:
    while len(leaves) & len(leaves) - 1:
        leaves = [*leaves, bytes(20)]
    while len(leaves) > 1:
        leaves = [hashlib.sha1(a + b).digest() for a, b in zip(leaves[::2], leaves[1::2])]
    return leaves[0]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 11])
def test_merkle(spark, n):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"r{i}") for i in range(n)], "i long, v string")
    tree = merkle.build(merkle.leaves(rows, F.col("v"), "i"))
    root = bytes(merkle.root(tree).first()["hash"])
    assert root == plain_root([hashlib.sha1(f"r{i}".encode()).digest() for i in range(n)])
    if n == 4:
        assert root.hex().upper() == "26D7341C7C93AF8395D6DD2A118F855D6DCD74F5"
        assert [(r.level, r.pos) for r in merkle.serialized(tree).collect()] == [(2, 0), (1, 0), (0, 0), (0, 1), (1, 1), (0, 2), (0, 3)]
    changed = rows.withColumn("v", F.when(F.col("i") == n - 1, F.lit("other")).otherwise(F.col("v")))
    assert bytes(merkle.root(merkle.build(merkle.leaves(changed, F.col("v"), "i"))).first()["hash"]) != root
    assert [r.i for r in merkle.incorrect(changed, F.col("v"), tree).collect()] == [n - 1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=60), st.integers(1, 4), st.integers(1, 60))
def test_take_against_a_loop(times, capacity, cooldown):
    import numpy as np

    from stratalog.operators.limits import take

    times = sorted(times)
    start, tokens, want = 0, capacity, []
    for t in times:
        if t > start + cooldown:
            start, tokens = t, capacity
        want.append(tokens > 0)
        tokens = max(tokens - 1, 0)
    state, allowed, _ = take((0, capacity), np.array(times, np.int64), capacity, cooldown)
    assert allowed.tolist() == want and state == (start, tokens)


def test_proofs(spark):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(300)], "id long, t string")
    leaves = merkle.leaves(rows, F.col("t"), "id")
    paths = merkle.proofs(leaves, merkle.build(leaves))
    sha = lambda b: hashlib.sha1(b).digest()
    by = {}
    for r in sorted(paths.collect(), key=lambda r: r.nth):
        by.setdefault(r.pos, []).append(bytes(r.hash))
    assert len(by) == 300 and len({p[0] for p in by.values()}) == 1
    for pos, (top, *beside) in by.items():
        own, at = sha(f"r{pos}".encode()), pos
        for x in reversed(beside):
            own, at = sha(x + own if at % 2 else own + x), at // 2
        assert own == top
    wrong = leaves.withColumn("hash", F.when(F.col("pos") == 7, F.unhex(F.lit("00" * 20))).otherwise(F.col("hash")))
    assert {r.pos for r in merkle.proven(wrong, paths).collect()} == set(range(300)) - {7}
