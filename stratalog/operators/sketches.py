"""Bloom filter, Count-Min sketch and HyperLogLog as tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1_64, seeded_position, top_bits, trailing_zeros

#: A filter or matrix with this many cells at most is broadcast; larger ones are joined by shuffle.
BROADCAST_CELLS = 1_000_000


def _side(df: DataFrame, cells: int) -> DataFrame:
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


def bloom_params(n: int, p: float, compat: bool = False) -> tuple[int, int]:
    """(bits, hashes). ``compat`` allows no hash at all, which is what the formula gives for p of 0.5 and more."""
    if n < 1 or not 0 < p < 1:
        raise ValueError("a Bloom filter needs n of 1 or more and p between 0 and 1")
    bits = max(1, math.floor(-n * math.log(p) / math.log(2) ** 2))
    hashes = math.floor(bits / n * math.log(2))
    return bits, hashes if compat else max(1, hashes)


def bloom_build(df: DataFrame, col: str, n: int, p: float) -> DataFrame:
    """(pos): the set bits, from the distinct values of ``col``; nulls take no part."""
    bits, hashes = bloom_params(n, p)
    values = df.select(F.col(col).cast("string").alias("v")).where("v is not null").distinct()
    return values.select(F.explode(seeded_position(F.col("v"), hashes, bits)).alias("pos")).distinct()


def bloom_check(probes: DataFrame, col: str, bloom: DataFrame, n: int, p: float) -> DataFrame:
    """(value, present) for the distinct values of ``col``: present if all its bits are set."""
    bits, hashes = bloom_params(n, p)
    values = probes.select(F.col(col).cast("string").alias("value")).where("value is not null").distinct()
    spots = values.select("value", F.explode(F.array_distinct(seeded_position(F.col("value"), hashes, bits))).alias("pos"))
    hit = spots.join(_side(bloom.withColumn("set", F.lit(1)), bits), "pos", "left")
    return hit.groupBy("value").agg(F.count("*").alias("need"), F.count("set").alias("have")).select("value", (F.col("need") == F.col("have")).alias("present"))


def bloom_semi_join(rows: DataFrame, col: str, bloom: DataFrame, n: int, p: float) -> DataFrame:
    """Rows whose ``col`` may be in the filter: a pre-filter before a join; never loses a match."""
    kept = bloom_check(rows, col, bloom, n, p).where("present").select(F.col("value").alias("__v"))
    return rows.join(kept, F.col(col).cast("string") == F.col("__v"), "left_semi")


def cms_params(epsilon: float, delta: float) -> tuple[int, int]:
    """(columns, rows)."""
    if not (0 < epsilon < 1 and 0 < delta < 1):
        raise ValueError("epsilon and delta must be between 0 and 1")
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def cms_build(df: DataFrame, col: str, epsilon: float, delta: float) -> DataFrame:
    """(row, col, cnt). Equal values are counted first, so a hot value is hashed once."""
    width, depth = cms_params(epsilon, delta)
    counts = df.select(F.col(col).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    cells = counts.select("n", F.posexplode(seeded_position(F.col("v"), depth, width)).alias("row", "col"))
    return cells.groupBy("row", "col").agg(F.sum("n").alias("cnt"))


def cms_estimate(probes: DataFrame, col: str, cms: DataFrame, epsilon: float, delta: float) -> DataFrame:
    """(value, estimate): the smallest of its cells; never below the true count."""
    width, depth = cms_params(epsilon, delta)
    values = probes.select(F.col(col).cast("string").alias("value")).where("value is not null").distinct()
    spots = values.select("value", F.posexplode(seeded_position(F.col("value"), depth, width)).alias("row", "col"))
    return spots.join(_side(cms, width * depth), ["row", "col"], "left").groupBy("value").agg(F.min(F.coalesce("cnt", F.lit(0))).cast("long").alias("estimate"))


def cms_merge(*sketches: DataFrame) -> DataFrame:
    rows = sketches[0]
    for x in sketches[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def hll_precision(p: int) -> int:
    if not 4 <= p <= 16:
        raise ValueError("precision must be 4 to 16")
    return p


def hll_registers(df: DataFrame, col: str, p: int) -> DataFrame:
    """(bucket, rank), the FNV-1 form: top p bits choose the bucket, trailing zeros plus one are the rank.

    Bit-exact to the formula and therefore biased for short, similar keys: the top bits ignore the last byte. For an
    accurate count use :func:`distinct_count`.
    """
    hll_precision(p)
    values = df.select(F.col(col).cast("string").alias("v")).where("v is not null").distinct()
    h = values.select(fnv1_64("v").alias("h"))
    return h.groupBy(top_bits(F.col("h"), p).alias("bucket")).agg(F.max(trailing_zeros(F.col("h")) + 1).alias("rank"))


def hll_merge(*sketches: DataFrame) -> DataFrame:
    rows = sketches[0]
    for x in sketches[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int) -> DataFrame:
    """One row (estimate), with the small and large range corrections."""
    m = float(2 ** hll_precision(p))
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = registers.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count("*").alias("used"))
    raw = F.lit(alpha * m * m) / (F.col("s") + (F.lit(m) - F.col("used")))
    empty, top = F.lit(m) - F.col("used"), float(2**32)
    small = F.when(empty > 0, m * F.log(F.lit(m) / F.when(empty > 0, empty))).otherwise(F.col("raw"))
    large = -top * F.log(1 - F.when(F.col("raw") < top, F.col("raw")) / top)
    return sums.withColumn("raw", raw).select(F.when(F.col("raw") <= 2.5 * m, small).when(F.col("raw") > top / 30, large).otherwise(F.col("raw")).alias("estimate"))


def distinct_count(df: DataFrame, col: str, rsd: float = 0.02) -> DataFrame:
    return df.agg(F.approx_count_distinct(col, rsd).alias("estimate"))


def structures(log: DataFrame) -> DataFrame:
    """Named structures that exist, from a log of (seq, kind, name, action, argument): the last make or destroy decides.

    ``made`` is when the structure that is live now was made; elements before it belong to an older one.
    """
    acts = log.where(F.col("action").isin("make", "destroy"))
    last = acts.groupBy("kind", "name").agg(F.max_by(F.struct("action", "argument"), "seq").alias("r"), F.max("seq").alias("made"))
    return last.where(F.col("r.action") == "make").select("kind", "name", F.col("r.argument").alias("parameters"), "made")


def elements(log: DataFrame) -> DataFrame:
    """(kind, name, element) put into live structures; elements for missing ones are dropped without an error."""
    put = log.where(F.col("action") == "put").select("kind", "name", "seq", F.col("argument").alias("element"))
    return put.join(structures(log), ["kind", "name"]).where(F.col("seq") > F.col("made")).select("kind", "name", "element")
