"""Sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

A row's number is its place in a fixed order of all rows (hash bucket, then content), from per-bucket sums: no row
is counted on one machine and the same rows get the same numbers however they are partitioned. The permuted number x
gives shard x mod S and slot x div S, so shard sizes in rows are at most one apart and slots have no gap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content_key, documents, materialize

BUCKETS = 4096
ROUNDS = 6
CHUNK = 65536


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """A permutation of 0..a*b-1: halves below a and b, each round adds a hash of the one to the other."""
    below_a, below_b = F.lit(a).cast("long"), F.lit(b).cast("long")
    right = F.pmod(x, below_b)
    state = F.struct(((x - right) / below_b).cast("long").alias("l"), right.alias("r"))

    def left_round(s: Column, k: Column) -> Column:
        return F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k), below_a), below_a).alias("l"), s["r"].alias("r"))

    def right_round(s: Column, k: Column) -> Column:
        return F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], k + 1), below_b), below_b).alias("r"))

    keys = F.array(*[F.lit(seed * 1000 + 2 * i) for i in range(ROUNDS // 2)])
    return F.aggregate(keys, state, lambda s, k: right_round(left_round(s, k), k), lambda s: s["l"] * below_b + s["r"])


def permuted(x: Column, total: int, seed: int) -> Column:
    """x's place among 0..total-1: the permutation is walked on until it comes back below ``total``."""
    a = max(1, math.isqrt(max(total - 1, 0)) + 1)
    b = max(1, -(-total // a))
    outside = a * b - total  # below a; a walk visits each of them once at most
    steps = outside if total <= 65536 else 16  # else at most 1 in 256 is outside: 2**-128 after 16 steps, and checked
    out = feistel(x, a, b, seed)
    if steps:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), out, lambda v, _: F.when(v < total, v).otherwise(feistel(v, a, b, seed)))
    return F.when(out < total, out).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """A row per document: doc_id, size, text_crc32, k1, k2 (its content) and n, its number from 0; and the number of rows.

    Equal rows are one group with a count, combined before the shuffle, and get their numbers from its range.
    """
    text, doc = F.col(text_col), F.col(id_col).cast("long")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = docs.select(doc.alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *content_key(doc, text))
    groups = rows.groupBy("doc_id", "size", "text_crc32", "k1", "k2").agg(F.count("*").alias("rows"))
    groups = materialize(groups.withColumn("bucket", F.pmod("k1", F.lit(BUCKETS)).cast("int")))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = groups.groupBy("bucket").agg(F.sum("rows").alias("in_bucket")).collect()  # BUCKETS rows at most
    start, table = 0, {}
    for row in sorted(sums):
        table[row["bucket"]] = start
        start += row["in_bucket"]
    spark = docs.sparkSession
    bases = spark.createDataFrame([(i, v) for i, v in table.items()], "bucket int, base long") if table else None
    placed = groups.withColumn("before", F.sum("rows").over(order) - F.col("rows"))
    if bases is None:
        return placed.withColumn("n", F.lit(0).cast("long")).drop("bucket", "before", "rows"), 0
    placed = placed.join(F.broadcast(bases), "bucket").withColumn("first", F.col("base") + F.col("before"))
    chunks = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(CHUNK).cast("long"))))
    out = chunks.withColumn("n", F.explode(F.transform(F.sequence(F.col("at"), F.least(F.col("at") + CHUNK, F.col("rows")) - 1), lambda i: i + F.col("first"))))
    return out.select("doc_id", "size", "text_crc32", "k1", "k2", "n"), start


def shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null), k1, k2 (its content key).

    Size is the UTF-8 bytes of the text (null: none) plus 16. Shards differ by one row at most; slots are 0, 1, ... in
    each. Equal rows, null ids and null texts are rows like others; equal rows get different slots. An empty table
    gives an empty result. Other columns are not looked at. The same rows, seed and number of shards give the same
    result under any partitioning.
    """
    rows, total = numbered(docs, id_col, text_col)
    x = rows.withColumn("x", permuted(F.col("n"), max(total, 1), seed))
    return x.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("x", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("x") / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "k1", "k2",
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> None:
    """Writes doc_id, text and slot as Parquet, a folder per shard, each sorted by slot."""
    where = shards(docs, n_shards, id_col, text_col, seed).select("k1", "k2", "shard", "slot")
    text, doc = F.col(text_col), F.col(id_col).cast("long")
    texts = docs.select(doc.alias("doc_id"), text.alias("text"), *content_key(doc, text)).dropDuplicates(["k1", "k2"])
    out = texts.join(where, ["k1", "k2"]).select("doc_id", "text", "shard", "slot")
    out.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
