"""Byte forms of records, filters and sketches, as column expressions; numbers are little-endian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import from_little_endian, little_endian, seed_hex
from .sketches import bloom_params, cms_params

#: Bytes of a record before its key: checksum 4, time 8, tombstone 1, key size 8, value size 8.
HEADER = 29


def record_to_bytes() -> Column:
    """The record (crc, ts, tombstone, key, value) in its plain form."""
    key, value = F.col("key").cast("binary"), F.col("value")
    mark = F.when(F.col("tombstone"), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.concat(little_endian(F.col("crc"), 4), little_endian(F.col("ts"), 8), mark, little_endian(F.octet_length(key), 8), little_endian(F.octet_length(value), 8), key, value)


def records_from_bytes(rows: DataFrame, data: str) -> DataFrame:
    """``rows`` with crc, ts, tombstone, key_size, value_size, key, value; all null where bytes are missing or left over."""
    d = F.col(data)
    sizes = {"key_size": from_little_endian(d, 13, 8), "value_size": from_little_endian(d, 21, 8)}
    fits = F.coalesce((F.octet_length(d) >= HEADER) & (F.col("key_size") >= 0) & (F.col("value_size") >= 0) & (F.octet_length(d) - HEADER - F.col("key_size") == F.col("value_size")), F.lit(False))
    wide = rows.withColumns(sizes).withColumn("fits", fits)
    own = {
        "crc": from_little_endian(d, 0, 4), "ts": from_little_endian(d, 4, 8), "tombstone": from_little_endian(d, 12, 1) != 0,
        "key": F.substring(d, F.lit(HEADER + 1), F.col("key_size").cast("int")).cast("string"), "value": F.substring(d, (F.col("key_size") + HEADER + 1).cast("int"), F.col("value_size").cast("int")),
        "key_size": F.col("key_size"), "value_size": F.col("value_size"),
    }
    return wide.select(*rows.columns, *[F.when(F.col("fits"), v).alias(k) for k, v in own.items()])


def _seeds(n: int) -> str:
    return "".join("2000000000000000" + seed_hex(i) for i in range(n))


def _long(x: int) -> str:
    return x.to_bytes(8, "little").hex()


def bloom_to_bytes(bloom: DataFrame, n: int, p: float) -> DataFrame:
    """One row (data): n, hashes, bits, the seeds, and a byte for each bit; its size is that of the filter, whatever it holds."""
    bits, hashes = bloom_params(n, p)
    at = F.array_sort(F.collect_set(F.col("pos").cast("long")))
    gaps = F.transform("at", lambda x, i: F.concat(F.repeat(F.lit("00"), (x - F.when(i == 0, F.lit(0)).otherwise(F.get("at", i - 1) + 1)).cast("int")), F.lit("01")))
    rest = F.repeat(F.lit("00"), (F.lit(bits) - F.coalesce(F.array_max("at") + 1, F.lit(0))).cast("int"))
    head = _long(n) + _long(hashes) + _long(bits) + _seeds(hashes)
    return bloom.agg(at.alias("at")).select(F.unhex(F.concat(F.lit(head), F.array_join(gaps, ""), rest)).alias("data"))


def bloom_from_bytes(rows: DataFrame, data: str = "data") -> DataFrame:
    """(pos): the set bits."""
    d = F.col(data)
    start = 24 + from_little_endian(d, 8, 8) * 40
    digits = F.hex(F.substring(d, (start + 1).cast("int"), from_little_endian(d, 16, 8).cast("int")))
    cells = F.filter(F.transform(F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")), lambda i: F.when(F.substring(digits, i * 2 + 1, F.lit(2)) != "00", i)), lambda i: i.isNotNull())
    return rows.select(F.explode(F.transform(cells, lambda i: i.cast("long"))).alias("pos"))


def cms_to_bytes(cms: DataFrame, epsilon: float, delta: float) -> DataFrame:
    """One row (data): rows, columns, the seeds, and all cells row by row."""
    width, depth = cms_params(epsilon, delta)
    cells = cms.select((F.col("row") * width + F.col("col")).cast("long").alias("nth"), "cnt")
    every = cms.sparkSession.range(width * depth).select(F.col("id").alias("nth")).join(cells, "nth", "left")
    whole = F.array_sort(F.collect_list(F.struct("nth", F.hex(little_endian(F.coalesce("cnt", F.lit(0)), 8)).alias("x"))))
    return every.agg(whole.alias("cells")).select(F.unhex(F.concat(F.lit(_long(depth) + _long(width) + _seeds(depth)), F.array_join(F.transform("cells", lambda c: c["x"]), ""))).alias("data"))
