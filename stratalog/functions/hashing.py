"""Hashes, bits and encodings as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First seed of the hash family; seeds are 32 bytes, a big-endian 4-byte number and 28 zeros.
BASE_SEED = 1
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def seed_hex(i: int) -> str:
    return f"{BASE_SEED + i:08x}" + "00" * 28


def seeded_position(value: Column, seeds: int, size: int) -> Column:
    """array<long>: for each seed the first 8 bytes of MD5(value, seed) as a big-endian number, modulo ``size``."""
    head = lambda i: F.substring(F.md5(F.concat(value.cast("binary"), F.unhex(F.lit(seed_hex(i))))), 1, 16)
    return F.array(*[(F.conv(head(i), 16, 10).cast("decimal(20,0)") % F.lit(size).cast("decimal(20,0)")).cast("long") for i in range(seeds)])


def md5_low64(word: Column) -> Column:
    """The last 8 bytes of the MD5 as a signed long."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 17, 16), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@F.pandas_udf(T.LongType())
def fnv1_64(values: pd.Series) -> pd.Series:
    """FNV-1 (multiply, then xor) of the UTF-8 bytes, its 64 bits as a signed long. ANSI mode raises on a wrapping product, so this is numpy."""
    data = [v.encode() if isinstance(v, str) else bytes(v or b"") for v in values]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    padded = np.zeros((len(data), max(int(sizes.max(initial=0)), 1)), np.uint8)
    for row, d in zip(padded, data):
        row[: len(d)] = np.frombuffer(d, np.uint8)
    h = np.full(len(data), FNV_OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(int(sizes.max(initial=0))):
            h = np.where(j < sizes, (h * np.uint64(FNV_PRIME)) ^ padded[:, j], h)
    return pd.Series(h.view(np.int64))


def top_bits(h: Column, p: int) -> Column:
    return F.call_function("shiftrightunsigned", h, F.lit(64 - p)).cast("int")


def trailing_zeros(h: Column) -> Column:
    """0 has 64; the smallest long, whose negation would overflow, has 63."""
    low = F.lit(-(2**63)).cast("long")
    return F.when(h == 0, 64).when(h == low, 63).otherwise(F.bit_count(h.bitwiseAND(-F.when(h == low, F.lit(1).cast("long")).otherwise(h)) - 1)).cast("int")


def varint_size(x: Column) -> Column:
    """Bytes of an unsigned number with 7 bits to a byte."""
    size = F.lit(10)
    for n in range(9, 0, -1):
        size = F.when(x < F.lit(2 ** (7 * n) if n < 9 else 2**63 - 1), F.lit(n)).otherwise(size)
    return size.cast("long")


def words(text: Column) -> Column:
    """Runs of letters, digits and _ (ASCII), as they are."""
    return F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))


def position_of(value: Column, seed: Column, size: Column) -> Column:
    """One position of :func:`seeded_position`, with the number of the seed and the size as columns."""
    key = F.unhex(F.concat(F.lpad(F.hex((seed + BASE_SEED).cast("long")), 8, "0"), F.lit("00" * 28)))
    head = F.substring(F.md5(F.concat(value.cast("binary"), key)), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % size.cast("decimal(20,0)")).cast("long")


def little_endian(x: Column, size: int) -> Column:
    """The ``size`` lowest bytes of a long, lowest first."""
    digits = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def from_little_endian(data: Column, start: int, size: int) -> Column:
    """The unsigned number in ``size`` bytes from byte ``start`` (0 is the first), as a long; eight bytes wrap around."""
    digits = F.hex(F.substring(data, start + 1, size))
    turned = F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)])
    return F.conv(turned, 16, -10).cast("long")
