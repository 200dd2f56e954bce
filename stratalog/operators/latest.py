"""Current state of a log: latest version wins, tombstones hide; lookups, scans with pages, cursors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Row
from pyspark.sql import functions as F

#: Keys with white space inside belong to named structures, not to users.
SYSTEM_KEY = r"\s.+$"


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each key by (ts, seq), tombstones included.

    One aggregation with partial sums before the shuffle, so a hot key costs a row per task. Predicates on the key pass
    below it to the scan; those on value or tombstone must stay above.
    """
    newest = F.max_by(F.struct("seq", "ts", "value", "tombstone", "crc", "key_size", "value_size"), F.struct("ts", "seq"))
    return log.groupBy("key").agg(newest.alias("r")).select("r.seq", "r.ts", "key", "r.value", "r.tombstone", "r.crc", "r.key_size", "r.value_size")


def live(log: DataFrame) -> DataFrame:
    return latest(log).where(~F.col("tombstone"))


def namespace(key: Column) -> Column:
    """What a key belongs to: "user" or the kind of a named structure."""
    kind = F.regexp_extract(key, r"^(bf|cms|hll|fingerprint|tokenLog) ", 1)
    return F.when(kind != "", kind).otherwise(F.lit("user"))


def user_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("key").rlike(SYSTEM_KEY))


def get(log: DataFrame, *keys: str) -> DataFrame:
    """(key, value) of those keys that are live. The key filter reaches the scan."""
    return live(log.where(F.col("key").isin(*keys))).select("key", "value")


def prefix(log: DataFrame, start: str) -> DataFrame:
    return user_rows(live(log.where(F.col("key").startswith(start))))


def key_range(log: DataFrame, low: str, high: str) -> DataFrame:
    """Both ends belong to it."""
    return user_rows(live(log.where(F.col("key").between(low, high))))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of (key, value) in key order. Page or size 0 and pages past the end are empty."""
    ordered = rows.select("key", "value").orderBy("key")
    if number < 1 or size < 1:
        return ordered.limit(0)
    return ordered.offset((number - 1) * size).limit(size)


def pages(rows: DataFrame, size: int) -> DataFrame:
    """All rows with page and place on it (both from 1).

    Places come from a range partitioning by key and the partitions' counts, so rows are never gathered.
    """
    from ..sources.scratch import materialize

    ordered = rows.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").withColumn("__id", F.monotonically_increasing_id())
    ordered = materialize(ordered).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = sorted((r["__part"], r["n"]) for r in ordered.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row per partition
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    base = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    nth = F.col("__start") + F.col("__at")
    return ordered.join(F.broadcast(base), "__part").select("key", "value", (F.floor(nth / size) + 1).cast("long").alias("page"), (F.pmod(nth, F.lit(size)) + 1).cast("long").alias("place"))


def prefix_scan(log: DataFrame, start: str, number: int, size: int) -> DataFrame:
    return page(prefix(log, start), number, size)


def range_scan(log: DataFrame, low: str, high: str, number: int, size: int) -> DataFrame:
    return page(key_range(log, low, high), number, size)


class Cursor:
    """Goes through (key, value) in key order; rows come partition by partition, never all at once."""

    def __init__(self, rows: DataFrame):
        self._rows: Iterator[Row] | None = rows.select("key", "value").orderBy("key").toLocalIterator()

    def next(self) -> Row | None:
        """The next row; None at the end and after :meth:`stop`."""
        return next(self._rows, None) if self._rows is not None else None

    def stop(self) -> None:
        self._rows = None


def prefix_iterate(log: DataFrame, start: str) -> Cursor:
    return Cursor(prefix(log, start))


def range_iterate(log: DataFrame, low: str, high: str) -> Cursor:
    return Cursor(key_range(log, low, high))
