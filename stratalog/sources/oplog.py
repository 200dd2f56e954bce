"""The operation log: making, appending, reading, verifying, segmenting, truncating and replaying it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import HEADER_BYTES, RECORD, SEGMENT_HEADER

#: Width in ``seq`` of the ranges whose sums are taken apart, so that no running sum needs all rows in one place.
RANGE = 1 << 16


def records(ops: DataFrame) -> DataFrame:
    """Complete records from (seq, ts, key, value, tombstone): checksum of the value, and sizes in bytes."""
    value = F.col("value").cast("binary")
    return ops.select(
        F.col("seq").cast("long"), F.col("ts").cast("long"), F.col("key"), value.alias("value"), F.col("tombstone"), F.crc32(value).alias("crc"),
        F.octet_length("key").cast("long").alias("key_size"), F.octet_length(value).cast("long").alias("value_size"),
    )


def from_events(events: DataFrame) -> DataFrame:
    """The log that the events are: a key per user, its value the last event, errors delete."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    value = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    return records(
        events.select(
            F.col("event_id").alias("seq"), seconds.alias("ts"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("key"),
            value.alias("value"), (F.col("event_type") == "error").alias("tombstone"),
        )
    )


def from_table(df: DataFrame, key: Column, value: Column, seq: Column) -> DataFrame:
    """A log of puts alone."""
    return records(df.select(seq.alias("seq"), seq.alias("ts"), key.cast("string").alias("key"), value.alias("value"), F.lit(False).alias("tombstone")))


def populate(spark: SparkSession, entries: int, keys: int, first_seq: int = 0) -> DataFrame:
    """A load of ``entries`` puts in turn over ``keys`` keys; a value is its key four times."""
    rows = spark.range(first_seq, first_seq + entries).select(F.col("id").alias("seq"), F.col("id").alias("ts"), (F.col("id") % keys).cast("string").alias("key"))
    return records(rows.select("seq", "ts", "key", F.repeat("key", 4).alias("value"), F.lit(False).alias("tombstone")))


def record_size() -> Column:
    return F.lit(HEADER_BYTES).cast("long") + F.col("key_size") + F.col("value_size")


def append(log: DataFrame, path: str) -> None:
    log.select(*RECORD.fieldNames()).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The log at ``path``; with ``verify`` only rows whose checksum is right (see :func:`damaged` for the others)."""
    log = spark.read.schema(RECORD).parquet(path)
    return log.where(valid()) if verify else log


def valid() -> Column:
    return F.crc32("value") == F.col("crc")


def damaged(log: DataFrame) -> DataFrame:
    return log.where(~F.coalesce(valid(), F.lit(False)))


def running(rows: DataFrame, amount: Column, name: str, order: str = "seq") -> DataFrame:
    """Adds the sum of ``amount`` over all rows before each in ``order``, which must be unique and dense enough for its ranges.

    Sums per range of ``order`` come first; only these, one row for 65,536 numbers, are summed in one place.
    """
    wide = rows.withColumns({"__amount": amount, "__range": F.floor(F.col(order) / RANGE).cast("long")})
    ranges = wide.groupBy("__range").agg(F.sum("__amount").alias("__in"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("__range", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = wide.join(starts, "__range").withColumn(name, F.col("__start") + F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    return out.drop("__amount", "__range", "__start")


def segments(log: DataFrame, segment_bytes: int) -> DataFrame:
    """Where each record of the log starts: segment (from 1) and offset in it; records go on into the next segment."""
    room = segment_bytes - SEGMENT_HEADER
    rows = running(log, record_size(), "before")
    return rows.select("seq", "key", record_size().alias("bytes"), (F.floor(F.col("before") / room) + 1).cast("long").alias("segment"), (F.pmod("before", F.lit(room)) + SEGMENT_HEADER).cast("long").alias("at"))


def batches(log: DataFrame, capacity: int) -> DataFrame:
    """Adds the batch (from 0) of each put or delete: ``capacity`` operations each, whatever their keys."""
    return running(log, F.lit(1).cast("long"), "__nth").withColumn("batch", F.floor(F.col("__nth") / capacity).cast("long")).drop("__nth")


def watermarks(log: DataFrame, capacity: int, segment_bytes: int) -> DataFrame:
    """For each batch where its first record stands in the log: (batch, seq, segment, at)."""
    first = batches(log.select("seq", "key", "key_size", "value_size"), capacity).groupBy("batch").agg(F.min("seq").alias("seq"))
    return first.join(segments(log, segment_bytes).select("seq", "segment", "at"), "seq").select("batch", "seq", "segment", "at")


def truncated(log: DataFrame, seq: int) -> DataFrame:
    """The log from ``seq`` on."""
    return log.where(F.col("seq") >= seq)


def deletions(live: DataFrame, keys: DataFrame, seq: int, ts: int) -> DataFrame:
    """Tombstones for those of ``keys`` (key, n) that are live; they keep the old value. An absent key writes nothing."""
    rows = live.join(keys, "key").select((F.lit(seq) + F.col("n")).alias("seq"), F.lit(ts).alias("ts"), "key", "value", F.lit(True).alias("tombstone"))
    return records(rows)
