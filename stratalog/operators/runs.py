"""Sorted runs of a log, their manifest, indexes and sizes, and which of them a lookup needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_position, varint_size
from ..sources.oplog import batches, record_size
from ..sources.scratch import materialize
from .sketches import bloom_params

RUN_COLUMNS = ["level", "run_id", "seq", "ts", "key", "value", "tombstone", "crc", "key_size", "value_size"]


def newest_in(rows: DataFrame, *within: str) -> DataFrame:
    """The newest version of each key within each group, tombstones included."""
    newest = F.max_by(F.struct("seq", "ts", "value", "tombstone", "crc", "key_size", "value_size"), F.struct("ts", "seq"))
    return rows.groupBy(*within, "key").agg(newest.alias("r")).select(*within, "r.seq", "r.ts", "key", "r.value", "r.tombstone", "r.crc", "r.key_size", "r.value_size")


def flush(log: DataFrame, capacity: int) -> DataFrame:
    """Runs of level 1, one for each batch of ``capacity`` operations, with a key's newest version in the batch."""
    return newest_in(batches(log, capacity), "batch").withColumnRenamed("batch", "run_id").withColumn("level", F.lit(1)).select(*RUN_COLUMNS)


def manifest(runs: DataFrame) -> DataFrame:
    """(run_id, level, min_key, max_key, rows, bytes) of each run; bytes as records, not as files."""
    return runs.groupBy("run_id", "level").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("rows"), F.sum(record_size()).alias("bytes"))


def levels(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.groupBy("level").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def overlaps(manifest_rows: DataFrame) -> DataFrame:
    """(run_id, next_run_id): runs whose key range meets that of a run one level below. The manifest has a row per run."""
    a = manifest_rows.select("run_id", "level", F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    b = manifest_rows.select(F.col("run_id").alias("next_run_id"), (F.col("level") - 1).alias("level"), "min_key", "max_key")
    return a.join(b, (a.level == b.level) & (F.col("lo") <= F.col("max_key")) & (F.col("hi") >= F.col("min_key"))).select("run_id", "next_run_id")


def _placed(runs: DataFrame) -> DataFrame:
    """(run_id, key, nth, at, index_at): every record's number, data offset and index offset in its run, in key order.

    Runs are cut into key ranges, and sums per range come first, so a run that is as large as the table is never summed in one task.
    An index entry is key size 8, key, offset 8.
    """
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = runs.select("run_id", "key", record_size().alias("size"), (F.lit(16) + F.octet_length("key")).alias("entry"))
    rows = materialize(rows.repartitionByRange(n, "run_id", "key").withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy("run_id", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("entry").alias("entry"))
    upto = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("run_id", "part", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_0") for c in ("n", "size", "entry")))
    order = Window.partitionBy("run_id", "part").orderBy("key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c: (F.col(f"{c}_0") + F.coalesce(F.sum(c).over(before), F.lit(0))).cast("long")
    nth = (F.col("n_0") + F.row_number().over(order) - 1).cast("long").alias("nth")
    return rows.join(starts, ["run_id", "part"]).select("run_id", "key", nth, sum_of("size").alias("at"), sum_of("entry").alias("index_at"))


def dense_index(runs: DataFrame) -> DataFrame:
    """(run_id, key, nth, at): every record's number and data offset in its run, in key order."""
    return _placed(runs).select("run_id", "key", "nth", "at")


def sparse_index(runs: DataFrame, density: int) -> DataFrame:
    """Every ``density``-th entry of the dense index."""
    return dense_index(runs).where(F.col("nth") % density == 0)


def index_offsets(runs: DataFrame, density: int) -> DataFrame:
    """The sparse index with the place of its entries in the dense one."""
    return _placed(runs).where(F.col("nth") % density == 0).select("run_id", "key", "nth", "index_at")


def dictionary(keys: DataFrame) -> DataFrame:
    """(key, id): each distinct key's number in key order.

    Numbers come from sums per first two characters of the key, so keys are never numbered in one place.
    """
    distinct = keys.select("key").distinct().withColumn("__head", F.substring("key", 1, 2))
    starts = distinct.groupBy("__head").agg(F.count("*").alias("n"))
    before = Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__head").orderBy("key")) - 1
    return distinct.join(starts, "__head").select("key", (F.col("__start") + inside).cast("long").alias("id"))


def encode(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with the key's id in place of the key."""
    return rows.join(keys, "key").drop("key")


def decode(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, "id").drop("id")


def packed_size(id_: Column) -> Column:
    """Bytes of a record in the compressed form: checksum, time and key id as varints, a byte for the tombstone, and the value unless deleted."""
    head = varint_size(F.col("crc")) + varint_size(F.col("ts")) + F.lit(1) + varint_size(id_)
    return head + F.when(F.col("tombstone"), F.lit(0)).otherwise(varint_size(F.col("value_size")) + F.col("value_size"))


def write(runs: DataFrame, path: str) -> None:
    """Sorted Parquet files under level=/run_id=, with a Bloom filter on the key; large runs are cut into key ranges."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = runs.repartitionByRange(n, "level", "run_id", "key").sortWithinPartitions("level", "run_id", "key")
    rows.write.mode("append").option("parquet.bloom.filter.enabled#key", "true").partitionBy("level", "run_id").parquet(path)


def read(spark: SparkSession, path: str, run_ids: list[int] | None = None, verify: bool = False) -> DataFrame:
    """Runs by partition pruning; with ``verify`` rows with a wrong checksum raise no error but are left out."""
    rows = spark.read.parquet(path)
    if run_ids is not None:
        rows = rows.where(F.col("run_id").isin(*run_ids))
    return rows.where(F.crc32("value") == F.col("crc")) if verify else rows


def catalog(runs: DataFrame) -> DataFrame:
    """(level, run_id, files, file_bytes) as stored."""
    files = runs.select("level", "run_id", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct()
    return files.groupBy("level", "run_id").agg(F.count("*").alias("files"), F.sum("s").alias("file_bytes"))


def may_contain(manifest_rows: DataFrame, low: str, high: str | None = None) -> DataFrame:
    """Runs whose key range meets low..high (or holds ``low``)."""
    return manifest_rows.where((F.col("min_key") <= (low if high is None else high)) & (F.col("max_key") >= low))


def blooms(runs: DataFrame, n: int, p: float) -> DataFrame:
    """(run_id, pos): the filter of each run's keys."""
    bits, hashes = bloom_params(n, p)
    keys = runs.select("run_id", "key").distinct()
    return keys.select("run_id", F.explode(seeded_position(F.col("key"), hashes, bits)).alias("pos")).distinct()


def lookup_runs(keys: DataFrame, manifest_rows: DataFrame, filters: DataFrame, n: int, p: float) -> DataFrame:
    """(key, run_id): runs whose key range holds a key of ``keys`` and whose filter has all its bits."""
    bits, hashes = bloom_params(n, p)
    spots = keys.select("key").where("key is not null").distinct().select("key", F.explode(F.array_distinct(seeded_position(F.col("key"), hashes, bits))).alias("pos"))
    need = F.size(F.array_distinct(seeded_position(F.col("key"), hashes, bits)))
    full = spots.join(filters, "pos").groupBy("key", "run_id").agg(F.count("*").alias("have")).where(F.col("have") == need)
    return full.join(manifest_rows, "run_id").where(F.col("key").between(F.col("min_key"), F.col("max_key"))).select("key", "run_id")
