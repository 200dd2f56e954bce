"""What the operators of this subpackage share: scratch tables, row keys, text columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts may be long, so a batch of the default 10,000 could take gigabytes.
ARROW_ROWS = 512
#: Words of a bit table that rules out most rows before a shuffle: always this many rows at most, whatever the input.
FILTER_WORDS = 1 << 19


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where it is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared scratch folder and reads it back: it cuts the lineage and survives lost executors.

    The files go when the application ends, or before with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables made by :func:`materialize` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def arrow_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, under fixed names, so that no other column can clash; a null text becomes empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def content_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes: equal rows share them, others don't in practice (128 bits)."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def _word(key: Column) -> tuple[Column, Column]:
    mixed = F.xxhash64(key, F.lit("filter"))
    return F.pmod(mixed, F.lit(FILTER_WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(mixed, 20), F.lit(64)).cast("int"))


def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """A table of bits with those of all keys set; FILTER_WORDS rows at most."""
    word, bit = _word(F.col(key))
    return materialize(keys.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits")))


def with_bit(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` with ``_hit``: false where the key is certainly not in the table. The broadcast has a fixed bound."""
    word, bit = _word(F.col(key))
    wide = rows.withColumns({"_w": word, "_b": bit}).join(F.broadcast(table), "_w", "left")
    return wide.withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(F.col("_b")) != 0, F.lit(False))).drop("_w", "_b", "_bits")


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, so that columns of an operator's own can't clash with any; ``doc.*`` gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")
