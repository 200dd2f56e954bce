"""A log as a stream: runs as they come, the current state, and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.latest import latest
from ..operators.limits import SCHEMA, take
from ..operators.runs import newest_in
from ..schema import RECORD
from ..sources.scratch import scratch_path


def stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def runs_from(log: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each micro-batch's newest versions as a sorted run under run_id=; a repeated batch replaces its own run."""

    def write(batch: DataFrame, run_id: int) -> None:
        newest_in(batch).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/run_id={run_id}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest(spark: SparkSession, log_path: str, files_per_trigger: int = 64) -> DataFrame:
    """The state after all that is in the log now, by way of the stream: late and repeated versions do no harm."""
    runs, checkpoint = scratch_path(spark), scratch_path(spark)
    runs_from(stream(spark, log_path, files_per_trigger), runs, checkpoint).awaitTermination()
    return latest(spark.read.schema(RECORD).option("basePath", runs).parquet(runs).select(*RECORD.fieldNames()))


def rate_limit_stream(requests: DataFrame, capacity: int, cooldown: int, created: int = 0) -> DataFrame:
    """:func:`stratalog.operators.limits.rate_limit` on a stream of (group_key, ts, seq): a bucket's state is kept between micro-batches."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (created, capacity)
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        now, allowed, left = take(now, rows["ts"].to_numpy(), capacity, cooldown)
        state.update(now)
        yield rows[["group_key", "ts", "seq"]].assign(allowed=allowed, tokens_left=left)

    grouped = requests.select("group_key", "ts", "seq").groupBy("group_key")
    return grouped.applyInPandasWithState(run, SCHEMA, "start long, tokens long", "append", GroupStateTimeout.NoTimeout)


def counts_by_window(requests: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Requests for each group and fixed window of event time, rows later than ``late`` dropped."""
    timed = requests.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy("group_key", F.window("at", f"{seconds} seconds")).agg(F.count("*").alias("requests"))
