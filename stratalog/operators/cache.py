"""What a cache of the last written keys holds after a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_puts(log: DataFrame, capacity: int) -> DataFrame:
    """(key, seq, value) of the ``capacity`` keys put last, for a log without deletes."""
    last = log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    return last.orderBy(F.desc("seq")).limit(capacity)


def cached(log: DataFrame, capacity: int) -> DataFrame:
    """(key, seq, value) in the cache at the end: a put makes its key the newest entry and drops the oldest beyond
    ``capacity``; a delete of a cached key frees its place; reads change nothing.

    An entry is dropped when ``capacity`` other keys, put after it and not deleted since, exist at one time. Only the
    ``capacity`` keys put last can be there at the end, so only operations after the oldest of them are looked at, once
    for each of the few.
    """
    final = log.groupBy("key").agg(F.max_by(F.struct("seq", "value", "tombstone"), "seq").alias("r")).select("key", "r.*")
    few = final.where(~F.col("tombstone")).orderBy(F.desc("seq")).limit(capacity).select("key", "seq", "value")
    mine = few.select(F.col("key").alias("of"), F.col("seq").alias("since"))
    after = log.select("key", "seq", "tombstone").join(F.broadcast(mine), (F.col("seq") > F.col("since")) & (F.col("key") != F.col("of")))
    own = Window.partitionBy("of", "key").orderBy("seq")
    was = F.coalesce(~F.lag("tombstone").over(own), F.lit(False))
    change = F.when(~F.col("tombstone") & ~was, 1).when(F.col("tombstone") & was, -1).otherwise(0)
    moves = after.withColumn("change", change).where("change <> 0")
    depth = F.sum("change").over(Window.partitionBy("of").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gone = moves.withColumn("depth", depth).where(F.col("depth") >= capacity).select(F.col("of").alias("key")).distinct()
    return few.join(gone, "key", "left_anti").select("key", "seq", "value")
