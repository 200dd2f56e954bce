"""Token buckets that fill up at once, at the first request after the cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "group_key string, ts long, seq long, allowed boolean, tokens_left long"


def take(state: tuple[int, int], times: np.ndarray, capacity: int, cooldown: int) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
    """Requests of one group in order: the state (last refill, tokens) after them, and for each whether it passed and what was left.

    Goes from refill to refill, not from request to request.
    """
    start, tokens = state
    allowed, left = np.empty(len(times), bool), np.empty(len(times), np.int64)
    at = 0
    while at < len(times):
        if times[at] > start + cooldown:
            start, tokens = int(times[at]), capacity
        end = at + int(np.searchsorted(times[at:], start + cooldown, "right"))
        used = np.arange(1, end - at + 1)
        allowed[at:end] = used <= tokens
        left[at:end] = np.maximum(tokens - used, 0)
        tokens = max(tokens - (end - at), 0)
        at = end
    return (start, tokens), allowed, left


def rate_limit(requests: DataFrame, capacity: int, cooldown: int, created: int = 0) -> DataFrame:
    """(group_key, ts, seq, allowed, tokens_left) of each request (group_key, ts, seq).

    A bucket is full at ``created``. It fills up at the first request later than ``cooldown`` after the last refill; an
    empty bucket rejects. Partitions are sorted by group and time and read as a stream that carries a bucket's state on,
    so a hot group needs no more memory than others.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = requests.select("group_key", "ts", "seq").repartition(n, "group_key").sortWithinPartitions("group_key", "ts", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, (created, capacity)
        for batch in batches:
            keys, times = batch["group_key"].to_numpy(), batch["ts"].to_numpy()
            allowed, left = np.empty(len(batch), bool), np.empty(len(batch), np.int64)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(batch)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if keys[a] != name:
                    name, state = keys[a], (created, capacity)
                state, allowed[a:z], left[a:z] = take(state, times[a:z], capacity, cooldown)
            yield batch.assign(allowed=allowed, tokens_left=left)

    return rows.mapInPandas(run, SCHEMA)


def request_log(limited: DataFrame) -> DataFrame:
    """(group_key, ts, tokens_left): what a log with one entry for each second holds, the last request of the second."""
    return limited.groupBy("group_key", "ts").agg(F.max_by("tokens_left", "seq").alias("tokens_left"))
