"""Approximate nearest neighbours by balanced posting lists.

Centroids come from k-means on a bounded sample. Every vector goes to its nearest centroid's list and, if it lies near
a boundary, to others whose distance is within a ratio of the nearest (a list that a chosen centroid already covers is
skipped). Centroids are found by best-first search in a graph of centroids held in memory, or all are looked at where
that is less. A query reads the lists whose centroids' distances are within a ratio of its nearest; how many it may read
is fixed from the recall of some queries that are compared with every vector. Long lists are cut into parts of even size, and queries
meet a list in blocks, so no task holds a whole hot list.

Largest inner product becomes smallest distance by one more dimension, sqrt(M^2 - |x|^2), M being the largest norm;
it only guides the choice of lists. Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors that the centroids are fitted on, at most (smallest hashes first).
SAMPLE = 20_000
#: Vectors a list should have, centroids at most, vectors and queries that meet in one task at most.
LIST, CENTROIDS, PART = 192, 16_384, 4_096
COPIES, COPY_RATIO = 4, 1.12
#: Lists that a query may read within the ratio, and reads anyway, at least; more, if PROBES queries compared with every vector find less than RECALL.
LISTS, ANYWAY, LIST_RATIO = 48, 16, 1.25
PROBES, RECALL = 64, 0.97
DEGREE, BEAM = 24, 96


class Graph:
    """Centroids and, for each, its nearest others; ``search`` walks it best-first for many vectors at once."""

    def __init__(self, centroids: np.ndarray, top: float):
        self.c, self.top = centroids.astype(np.float32), top
        self.sq = (self.c**2).sum(1)
        n = len(self.c)
        d = min(DEGREE, n - 1)
        self.links = np.empty((n, d), np.int32)
        for a in range(0, n, 1024):
            near = self.sq[None, :] - 2 * self.c[a : a + 1024] @ self.c.T
            near[np.arange(len(near)), np.arange(a, a + len(near))] = np.inf
            self.links[a : a + 1024] = np.argpartition(near, d - 1, axis=1)[:, :d] if d and d < n else np.zeros((len(near), d))
        rng = np.random.default_rng(3)
        if d > 4:  # some far links, so that every centroid can be reached
            self.links[:, -3:] = rng.integers(0, n, (n, 3))
        self.entry = rng.choice(n, min(n, BEAM), replace=False).astype(np.int32)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of each row of x, nearest first, ``beam`` of them or all."""
        x = x.astype(np.float32)
        n, m = len(self.c), len(x)
        own = (x**2).sum(1)[:, None]
        if n <= DEGREE * beam:  # the walk would look at as many
            dist = np.maximum(own + self.sq[None, :] - 2 * x @ self.c.T, 0)
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            return order, np.take_along_axis(dist, order, 1)
        ids = np.tile(self.entry[:beam], (m, 1))
        dist = own + self.sq[ids] - 2 * (x @ self.c[self.entry[:beam]].T)
        seen = np.zeros((m, n), bool)
        seen[:, self.entry[:beam]] = True
        done = np.zeros(ids.shape, bool)
        rows = np.arange(m)
        while True:
            left = np.where(done, np.inf, dist)
            best = left.argmin(1)
            open_ = np.flatnonzero(np.isfinite(left[rows, best]))
            if not len(open_):
                break
            done[open_, best[open_]] = True
            near = self.links[ids[open_, best[open_]]]
            fresh = ~seen[open_[:, None], near]
            seen[open_[:, None], near] = True
            d = own[open_] + self.sq[near] - 2 * np.einsum("bd,bkd->bk", x[open_], self.c[near])
            d = np.where(fresh, d, np.inf)
            all_ids, all_d = np.concatenate([ids[open_], near], 1), np.concatenate([dist[open_], d], 1)
            all_done = np.concatenate([done[open_], ~fresh], 1)
            top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[open_], dist[open_], done[open_] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_d, all_done))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1), 0)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        room = np.sqrt(np.maximum(self.top**2 - (x**2).sum(1), 0))
        return np.concatenate([x, room[:, None]], 1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([((c**2).sum(1)[None, :] - 2 * x[a : a + 2048] @ c.T).argmin(1) for a in range(0, len(x), 2048)])
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        counts = np.diff(np.append(first, len(x)))
        sums = np.add.reduceat(x[order].astype(np.float64), first, axis=0)
        c[used] = sums / counts[:, None]
        empty = np.setdiff1d(np.arange(k), used)  # they go where lists are longest
        if len(empty):
            crowded = np.isin(own, used[np.argsort(-counts)[: max(1, len(empty))]])
            c[empty] = x[rng.choice(np.flatnonzero(crowded), len(empty))]
    return c


def posted(g: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, kept) of each lifted row of x: the lists that hold it are those that are kept."""
    near, dist = g.search(x, min(2 * COPIES, len(g.c)))
    keep = np.zeros(near.shape, bool)
    keep[:, 0] = True
    close = dist <= COPY_RATIO**2 * dist[:, :1]
    for j in range(1, near.shape[1]):
        gap = ((g.c[near[:, j]][:, None, :] - g.c[near[:, :j]]) ** 2).sum(2)
        covered = (keep[:, :j] & (gap < 0.25 * dist[:, j : j + 1])).any(1)  # nearly the same list
        keep[:, j] = close[:, j] & ~covered & (keep.sum(1) < COPIES)
    return near, keep


def lists_to_read(g: Graph, nodes: DataFrame, k: int, dim: int) -> tuple[int, int]:
    """(lists that a query may read within the ratio, lists that it reads anyway), so that probes find RECALL of their k nearest."""
    n = len(g.c)
    least = min(LISTS, n), min(ANYWAY, n)
    probes = nodes.where("asks").orderBy("k1", "k2").select("k1", "k2", "vec").limit(PROBES).collect() if n > ANYWAY else []
    if not probes:
        return least
    q, own = np.array([r.vec for r in probes]), np.array([(r.k1, r.k2) for r in probes])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's k best for each probe, itself left out."""
        best, vecs = np.full((len(q), 0), 0.0), np.zeros((len(q), 0, dim))
        for batch in batches:
            if batch.num_rows:
                x = _array(batch.column(2), dim)
                k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
                s = np.where((k1 == own[:, :1]) & (k2 == own[:, 1:]), -np.inf, q @ x.T)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best, vecs = np.concatenate([best, np.take_along_axis(s, top, 1)], 1), np.concatenate([vecs, x[top]], 1)
                top = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, vecs = np.take_along_axis(best, top, 1), np.take_along_axis(vecs, top[:, :, None], 1)
        at, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[at, j]), pa.array(list(vecs[at, j]), pa.list_(pa.float64()))], ["q", "score", "vec"])

    tops = nodes.select("k1", "k2", "vec").mapInArrow(nearest, "q long, score double, vec array<double>")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    found = tops.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "vec").collect()
    if not found:
        return least
    order, dist = g.search(np.concatenate([q, np.zeros((len(q), 1))], 1), n)
    place = np.argsort(order, axis=1)
    within = (dist <= LIST_RATIO**2 * dist[:, :1]).sum(1)
    asked = np.array([r.q for r in found])
    lists, keep = posted(g, g.lifted(np.array([r.vec for r in found])))
    at = np.where(keep, place[asked[:, None], lists], n).min(1)  # the first list read that holds it
    need = int(np.sort(at)[min(len(at) - 1, int(np.ceil(RECALL * len(at))) - 1)]) + 1
    most = max(least[0], need)
    enough = ((at < least[1]) | (at < np.minimum(most, within[asked]))).mean() >= RECALL
    return most, least[1] if enough else max(least[1], need)


def _array(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("vec")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    return rows.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def neighbours(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by ``every``.

    Nearest is the largest inner product; ties go to the smaller vec_id; rows with the query's id are no candidates. With
    k candidates or fewer all are returned. Null ids, and vectors that are null, zero, of another than the usual
    length, or hold null or non-finite components, take no part. Equal rows (id and vector) count once. Equal vectors
    are searched once and the k + 1 smallest ids of each stand for it, which loses nothing. An empty table gives an
    empty result. Other columns are not looked at.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = _usable(df, id_col, vec_col)
    usual = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual["dim"]
    rows = rows.where(F.size("vec") == dim).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    rows = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit("v"), "vec")}).withColumn("asks", F.col("vec_id") % every == 0)
    # Distinct vectors with their smallest ids; the rank limit is applied before the shuffle too, so copies don't pile up.
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    lowest = rows.select("k1", "k2", "vec_id").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    ids = lowest.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    one = rows.groupBy("k1", "k2").agg(F.min_by("vec", "vec_id").alias("vec"), F.max("asks").alias("asks"))
    nodes = materialize(one.join(ids, ["k1", "k2"]))
    stats = nodes.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("sq")).first()
    n, top = stats["n"], float(np.sqrt(stats["sq"]))
    sample = np.array([r.vec for r in nodes.orderBy("k1", "k2").select("vec").limit(SAMPLE).collect()])
    lists = int(min(max(1, round(n / LIST)), CENTROIDS, max(1, len(sample) // 4)))
    lifter = Graph(np.zeros((1, dim + 1)), top)
    graph = spark.sparkContext.broadcast(Graph(kmeans(lifter.lifted(sample), lists), top))  # CENTROIDS vectors at most
    most, anyway = lists_to_read(graph.value, nodes, k, dim)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            x = g.lifted(_array(batch.column(2), dim))
            near, keep = posted(g, x)
            at, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(near[at, j].astype(np.int32)), *(batch.column(c).take(pa.array(at)) for c in (0, 1, 2, 3))], ["list", "k1", "k2", "vec", "low"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            x = np.concatenate([_array(batch.column(2), dim), np.zeros((batch.num_rows, 1))], 1)
            near, dist = g.search(x, most)
            want = dist <= LIST_RATIO**2 * dist[:, :1]
            want[:, :anyway] = True
            at, j = np.nonzero(want)
            yield pa.RecordBatch.from_arrays([pa.array(near[at, j].astype(np.int32)), *(batch.column(c).take(pa.array(at)) for c in (0, 1, 2))], ["list", "q1", "q2", "query"])

    def everywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, j = np.divmod(np.arange(batch.num_rows * lists), lists)
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), *(batch.column(c).take(pa.array(at)) for c in (0, 1, 2))], ["list", "q1", "q2", "query"])

    low = F.element_at("ids", 1).alias("low")
    postings = materialize(nodes.select("k1", "k2", "vec", low).mapInArrow(post, "list int, k1 long, k2 long, vec array<double>, low long"))
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))

    def found(asking: DataFrame) -> DataFrame:
        """The best k + 1 distinct vectors of each query in the lists it asks: a task meets one part of a list and one block of queries."""
        asking = materialize(asking)
        cells = asking.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks")).join(sizes, "list")
        cells = materialize(cells)  # a row per list, CENTROIDS at most
        part, block = F.pmod("k1", F.col("parts")).cast("int"), F.pmod("q1", F.col("blocks")).cast("int")
        seq = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = postings.join(F.broadcast(cells), "list").withColumn("part", part).withColumn("block", seq("blocks")).drop("parts", "blocks")
        right = asking.join(F.broadcast(cells), "list").withColumn("block", block).withColumn("part", seq("parts")).drop("parts", "blocks")

        def meet(posted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(posted) or not len(asked):
                return pd.DataFrame({"q1": [], "q2": [], "k1": [], "k2": [], "low": [], "score": []})
            posted = posted.sort_values("low", kind="stable")
            x, q, out = np.stack(posted["vec"].to_numpy()), np.stack(asked["query"].to_numpy()), []
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ x.T
                take = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                at = np.repeat(np.arange(a, a + len(s)), take.shape[1])
                hit = posted.iloc[take.ravel()]
                out.append(pd.DataFrame({"q1": asked["q1"].to_numpy()[at], "q2": asked["q2"].to_numpy()[at], "k1": hit["k1"].to_numpy(), "k2": hit["k2"].to_numpy(), "low": hit["low"].to_numpy(), "score": np.einsum("bd,bd->b", q[at], x[take.ravel()])}))
            return pd.concat(out)

        keys = ["list", "part", "block"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q1 long, q2 long, k1 long, k2 long, low long, score double")
        met = met.groupBy("q1", "q2", "k1", "k2").agg(F.min("low").alias("low"), F.max("score").alias("score"))
        order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "low")
        return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth", "low")

    queries = nodes.where("asks").select("k1", "k2", "vec")
    hits = materialize(found(queries.mapInArrow(ask, "list int, q1 long, q2 long, query array<double>")))
    per = hits.join(nodes.select("k1", "k2", F.size("ids").alias("here")), ["k1", "k2"]).groupBy("q1", "q2").agg(F.sum("here").alias("here"))
    few = queries.join(per, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")), "left").where(F.coalesce("here", F.lit(0)) < k + 1).select("k1", "k2", "vec")
    few = materialize(few)
    if few.take(1):  # lists too short for k: these few read all lists
        more = found(few.mapInArrow(everywhere, "list int, q1 long, q2 long, query array<double>"))
        hits = hits.join(few.select(F.col("k1").alias("q1"), F.col("k2").alias("q2")), ["q1", "q2"], "left_anti").unionByName(more)
    asked = rows.where("asks").select("vec_id", "k1", "k2").distinct().select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    full = hits.join(nodes.select("k1", "k2", "ids"), ["k1", "k2"]).select("q1", "q2", "score", "ids")
    pairs = asked.join(full, ["q1", "q2"]).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
