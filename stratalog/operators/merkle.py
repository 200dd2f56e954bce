"""Merkle trees over ordered rows, as a table (level, pos, hash); level 0 holds the leaves."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.oplog import running
from ..sources.scratch import materialize

EMPTY = "00" * 20
#: Levels made in one round.
STEP = 8


def leaves(rows: DataFrame, data: Column, order: str) -> DataFrame:
    """(level, pos, hash): SHA-1 of ``data``, numbered from 0 in ``order`` (a unique whole number)."""
    numbered = running(rows.select(F.col(order).alias("o"), F.unhex(F.sha1(data.cast("binary"))).alias("hash")), F.lit(1).cast("long"), "pos", "o")
    return numbered.select(F.lit(0).alias("level"), "pos", "hash")


def build(leaf_rows: DataFrame) -> DataFrame:
    """All levels. The tree is filled up to a power of two with zero hashes; subtrees of such leaves are never made, their hash is known.

    A round is one aggregation that makes STEP levels: nodes under one ancestor meet in an array of 2**STEP at most, and
    the levels above are array expressions on it. A tree of n leaves takes log2(n) / STEP rounds.
    """
    rows = materialize(leaf_rows)
    n = rows.count()
    empty, level, now, out = bytes.fromhex(EMPTY), 0, rows, rows
    while n > 1:
        step = min(STEP, (n - 1).bit_length())
        own = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        wide = now.groupBy(F.shiftright("pos", step).alias("above")).agg(own.alias("own")).select("above", F.transform("own", lambda x: x["hash"]).alias("a0"))
        for i in range(step):
            wide = wide.withColumn(f"a{i + 1}", _parents(f"a{i}", empty))
            empty = hashlib.sha1(empty + empty).digest()
        wide = materialize(wide.drop("a0"))
        for i in range(1, step + 1):
            made = wide.select("above", F.posexplode(f"a{i}").alias("nth", "hash"))
            pos = F.shiftleft("above", step - i) + F.col("nth")
            now = made.select(F.lit(level + i).alias("level"), pos.cast("long").alias("pos"), "hash")
            out = out.unionByName(now)
        level += step
        n = -(-n // 2**step)
    return out


def _parents(nodes: str, empty: bytes) -> Column:
    """Of neighbouring nodes from an even place on, the hashes of each two; a missing right one is empty."""
    right = lambda i: F.coalesce(F.get(nodes, 2 * i + 1), F.lit(empty))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: F.unhex(F.sha1(F.concat(F.get(nodes, 2 * i), right(i)))))


def root(tree: DataFrame) -> DataFrame:
    """(level, hash) of the top; the empty tree has none."""
    return tree.orderBy(F.desc("level")).limit(1).select("level", "hash")


def proofs(leaf_rows: DataFrame, tree: DataFrame) -> DataFrame:
    """(pos, nth, level, hash) for each leaf in ``leaf_rows`` (pos): the root, then from the top down the neighbours of the nodes on the way to the leaf."""
    top = tree.agg(F.max("level")).first()[0]
    if top is None:
        return tree.select("pos", F.lit(0).alias("nth"), "level", "hash")
    empty = [bytes.fromhex(EMPTY)]
    for _ in range(top):
        empty.append(hashlib.sha1(empty[-1] * 2).digest())
    # One row for each level, 64 at most; the root's neighbour stands for the root itself.
    way = leaf_rows.select("pos", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    beside = F.when(F.col("level") == top, F.lit(0).cast("long")).otherwise(F.expr("shiftright(pos, level)").bitwiseXOR(F.lit(1).cast("long")))
    nodes = tree.select("level", F.col("pos").alias("at"), "hash")
    full = way.withColumn("at", beside).join(nodes, ["level", "at"], "left")
    none = F.element_at(F.array(*map(F.lit, empty)), F.col("level") + 1)
    return full.select("pos", (F.lit(top) - F.col("level")).alias("nth"), "level", F.coalesce("hash", none).alias("hash"))


def proven(leaf_rows: DataFrame, proof_rows: DataFrame) -> DataFrame:
    """Those of ``leaf_rows`` (pos, hash) whose proof leads to its root."""
    path = proof_rows.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("level", F.col("hash").alias("h")))).alias("path"))
    whole = leaf_rows.join(path, "pos")

    def up(x: Column, step: Column) -> Column:
        right = F.pmod(F.call_function("shiftright", F.col("pos"), step["level"]), F.lit(2).cast("long")) == 1
        return F.unhex(F.sha1(F.when(right, F.concat(step["h"], x)).otherwise(F.concat(x, step["h"]))))

    made = F.aggregate(F.slice("path", F.lit(1), F.size("path") - 1), F.col("hash"), up)
    return whole.where(made == F.element_at("path", -1)["h"]).drop("path")


def contained(rows: DataFrame, data: Column, tree: DataFrame) -> DataFrame:
    """Rows whose hash is among the leaves."""
    own = rows.withColumn("__h", F.unhex(F.sha1(data.cast("binary"))))
    return own.join(tree.where("level = 0").select(F.col("hash").alias("__h")), "__h", "left_semi").drop("__h")


def incorrect(rows: DataFrame, data: Column, tree: DataFrame) -> DataFrame:
    """Rows whose hash is not among the leaves."""
    own = rows.withColumn("__h", F.unhex(F.sha1(data.cast("binary"))))
    return own.join(tree.where("level = 0").select(F.col("hash").alias("__h")), "__h", "left_anti").drop("__h")


def serialized(tree: DataFrame) -> DataFrame:
    """(nth, level, pos, hash) in pre-order: a node, its left subtree, its right subtree."""
    height = tree.agg(F.max("level").alias("h"))
    path = F.rpad(F.when(F.col("level") == F.col("h"), F.lit("")).otherwise(F.lpad(F.conv(F.col("pos").cast("string"), 10, 2), F.col("h") - F.col("level"), F.lit("0"))), 64, " ")
    return tree.crossJoin(F.broadcast(height)).select(path.alias("path"), "level", "pos", "hash").orderBy("path").drop("path")
