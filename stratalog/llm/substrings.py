"""Substring dedup: every byte covered by a long string that also starts anywhere else goes.

Suffixes are sampled: of every string of ``length`` symbols (bytes, or words) the ``anchor``-symbol string with the least
hash is the anchor, and only anchored suffixes are kept, about one in a hundred bytes. Two equal strings have equal
anchors at equal places, so no match is lost. A level of the index is an array of such suffixes, ordered by the hash of
their anchor, with the number of entries and whether more than one continuation was seen. A new batch of documents
becomes an array of its own and is scanned against all levels; levels of equal rank then merge, so an entry is rewritten
a logarithmic number of times (:class:`Levels`).

A repeated anchor is only a candidate. All strings around it are decided by 64-bit hashes: where the whole context of an
anchor is repeated, all its strings are; contexts that differ are compared string by string under the anchor's hash, with
one representative for each distinct context. Hot passages meet as counts or as short blocks of hashes keyed by anchor
and place. Texts are shuffled only for contexts that differ, and for documents that have something removed.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, bit_table, content_key, documents, id_text, materialize, release, with_bit

LENGTH, ANCHOR = 400, 200
#: Words of a passage that is told of.
PASSAGE = 51
#: Batches that documents are added to the index in.
BATCHES = 4
#: Strings that a text is looked at in one go.
CHUNK = 1 << 19
#: Strings of an anchor that are compared as one block.
BLOCK = 32
#: Contexts of one anchor and block that are compared in one task; more are spread by hash.
HOT = 1 << 17
P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        up, down = (np.full(CHUNK + 4 * LENGTH, v, np.uint64) for v in (P, pow(P, -1, 2**64)))
        up[0] = down[0] = 1
        _TABLES.extend((np.multiply.accumulate(up), np.multiply.accumulate(down)))
    return _TABLES


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _tables()[0][: len(data)], out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hashes(sums: np.ndarray, size: int, at: np.ndarray | slice) -> np.ndarray:
    """Of the strings of ``size`` bytes at the places ``at``."""
    down = _tables()[1][: len(sums) - size]
    return _mixed((sums[size:][at] - sums[: len(sums) - size][at]) * down[at])


def symbols(text: str, unit: str) -> np.ndarray:
    """The text's UTF-8 bytes, or a 64-bit hash of each of its words (what white space, [\\x20\\x09-\\x0D], separates)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if unit == "byte":
        return raw
    out, at = [], 0
    while at < len(raw):
        block = raw[at : at + CHUNK]
        word = (block != 32) & ((block < 9) | (block > 13))
        if at + len(block) < len(raw) and word[-1] and not word.all():  # cut between words; one that fills a block is cut
            block = block[: int(np.flatnonzero(~word)[-1]) + 1]
            word = word[: len(block)]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        sums = _sums(block)
        out.append(_mixed((sums[edge[1::2]] - sums[edge[::2]]) * _tables()[1][edge[::2]]))
        at += len(block)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def suffixes(raw: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, count, offset, hash) arrays: runs of string starts with the same anchor, and where in the first it stands."""
    window, low = length - anchor + 1, np.uint64(4 * CHUNK - 1)
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = raw[at : at + CHUNK + length - 1]
        h = _hashes(_sums(part), anchor, slice(None))
        place = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        rows = np.full(-(-len(h) // window) * window, np.uint64(2**64 - 1))
        rows[: len(h)] = place
        rows = rows.reshape(-1, window)
        before, after = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        least = (np.minimum(after[:n], before[window - 1 : window - 1 + n]) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(least, prepend=-1))
        yield at + first, np.diff(np.append(first, n)), least[first] - first, h[least[first]]


ENTRY = "k1 long, k2 long, s long, n int, o int, g long, c long"


def entries(texts: DataFrame, length: int, anchor: int, unit: str) -> DataFrame:
    """(k1, k2: the text, s: first string, n: strings, o: the anchor in the first, g: the anchor, c: the whole context) per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = symbols(text.as_py(), unit)
                if len(data) < length:
                    continue
                for s, n, o, g in suffixes(data, length, anchor):
                    c = [xxhash.xxh3_64_intdigest(data[a : a + b + length - 1].data, d) for a, b, d in zip(s.tolist(), n.tolist(), o.tolist())]
                    for col, x in zip(out, (np.full(len(s), k1), np.full(len(s), k2), s, n.astype(np.int32), o.astype(np.int32), g.view(np.int64), np.array(c, np.uint64).view(np.int64))):
                        col.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["k1", "k2", "s", "n", "o", "g", "c"])

    return texts.select("k1", "k2", "text").mapInArrow(run, ENTRY)


class Levels:
    """The index: sorted arrays (g, lo, hi, n), n counting entries, lo and hi their least and largest context hash."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def _merged(*arrays: DataFrame) -> DataFrame:
        rows = arrays[0]
        for x in arrays[1:]:
            rows = rows.unionByName(x)
        return rows.groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Scans a batch's entries against all levels; returns the anchors seen more than once so far (g, lo, hi, n).

        The batch becomes a level and levels of equal rank merge, unless it is the ``last`` that will come.
        """
        fresh = batch.select("g", F.col("c").alias("lo"), F.col("c").alias("hi"), F.lit(1).cast("long").alias("n"))
        hits = self._merged(fresh, *(x for _, x in self.levels)).where("n > 1")
        if last:
            return materialize(hits)
        rank, ranked = 0, [fresh]
        every = len(self.levels)
        while any(r == rank for r, _ in self.levels):
            ranked += [x for r, x in self.levels if r == rank]
            self.levels = [(r, x) for r, x in self.levels if r != rank]
            rank += 1
        made = materialize(self._merged(*ranked).sortWithinPartitions("g"))
        hits = materialize(made.where("n > 1") if len(ranked) == every + 1 else hits)  # it holds all levels, or they are scanned
        release(*ranked[1:])
        self.levels.append((rank, made))
        return hits

    def drop(self) -> None:
        release(*(x for _, x in self.levels))
        self.levels = []


def _blocks(texts: DataFrame, wanted: DataFrame, length: int, unit: str) -> DataFrame:
    """Hashes of all strings of the wanted contexts, in blocks of the same places around the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "b", "k1", "k2", "p", "d", "seen", "hs"]
        for batch in batches:
            rows = []
            for k1, k2, text, asked in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3)):
                data = symbols(text.as_py(), unit)
                for x in asked.as_py():
                    s, n, anchor = x["s"], x["n"], x["s"] + x["o"]
                    sums = _sums(data[s : s + n + length - 1])
                    h = _hashes(sums, length, np.arange(n)).view(np.int64)
                    place = s - anchor + np.arange(n)  # of the string's start, from the anchor's
                    edge = np.flatnonzero(np.diff(place // BLOCK, prepend=-(10**9)))
                    for a, z in zip(edge.tolist(), [*edge[1:].tolist(), n]):
                        rows.append((x["g"], int(place[a] // BLOCK), k1, k2, s + a, int(place[a] % BLOCK), x["seen"], h[a:z]))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "n", "o", "g", "seen")).alias("asked"))
    return texts.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked").mapInArrow(run, "g long, b int, k1 long, k2 long, p long, d int, seen boolean, hs array<long>")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks sorted by (g, b): (k1, k2, p, mask) for those with a string whose hash another context has at the same place."""

    def of(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        g, b, d = (table.column(c).to_numpy() for c in ("g", "b", "d"))
        lists = table.column("hs").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        h = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(g)), sizes)
        inside = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = d[row] + inside
        group = np.cumsum((np.diff(g, prepend=g[0]) != 0) | (np.diff(b, prepend=b[0]) != 0))[row]
        key = group * BLOCK + place
        order = np.lexsort((h, key))
        k, v = key[order], h[order]
        same = (k[1:] == k[:-1]) & (v[1:] == v[:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        mask = np.zeros(len(g), np.int64)
        np.bitwise_or.at(mask, row[twice], np.int64(1) << inside[twice])
        keep = np.flatnonzero((mask != 0) & ~table.column("seen").to_numpy(zero_copy_only=False).astype(bool))
        cols = [table.column(c).combine_chunks().take(pa.array(keep)) for c in ("k1", "k2", "p")]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in cols]
        return pa.RecordBatch.from_arrays([*cols, pa.array(mask[keep])], ["k1", "k2", "p", "mask"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        g, b = held.column("g").to_numpy(), held.column("b").to_numpy()
        cut = int(np.flatnonzero((g != g[-1]) | (b != b[-1]))[-1]) + 1 if (g[0], b[0]) != (g[-1], b[-1]) else 0
        if cut:
            yield of(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield of(held)


def _repeated_strings(blocks: DataFrame) -> DataFrame:
    """(k1, k2, p, mask): bit i is set if the string at p + i is repeated; contexts that are known to be are left out."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = materialize(blocks.groupBy("g", "b").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT).select("g", "b"))
    schema = "k1 long, k2 long, p long, mask long"
    if not hot.take(1):
        return blocks.repartition(n, "g", "b").sortWithinPartitions("g", "b").mapInArrow(_compared, schema)
    cold = blocks.join(hot, ["g", "b"], "left_anti").repartition(n, "g", "b").sortWithinPartitions("g", "b").mapInArrow(_compared, schema)
    one = blocks.join(hot, ["g", "b"]).select("g", "b", "k1", "k2", "p", "d", "seen", F.posexplode("hs").alias("i", "h")).withColumn("at", F.col("d") + F.col("i"))
    twice = materialize(one.groupBy("g", "b", "at", "h").agg(F.count("*").alias("m")).where("m > 1").drop("m"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))
    return cold.unionByName(one.where("not seen").join(twice, ["g", "b", "at", "h"]).groupBy("k1", "k2", "p").agg(F.bit_or(bit).alias("mask")))


def _runs(at: Column, mask: Column) -> Column:
    """(first, strings) of each run of set bits."""
    on = lambda i: F.pmod(F.call_function("shiftrightunsigned", mask, i), F.lit(2).cast("long")) == 1
    bits = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), on)
    starts = F.filter(bits, lambda i: (i == 0) | ~F.array_contains(bits, i - 1))
    ends = F.filter(bits, lambda i: ~F.array_contains(bits, i + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct((at + a).alias("s"), (b - a + 1).cast("int").alias("n")))


def repeated(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES, unit: str = "byte") -> DataFrame:
    """(k1, k2, spans): for each text that has any, the sorted (first symbol, end) of what repeated strings cover, overlapping or not."""
    spark = texts.sparkSession
    arrow_batches(spark)
    rows = materialize(entries(texts, length, anchor, unit).withColumn("batch", F.pmod("k2", F.lit(batches)).cast("int")), "batch")
    index, hits = Levels(), []
    for i in range(batches):
        hits.append(index.add(rows.where(F.col("batch") == i), last=i == batches - 1))
    every = hits[0]
    for x in hits[1:]:
        every = every.unionByName(x)
    every = every.groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")) if batches > 1 else every
    anchors = materialize(every.select("g", (F.col("lo") == F.col("hi")).alias("alike")))
    index.drop()
    table = bit_table(anchors, "g")
    found = materialize(with_bit(rows.drop("batch"), "g", table).where("_hit").drop("_hit").join(anchors, "g"))
    release(rows, table, anchors, *hits)
    _tidy(spark)
    # All strings of a context that is repeated as a whole are; else one entry stands for the context.
    contexts = materialize(found.where("not alike").groupBy("g", "c").agg(F.count("*").alias("m"), F.min(F.struct("k1", "k2", "s", "n", "o")).alias("r")))
    whole = found.where("alike").select("k1", "k2", "s", "n")
    again = found.where("not alike").join(contexts.where("m > 1").select("g", "c"), ["g", "c"]).select("k1", "k2", "s", "n")
    wanted = materialize(contexts.select("r.*", "g", (F.col("m") > 1).alias("seen")))
    table = bit_table(wanted, "k1")
    few = with_bit(texts, "k1", table).where("_hit").groupBy("k1", "k2").agg(F.any_value("text").alias("text"))
    blocks = materialize(_blocks(few, wanted, length, unit))
    part = _repeated_strings(blocks).select("k1", "k2", F.explode(_runs(F.col("p"), F.col("mask"))).alias("x")).select("k1", "k2", "x.s", "x.n")
    strings = whole.unionByName(again).unionByName(part).groupBy("k1", "k2", "s").agg(F.max("n").alias("n"))
    span = F.struct(F.col("s").alias("a"), (F.col("s") + F.col("n") + (length - 1)).alias("z"))
    out = materialize(strings.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(span)).alias("spans")))
    release(found, contexts, wanted, table, blocks)
    _tidy(spark)
    return out


def _tidy(spark) -> None:
    """Lets Spark delete the shuffle files of jobs that are over, rather than when the driver happens to collect its garbage.

    Spark's cleaner goes by the driver's garbage; without this the files of all jobs here stay on disk together.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in spans:
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["z"])
        else:
            out.append([x["a"], x["z"]])
    return [(a, z) for a, z in out]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES, passage: int = PASSAGE) -> DataFrame:
    """A row per document: doc_id, n_bytes, spans (removed, maximal: a, z), kept (the other bytes, joined), shares_passage.

    Texts are UTF-8 bytes; a null text is empty. A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same document or another, overlapping or not; strings are judged on the input. Repeated rows
    are copies like others. Null ids are kept. Texts shorter than ``length`` keep all. An empty table gives an empty
    result. Other columns are not looked at. ``kept`` is bytes, as a cut may split a character. ``shares_passage`` says
    that a passage of ``passage`` words stands anywhere else too: such a passage may be shorter than ``length`` bytes.
    """
    texts = id_text(docs, id_col, text_col).select("doc_id", "text", *content_key(F.col("text")))
    spans = repeated(texts, length, anchor, batches)
    shares = repeated(texts, passage, max(1, passage // 3), batches, "word").select("k1", "k2", F.lit(True).alias("shares"))
    found = materialize(spans.join(shares, ["k1", "k2"], "full"))
    release(spans)
    marked = with_bit(texts, "k1", bit_table(found, "k1"))
    rows = marked.where("_hit").join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans", "shares")
    none = (F.lit(None).cast(found.schema["spans"].dataType).alias("spans"), F.lit(None).cast("boolean").alias("shares"))
    rows = rows.unionByName(marked.where("not _hit").select("doc_id", "text", *none))
    pair = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("z", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", pair), T.StructField("kept", T.BinaryType()), T.StructField("shares_passage", T.BooleanType())])
    kinds = [pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for text, spans_ in zip(batch.column(1), batch.column(2)):
                data, cuts = text.as_py().encode("utf-8", "surrogatepass"), merged(spans_.as_py() or [])
                sizes.append(len(data))
                gone.append([{"a": a, "z": z} for a, z in cuts])
                ends = [0, *(x for cut in cuts for x in cut), len(data)]
                kept.append(b"".join(data[a:z] for a, z in zip(ends[::2], ends[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip((sizes, gone, kept), kinds)), batch.column(3).fill_null(False)], schema.names)

    return rows.mapInArrow(run, schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    rows = dedup_substrings(documents(spark, sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["z"] - x["a"])
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"), "shares_passage")
