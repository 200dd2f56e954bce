"""SimHash near-duplicates by deletion-variant signatures.

Every distinct fingerprint is cut into segments, few enough that two fingerprints within the distance have one segment
that differs by at most one bit. Each segment is indexed under all its one-wildcard variants (one bit position left
out), so such a pair shares a variant; an equality join on the variants finds it and the full distance is verified.

Large groups: equal fingerprints are one node. In every class of nodes that share a variant the smallest and the largest
are compared with all others in one pass, which links most of a large group in stars; only classes that are not linked
as a whole by then reach the join of all pairs. So a large group of copies does not meet all against all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, bit_table, id_text, is_empty, materialize, release, whole_row, with_bit
from .components import components

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = 64
#: Bands of min-hashes and min-hashes in a band: sets of similarity s share a band with probability 1 - (1 - s^WIDTH)^BANDS, 0.9996 at 0.8.
BANDS, WIDTH = 20, 5
MULTIPLIERS = np.random.default_rng(7).integers(2**63, size=BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bins of a sketch, a power of two, and the standard errors by which its estimate may be too low.
BINS, DEVIATIONS = 1024, 5
#: Nodes of a class that meet all others of it in one task.
BLOCK = 4096
#: Rounds in which each class's hub is compared with the class, before all pairs that are left.
ROUNDS = 3


def fingerprint(text: str, words: int) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 if there is no word."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return digest(b" ".join(w), SEED)
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1)
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(bits), 255):  # a sum of 255 bits fits a byte
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) per row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits): the fewest segments of which one differs by at most one bit."""
    n = max(2, distance // 2 + 1)  # a segment's bits and its number share a long
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def variant_keys(distance: int) -> list[Column]:
    """Of fp, for each segment and left-out position: which of them it is (high bits) and the segment's other bits."""
    keys, fp = [], F.col("fp")
    for at, n in segments(distance):
        for i in range(n):
            rest = fp.bitwiseAND(F.lit(_signed(((1 << n) - 1 ^ 1 << i) << at)))
            keys.append(F.call_function("shiftrightunsigned", rest, F.lit(at)).bitwiseOR(F.lit(len(keys) << 33)))
    return keys


def variants(nodes: DataFrame, distance: int) -> DataFrame:
    """(fp, k) per node and key."""
    return nodes.select("fp", F.explode(F.array(*variant_keys(distance))).alias("k"))


def fingerprint_links(nodes: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Of distinct fingerprints (fp): links (a, b) that connect all that any links connect, and (fp, label) by stars alone.

    A link joins two fingerprints within the distance. Not every such pair is returned: a class that one node links as a
    whole, and pairs that are connected by then, need no more.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance
    # The one large shuffle: classes of nodes that share a variant, each compared with its smallest and its largest.
    own = Window.partitionBy("k")
    rows = variants(nodes.repartition(n, "fp"), distance).withColumns({"lo": F.min("fp").over(own), "hi": F.max("fp").over(own)}).where("lo < hi")
    rows = rows.withColumns({"to_lo": near("fp", "lo"), "to_hi": near("fp", "hi")})
    every = lambda c: F.min(c).over(own)
    # Of three nodes or fewer that is every pair; of more it is enough if a star holds them all.
    done = (F.count("*").over(own) <= 3) | every(F.col("to_lo")) | every(F.col("to_hi")) | (every(F.col("to_lo") | F.col("to_hi")) & near("lo", "hi"))
    shared = materialize(rows.withColumn("done", done).where("not done or (to_lo and fp <> lo) or (to_hi and fp <> hi)"))
    ends = F.array(F.when(F.col("to_lo"), F.col("lo")), F.when(F.col("to_hi"), F.col("hi")))
    star = shared.select(F.col("fp").alias("a"), F.explode(ends).alias("b")).where("a <> b").distinct()
    linked = components(star)
    labelled = materialize(nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("c")))
    # What stars may have missed: pairs of classes that a star did not link as a whole, if no other link joined them by now.
    left = materialize(shared.where("not done").select("k", "fp").join(labelled, "fp"))
    mixed = left.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k")
    open_ = materialize(left.join(mixed, "k", "left_semi"))
    a, b = open_.select("k", F.col("fp").alias("a"), F.col("c").alias("ca")), open_.select("k", F.col("fp").alias("b"), F.col("c").alias("cb"))
    missed = a.join(b, (a.k == b.k) & (F.col("ca") < F.col("cb")) & near("a", "b")).select("a", "b", "ca", "cb")
    missed = materialize(missed.groupBy("ca", "cb", "a").agg(F.min("b").alias("b")))
    release(open_, left)
    links = materialize(star.unionByName(missed.select("a", "b")))
    joined = components(missed.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    out = materialize(labelled.join(joined.withColumnRenamed("node", "c"), "c", "left").select("fp", F.coalesce("label", "c").alias("label")))
    release(shared, missed)
    return links, out


def fingerprint_components(fps: DataFrame, distance: int) -> DataFrame:
    """Of fingerprints (fp): distinct (fp, label), label being the same for all that are linked, directly or by others."""
    return fingerprint_links(materialize(fps.select("fp").distinct()), distance)[1]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    Null and empty texts have the fingerprint zero and are linked like others. Texts with fewer words than a shingle
    are one shingle. Repeated rows, and rows whose id is null, keep a row each; a null id is never a component's
    smallest unless there is no other. An empty table gives an empty result. Other columns are not looked at.
    """
    fps = materialize(fingerprints(id_text(docs, id_col, text_col), words))
    labels = fingerprint_components(fps, distance)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    first = least.join(labels, "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    classes = materialize(labels.join(first, "label").select("fp", "component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def word_set_fingerprint(words: list[bytes]) -> int:
    """A SimHash of the distinct words: an edited word moves it far less than it moves one of shingles."""
    distinct = set(words)
    if not distinct:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, distinct)), np.uint8)).reshape(-1, BITS)
    counts = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(bits)).astype(np.uint8)).view(np.uint64)[0])


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted hashes of the set of shingles; fewer words than a shingle are one."""
    digest = xxhash.xxh3_64_digest
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(size)))] or ([b" ".join(words)] if words else [])
    return np.unique(np.frombuffer(b"".join(map(digest, shingles)), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each of the BANDS bands of WIDTH min-hashes."""
    low = np.full(len(MULTIPLIERS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(low, (hashes[at : at + 256, None] * MULTIPLIERS).min(axis=0), out=low)
    mixed = ((low ^ (low >> np.uint64(29))) * MULTIPLIERS[::-1]).reshape(BANDS, WIDTH).sum(axis=1, dtype=np.uint64)
    return mixed ^ (mixed >> np.uint64(32))


def sketch(hashes: np.ndarray) -> bytes:
    """Of sorted hashes, for each of BINS equal ranges: whether it holds any (first half), and a bit of its least (second half)."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(hashes, edges)
    held = np.append(first[1:], len(hashes)) > first
    bit = np.zeros(BINS, bool)
    bit[held] = hashes[first[held]] & np.uint64(1)
    return np.packbits(held).tobytes() + np.packbits(bit).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def may_be_alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Of sketches (rows of 64-bit words) and set sizes: false where ``least`` is out of reach.

    The least hashes of the occupied bins are a sample of the union without replacement, and different ones agree in their
    bit by chance; a pair goes if the estimate is DEVIATIONS standard errors below ``least``, or by the sizes alone.
    """
    half = a.shape[1] // 2
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64).astype(float)
    both, either = count(a[:, :half] & b[:, :half]), np.maximum(count(a[:, :half] | b[:, :half]), 1)
    agree = count(a[:, :half] & b[:, :half] & ~(a[:, half:] ^ b[:, half:]))
    union = np.maximum((na + nb) / (1 + least), 1)
    error = least * (1 - least) / either * np.clip(1 - either / union, 0, 1) + np.maximum(both - least * either, 1) / either**2
    return ((2 * agree - both) / either >= least - DEVIATIONS * np.sqrt(error)) & (np.minimum(na, nb) >= least * np.maximum(na, nb))


def band_columns() -> list[Column]:
    return [F.col("bands")[i].bitwiseOR(F.lit(-(2**63))) for i in range(BANDS)]


def open_classes(nodes: DataFrame, keys: list[Column], first: int, distance: int | None = None) -> DataFrame:
    """Of nodes (node, c, fp, ...): (k, j, node, c) for each key, the ``first`` + nth is j, that nodes of different components c share.

    With ``distance`` the keys are variants. A pair with an equal segment is found in that segment's first variant, another
    in the variant of the bit that differs; so of a segment's other variants only those are kept whose bit differs in the
    class. Classes are judged with partial sums; a bit table keeps rows of all others out of the second shuffle.
    """
    rows = nodes.select("node", "c", "fp", F.posexplode(F.array(*keys)).alias("j", "k")).withColumn("j", F.col("j") + F.lit(first))
    judged = [F.min("c").alias("least"), F.max("c").alias("most")]
    useful = F.col("least") < F.col("most")
    if distance is not None:  # segments follow one another, so the left-out bit of the nth variant is the nth
        bit = F.getbit("fp", F.col("j"))
        judged += [F.min("j").alias("bit"), F.min(bit).alias("low"), F.max(bit).alias("high")]
        useful &= F.col("bit").isin([at for at, _ in segments(distance)]) | (F.col("low") < F.col("high"))
    mixed = materialize(rows.groupBy("k").agg(*judged).where(useful).select("k"))
    table = bit_table(mixed, "k")
    out = materialize(with_bit(rows, "k", table).where("_hit").join(mixed, "k", "left_semi").select("k", "j", "node", "c"))
    release(mixed, table)
    return out


def hub_pairs(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of classes (k, j, node, c) with nodes of different components c: pairs (a, b) of each class's hub and its nodes of other
    components, and the rows without the hubs.

    The hub is the node that meets most nodes of other components over all its classes: the middle of a group of copies.
    """
    alike = open_.groupBy("k", "c").agg(F.count("*").alias("m"))
    sizes = alike.groupBy("k").agg(F.sum("m").alias("n"))
    meets = open_.join(alike, ["k", "c"]).join(sizes, "k").groupBy("node").agg(F.sum(F.col("n") - F.col("m")).alias("meets"))
    best = open_.join(meets, "node").groupBy("k").agg(F.max(F.struct("meets", F.negative("node").alias("x"), "c")).alias("h"))
    rows = materialize(open_.join(best.select("k", F.negative("h.x").alias("hub"), F.col("h.c").alias("hc")), "k"))
    pairs = rows.where("c <> hc").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    return pairs, rows.where("node <> hub").select("k", "j", "node", "c")


def relabelled(open_: DataFrame, groups: DataFrame) -> DataFrame:
    """The classes (k, j, node) that still have nodes of different components, by components (node, label)."""
    rows = materialize(open_.join(groups, "node", "left").select("k", "j", "node", F.coalesce("label", "node").alias("c")))
    mixed = rows.groupBy("k").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("k")
    out = materialize(rows.join(mixed, "k", "left_semi"))
    release(rows)
    return out


def crossing_pairs(open_: DataFrame, nodes: DataFrame, distance: int, least: float) -> DataFrame:
    """(a, b): of classes (k, j, node, c) all pairs of nodes with different c that may be alike, each from the first class it shares.

    A class is cut into parts, and every two parts meet in a block, so a large class is spread over many tasks.
    """
    n = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants_ = len(variant_keys(distance))
    sizes = open_.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = open_.join(sizes, "k").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(nodes, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("k", "j", "node", "c", "part", "fp", "size", "bands", "sketch", other)
    rows = rows.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")}).drop("other")

    def met(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, c, part, fp, size = (group.column(x).to_numpy() for x in ("node", "c", "part", "fp", "size"))
        bands = group.column("bands").combine_chunks()
        bands = (bands.chunk(0) if isinstance(bands, pa.ChunkedArray) else bands).flatten().to_numpy().reshape(-1, BANDS)
        words = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        j, x, y = (group.column(name)[0].as_py() for name in ("j", "x", "y"))
        found: list[np.ndarray] = []
        for i in range(len(node)):
            at = np.flatnonzero((node > node[i]) & (c != c[i]) & ((part != part[i]) if x != y else True))
            if not len(at):
                continue
            same = bands[at] == bands[i]
            if j >= variants_:
                first = same[:, j - variants_] & ~same[:, : j - variants_].any(axis=1)
            else:
                differ = (fp[at] ^ fp[i]).view(np.uint64)
                first = ~same.any(axis=1) & (np.bitwise_count(differ) <= distance) & (first_variant(differ, distance) == j)
            at = at[first]
            at = at[may_be_alike(np.broadcast_to(words[i], (len(at), words.shape[1])), words[at], size[i], size[at], least)] if len(at) else at
            if len(at):
                found.append(np.stack([np.full(len(at), node[i]), node[at]]))
        return tuple(np.concatenate(found, axis=1)) if found else (np.empty(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            k, x, y = (table.column(c).to_numpy() for c in ("k", "x", "y"))
            edges = np.flatnonzero((np.diff(k) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(k)]):
                if z - a > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in met(table.slice(a, z - a).combine_chunks())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, table]) if held is not None else table
                k, x, y = (held.column(c).to_numpy() for c in ("k", "x", "y"))
                other_ = np.flatnonzero((k != k[-1]) | (x != x[-1]) | (y != y[-1]))
                if len(other_):
                    yield from of(held.slice(0, int(other_[-1]) + 1))
                    held = held.slice(int(other_[-1]) + 1)
        if held is not None:
            yield from of(held)

    return rows.repartition(n, "k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(run, "a long, b long").distinct()


def first_variant(differ: np.ndarray, distance: int) -> np.ndarray:
    """The number of the first variant that fingerprints share whose bits ``differ``; -1 if none."""
    out, number = np.full(len(differ), -1, np.int64), 0
    for at, n in segments(distance):
        part = (differ >> np.uint64(at)) & np.uint64((1 << n) - 1)
        bit = np.bitwise_count(part - np.uint64(1)) * (part != 0)  # of a power of two, its position
        out = np.where((out < 0) & (np.bitwise_count(part) <= 1), number + bit.astype(np.int64), out)
        number += n
    return out


def verified_links(nodes: DataFrame, distance: int, least: float, sets_of: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of alike nodes that connect all that any candidate pairs connect.

    In each round the hub of every band's class is verified against the class's nodes of other components and then leaves
    the class, and classes that verified links join as a whole are done. Some rounds make one component of most groups
    of copies. After them every pair that is left in a class, of a band or of variants of SimHashes, is decided, unless
    verified links join it.
    """
    own = variant_keys(distance)
    open_ = open_classes(nodes.withColumn("c", F.col("node")), band_columns(), len(own))
    sets = sets_of(open_.select("node"))
    links = nodes.sparkSession.createDataFrame([], "a long, b long")
    groups = nodes.sparkSession.createDataFrame([], "node long, label long")
    for _ in range(ROUNDS):
        if is_empty(open_):
            break
        pairs, rest = hub_pairs(open_)
        links = materialize(links.unionByName(verify(pairs, sets)))
        groups = materialize(components(links))
        open_ = relabelled(rest.select("k", "j", "node"), groups)
    release(sets)
    labelled = nodes.join(groups, "node", "left").withColumn("c", F.coalesce("label", "node"))
    open_ = open_.unionByName(open_classes(labelled, own, 0, distance))
    pairs = materialize(crossing_pairs(open_, nodes, distance, least))
    return materialize(links.unionByName(verify(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))))))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays (nulls last).

    Rows with equal sets of ``words``-word shingles (A-Z in lower case) are one node. Nodes are linked if the similarity of
    their whole sets is ``least`` or more. Candidates are nodes whose SimHashes of word sets are within ``distance`` bits
    (deletion variants), or that share a band of min-hashes; each such pair is decided unless verified links join it
    already. Texts without words are alike, null and empty ones included. All columns are kept as they are, whatever their
    names. Of equal rows one stays. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    at = docs.columns.index(text_col)
    whole = docs.select(whole_row(docs))
    kinds = [("fp", T.LongType()), ("s1", T.LongType()), ("s2", T.LongType()), ("size", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]
    schema = T.StructType([*whole.schema.fields, *(T.StructField(c, t) for c, t in kinds)])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [split_words(t.as_py()) for t in batch.column(0).field(at)]
            sets = [shingle_set(w, words) for w in split]
            fps = np.fromiter(map(word_set_fingerprint, split), np.uint64, len(split))
            same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
            bands = np.concatenate([band_keys(x) for x in sets] or [np.empty(0, np.uint64)]).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)), pa.array(bands))
            columns = [pa.array(fps.view(np.int64)), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array([len(x) for x in sets], pa.int64()), bands, pa.array([sketch(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    rows = materialize(whole.mapInArrow(made, schema).withColumn("row", F.monotonically_increasing_id()))
    own_id = F.col("doc").getField(id_col)
    short = rows.select("s1", "s2", F.struct(own_id.isNull().alias("none"), own_id.cast("long").alias("id"), "row").alias("at"))
    first = materialize(short.groupBy("s1", "s2").agg(F.min("at").alias("at")).select("at", F.col("at.row").alias("row")))
    features = rows.select(F.col("row").alias("node"), "fp", "size", "bands", "sketch")
    nodes = materialize(features.join(first.select(F.col("row").alias("node")), "node", "left_semi"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(split_words(t.as_py()), words).tobytes() for t in batch.column(1)], pa.binary())], ["node", "hashes"])

    def sets_of(some: DataFrame) -> DataFrame:
        """The whole sets of nodes that have candidates."""
        texts = rows.select(F.col("row").alias("node"), F.col("doc").getField(text_col).alias("text"))
        return materialize(with_bit(texts, "node", bit_table(some, "node")).where("_hit").select("node", "text").mapInArrow(to_sets, "node long, hashes binary"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(0), batch.column(1))):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep[i] = min(len(a), len(b)) >= least * max(len(a), len(b)) and similarity(a, b) >= least
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[2:]], ["a", "b"])

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs whose whole sets are alike."""
        both = pairs.join(sets.toDF("b", "hb"), "b").join(sets.toDF("a", "ha"), "a")
        return both.select("ha", "hb", "a", "b").mapInArrow(alike, "a long, b long")

    groups = components(verified_links(nodes, distance, least, sets_of, verify))
    member = materialize(groups.select("node", "label").unionByName(groups.select(F.col("label").alias("node"), "label").distinct()))
    ends = member.join(first.select("at", F.col("row").alias("node")), "node")
    stays = ends.groupBy("label").agg(F.min("at").alias("at")).select(F.col("at.row").alias("node"))
    copies = rows.select("row").join(first, "row", "left_anti")
    gone = materialize(copies.unionByName(member.select("node").join(stays, "node", "left_anti").withColumnRenamed("node", "row")))
    release(nodes)
    # Only rows that may be among those are shuffled.
    marked = with_bit(rows.select("row", "doc"), "row", bit_table(gone, "row"))
    return marked.where("not _hit").select("doc.*").unionByName(marked.where("_hit").join(gone, "row", "left_anti").select("doc.*"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return near_duplicates(documents(spark, sf_dir))
