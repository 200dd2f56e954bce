"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the token positions of a span and ignore the others; the hashes of the selected tokens of
test items and of training documents are joined, and around each hit the item is laid over the document on that
diagonal and the equal tokens are counted, so that substituted words are tolerated. The masks are complete for the
overlap that counts (13 tokens of which at most 2 differ): every such overlap makes a hit under one of them.

Documents are only read, in one map over them, without a shuffle. The index of the items goes to every executor; it
is built in blocks of a bounded number of tokens, and more items mean more passes, not a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, documents, whole_row

#: Of any 13 positions of which at most 2 differ, each of these finds a place with all its ones on equal tokens (tested).
MASKS = ("11001011", "11010011")
WINDOW, SHARE = 13, 0.8
#: Items with fewer tokens than this say too little to tell a copy; they take no part.
LEAST_TOKENS = 5
#: Tokens of items in a block: about 24 bytes each under each mask, 150 MB in all.
BLOCK_TOKENS = 2_000_000
BLOCK_BYTES = 1 << 20
TABLE_BITS = 22
#: Hits that are reduced to diagonals at once, beyond those of one place.
HITS = 1 << 20
P = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), 95, *range(128, 256)]] = True


def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(BLOCK_BYTES + 1, P, np.uint64)
    down = np.full(BLOCK_BYTES + 1, pow(P, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def tokens(text: str) -> np.ndarray:
    """A 64-bit hash for each word of the text, in order. Words: runs of letters, digits, _ and non-ASCII, lower case."""
    if not _TABLES:
        _TABLES.extend(_powers())
    up, down = _TABLES
    data = text.lower().encode("utf-8", "surrogatepass")
    if not data.isascii():
        for mark in " ‘’“”–—…":
            data = data.replace(mark.encode(), b" ")
    raw, out, at = np.frombuffer(data, np.uint8), [], 0
    with np.errstate(over="ignore"):
        while at < len(raw):
            end = min(len(raw), at + BLOCK_BYTES)
            block = raw[at:end]
            word = _WORD[block]
            if end < len(raw) and word[-1]:  # cut between words, unless one word fills the block
                gaps = np.flatnonzero(~word)
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    block, word = raw[at:end], word[: end - at]
            edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            first, last = edge[::2], edge[1::2]
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
            out.append(_mixed((sums[last] - sums[first]) * down[first]))
            at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def seeds(tok: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the selected tokens at every place where the mask fits."""
    n = len(tok) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for i, on in enumerate(mask):
            if on == "1":
                h = (h ^ tok[i : i + n]) * np.uint64(P) + (h >> np.uint64(32))
    return h


class Index:
    """Seeds of a block of items: under each mask the sorted hashes with item and place, and a table that rules most out."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in ((i, tokens(t)) for i, t in items) if len(t) >= LEAST_TOKENS]
        self.short = [k for k, (_, t) in enumerate(self.items) if len(t) < WINDOW]
        self.masks = []
        masks = [(m, range(len(self.items))) for m in MASKS]
        masks += [("1" * n, [k for k in self.short if len(self.items[k][1]) == n]) for n in range(LEAST_TOKENS, WINDOW)]
        for mask, which in masks:
            found = [seeds(self.items[k][1], mask) for k in which]
            if not sum(map(len, found)):
                continue
            h = np.concatenate(found)
            item = np.repeat(np.array(list(which), np.int32), [len(x) for x in found])
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.masks.append((mask, h[order], item[order], place[order], table))

    def overlap(self, item: int, tok: np.ndarray, shift: int) -> tuple[int, int]:
        """(equal, window) of the best window of the item laid over the document with its token 0 on token ``shift``."""
        want = self.items[item][1]
        lo, hi = max(0, -shift), min(len(want), len(tok) - shift)
        same = (want[lo:hi] == tok[lo + shift : hi + shift]).astype(np.int64)
        window = min(WINDOW, len(want))
        if len(same) < window:
            return 0, window
        sums = np.concatenate([[0], np.cumsum(same)])
        return int((sums[window:] - sums[:-window]).max()), window

    def best(self, text: str) -> tuple[int, int, int] | None:
        """(item_id, equal, window) of the largest overlap that counts, ties to the smaller item_id."""
        tok = tokens(text)
        pairs: set[tuple[int, int]] = set()
        for mask, h, item, place, table in self.masks:
            got = seeds(tok, mask)
            at = np.flatnonzero(table[(got >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            if len(at):
                lo, hi = np.searchsorted(h, got[at], "left"), np.searchsorted(h, got[at], "right")
                full = np.flatnonzero(hi > lo)
                n = (hi - lo)[full]
                # Hits become diagonals some at a time: a word that text and item repeat has as many hits as the product.
                share = np.cumsum(n) // HITS
                for i in np.unique(share):
                    some = np.flatnonzero(share == i)
                    m = n[some]
                    where = np.repeat(lo[full][some] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    key = (item[where].astype(np.int64) << 40) + (np.repeat(at[full][some], m) - place[where]) + (1 << 39)
                    key = np.unique(key)
                    pairs.update(zip((key >> 40).tolist(), ((key & ((1 << 40) - 1)) - (1 << 39)).tolist()))
        top = None
        for k, shift in pairs:
            same, window = self.overlap(k, tok, shift)
            if same >= SHARE * window and (len(self.items[k][1]) >= WINDOW or same == window):
                key = (same / window, -self.items[k][0])
                if top is None or key > top[0]:
                    top = key, (self.items[k][0], same, window)
        return top and top[1]


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    # A token takes two bytes at least, with what stands between.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * BLOCK_TOKENS)))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) for i in range(blocks)]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, contaminated, item_id, n_equal, n_window (of its largest overlap; null if none), text.

    A document is contaminated if 13 tokens in a row of an item stand in it in place with at least 80 % of them equal;
    an item of 5 to 12 tokens must stand in it whole. Items with fewer tokens, or a null id or text, take no part. A
    null or empty text is clean. Repeated rows get the same result each, ties go to the larger share, then the smaller
    item_id. Empty tables: no rows, or all clean. Other columns are not looked at.
    """
    arrow_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("n_equal"), F.lit(None).cast("int").alias("n_window"))
    for block in _item_blocks(items, item_col, item_text_col):
        index = sc.broadcast([(r.item_id, r.text) for r in block.collect()])  # BLOCK_TOKENS tokens at most

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = Index(index.value)
            for batch in batches:
                cols = [c.to_pylist() for c in batch.columns[2:]]
                for row, text in enumerate(batch.column(1)):
                    now = text.as_py()
                    found = own.best(now) if now else None
                    if found and (cols[0][row] is None or (found[1] / found[2], -found[0]) > (cols[1][row] / cols[2][row], -cols[0][row])):
                        for c, v in zip(cols, found):
                            c[row] = v
                kinds = [pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "text", "item_id", "n_equal", "n_window"])

        out = out.mapInArrow(run, "doc_id long, text string, item_id long, n_equal int, n_window int")
    return out.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "n_equal", "n_window", "text")


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are clean, all columns as they are, whatever their names."""
    arrow_batches(docs.sparkSession)
    sc, out, at = docs.sparkSession.sparkContext, docs.select(whole_row(docs)), docs.columns.index(text_col)
    for block in _item_blocks(items, "item_id", "text"):
        index = sc.broadcast([(r.item_id, r.text) for r in block.collect()])  # BLOCK_TOKENS tokens at most

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = Index(index.value)
            for batch in batches:
                yield batch.filter(pa.array([own.best(t.as_py() or "") is None for t in batch.column(0).field(at)], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.select("doc.*")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents(spark, sf_dir), items).drop("text")
