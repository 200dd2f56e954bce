"""Best-fit packing with a swap-based local search.

Pieces of equal length are interchangeable, so the packing is planned on the histogram of lengths (as many rows as a
sequence has tokens, at most): bins with the same content are one pattern with a count. Best fit decreasing gives the
first packing; then documents are moved between underfull bins, or exchanged one for one or two for one, whenever that
raises the sum of squared fills, until bins empty and nothing is left to gain. Every step handles all bins of a
pattern, so the plan costs the same for a thousand documents and for a trillion.

Tokens are made once, in a map over the documents that also counts the pieces of each length in its partition; a
piece's number within its length, from per-partition counts, then tells its bin and offset.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, documents, id_text, materialize

LENGTH = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: Pairs of patterns that the local search looks at, at most; it ends before if no pair has anything to gain.
STEPS = 200_000

_ENCODERS: dict[str, object] = {}


def encoder(name: str = VOCABULARY):
    """Ids of a text, as tokenizers gives them for the same vocabulary (tested), strings of special tokens included."""
    if name not in _ENCODERS:
        import public_tokenizers as pt
        import tiktoken

        with open(pt.path(f"{name}.json")) as file:
            special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}

        with open(pt.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        own = tiktoken.Encoding(name, pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        _ENCODERS[name] = lambda text: own.encode(text, allowed_special="all") if any(s in text for s in special) else own.encode_ordinary(text)
    return _ENCODERS[name]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full ones, but for the first."""
    if n <= length:
        return [(0, n)]
    head = n % length
    return [(0, head)] * (head > 0) + [(s, length) for s in range(head, n, length)]


def pieces(docs: DataFrame, length: int, name: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of its length in its partition from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(name), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), END_ID], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), length)):
                    rows.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), part, seen[n]))
                    seen[n] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Patterns (lengths, longest first) and how many bins have each, by best fit decreasing."""
    open_: dict[int, Counter] = defaultdict(Counter)  # by room left
    done: Counter = Counter()
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = min((r for r, bins in open_.items() if r >= size and bins), default=None)
            if room is None:
                pattern, bins, room = (), -(-left // (capacity // size)), capacity
            else:
                pattern, bins = open_[room].popitem()
            each = room // size
            full = min(bins, left // each)
            if full < bins and (rest := left - full * each if full == left // each else 0):
                open_[room - rest * size][pattern + (size,) * rest] += 1
                bins -= 1
                left -= rest
            if full:
                (open_[room - each * size] if room - each * size else done)[pattern + (size,) * each] += full
                left -= full * each
                bins -= full
            if bins and pattern:
                open_[room][pattern] += bins
            for r in [r for r, b in open_.items() if not b]:
                del open_[r]
    for bins in open_.values():
        done.update(bins)
    return done


def _without(pattern: tuple[int, ...], *sizes: int) -> tuple[int, ...]:
    out = list(pattern)
    for s in sizes:
        out.remove(s)
    return tuple(out)


def _trades(low: tuple[int, ...], high: tuple[int, ...], room: int) -> tuple[int, tuple, tuple] | None:
    """The exchange that brings most from the bin ``low`` into the room of ``high``: (gain, from low, from high)."""
    best = (0, (), ())
    one, two = set(low), set(high)
    for x in one:
        if best[0] < x <= room:
            best = (x, (x,), ())
        for y in two:
            if best[0] < x - y <= room:
                best = (x - y, (x,), (y,))
    if best[0] < room and len(low) > 1:
        for pair in combinations_with_replacement(sorted(one), 2):  # lengths, not pieces: 45 different ones at most fill a bin
            if pair[0] == pair[1] and low.count(pair[0]) < 2:
                continue
            for y in two:
                if best[0] < sum(pair) - y <= room:
                    best = (sum(pair) - y, pair, (y,))
    return best if best[0] else None


def local_search(bins: Counter, capacity: int, steps: int = STEPS) -> Counter:
    """Moves, one-for-one and two-for-one exchanges from the emptiest bins into fuller ones, while squared fill grows."""
    bins = Counter(bins)
    least = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    vain: set[tuple] = set()  # pairs of patterns that have nothing to trade, now or later
    moved = True
    while moved and bins.total() > least:
        moved = False
        under = sorted((p for p in bins if sum(p) < capacity), key=lambda p: (sum(p), p))
        for low, high in ((a, b) for i, a in enumerate(under) for b in reversed(under[i:])):
            if (low, high) in vain or (high == low and bins[low] < 2):
                continue
            if steps <= 0:
                return bins
            steps -= 1
            if not (trade := _trades(low, high, capacity - sum(high))):
                vain.add((low, high))
                continue
            _, give, take = trade
            n = bins[low] // 2 if high == low else min(bins[low], bins[high])
            for p, out, into in ((low, give, take), (high, take, give)):
                bins[p] -= n
                if not bins[p]:
                    del bins[p]
                new = tuple(sorted((*_without(p, *out), *into), reverse=True))
                if new:
                    bins[new] += n
            moved = True
            break
    return bins


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length its runs of numbers: rows (first number, sequence of the first, offset), sequences following one another."""
    packed = local_search(best_fit(histogram, capacity), capacity)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for pattern, n in sorted(packed.items(), reverse=True):
        offset = 0
        for size in pattern:
            runs[size].append((used[size], sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    if used != Counter(histogram):
        raise AssertionError("the plan does not hold every piece once")
    return {size: np.array(rows, np.int64) for size, rows in runs.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, name: str = VOCABULARY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an end id. Longer ones are cut into full pieces, of which the first may be shorter; no
    other is cut. A null or empty text is its end id alone. Repeated rows and null ids are documents like others. An
    empty table gives an empty result. Other columns are not looked at. Sequences have ``length`` tokens at most.
    """
    made = materialize(pieces(id_text(docs, id_col, text_col), length, name))
    counts = materialize(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``length`` rows at most
    runs = docs.sparkSession.sparkContext.broadcast(plan(histogram, length))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = made.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("n"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, n = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for s in np.unique(size):
                at, own = np.flatnonzero(size == s), runs.value[int(s)]
                run = np.searchsorted(own[:, 0], n[at], "right") - 1
                sequence[at] = own[run, 1] + n[at] - own[run, 0]
                offset[at] = own[run, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
