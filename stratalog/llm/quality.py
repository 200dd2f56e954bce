"""Quality classifier: a generalised additive model with pairwise interactions.

Boosted shallow trees, one feature at a time in turn, learn a lookup table per feature over its bins; then the pairs
that explain most of what is left get tables over two features in the same way. A score is the sum of the bins'
entries, read for a whole batch at once. The model is fitted on the driver, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, documents, whole_row

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of their ids.
MAX_TRAIN = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

# Frequent function words of four languages (fixed values).
COMMON = frozenset(
    w.encode()
    for w in "the of and to in a is that it was for on are as with his they at be this from have or by not but an de la le et les des en un une du que est pour dans par sur qui au avec se pas el los las y del con una su no es lo para der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch".split()
)

_KINDS = "upper letter digit stop bang symbol pipe bracket space newline other".split()
_TABLE = bytearray(b"o" * 256)
for _chars, _as in (
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U"), (b"abcdefghijklmnopqrstuvwxyz", "a"), (b"0123456789", "0"), (b".,;:", "."), (b"!?", "!"),
    (b"#$%&*@^~", "#"), (b"|", "|"), (b"<>{}[]()/\\=_+`\"", "<"), (b" \t\r\x0b\x0c", " "), (b"\n", "n"),
):
    for _c in _chars:
        _TABLE[_c] = ord(_as)
_TABLE = bytes(_TABLE)
_CODES = np.frombuffer(b"Ua0.!#|< no", np.uint8)
WINDOW = 512

NAMES = [
    "log_bytes", "log_words", "word_length", *(f"share_{k}" for k in _KINDS), "distinct_words", "log_distinct", "common_words", "repeated_lines",
    "line_length", "open_lines", "symbol_ends", "bang_ends", "pipe_gaps", "upper_pairs", "packed", "most_symbol", "most_upper", "most_pipe", "most_bang", "least_letter",
]


def features(text: str) -> list[float]:
    """Numbers about the whole text alone; all zero for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, nw = len(data), len(words)
    if not nw:
        return [0.0] * len(NAMES)
    kind = data.translate(_TABLE)
    codes = np.frombuffer(kind, np.uint8)
    counts = np.bincount(codes, minlength=256)[_CODES]
    distinct = len(set(words))
    lines = data.split(b"\n")
    starts = np.arange(0, n, WINDOW)
    sizes = np.minimum(WINDOW, n - starts)
    if len(starts) > 1 and sizes[-1] < WINDOW // 2:
        starts, sizes = starts[:-1], np.append(sizes[:-2], sizes[-2] + sizes[-1])

    def most(*of: str) -> np.ndarray:
        hit = np.isin(codes, np.frombuffer("".join(of).encode(), np.uint8)) if len(of) > 1 else codes == ord(of[0])
        return np.add.reduceat(hit, starts, dtype=np.int64) / sizes

    ends = b".!?:;\"'"
    return [
        np.log1p(n), np.log1p(nw), (n - counts[8] - counts[9]) / nw, *(counts / n), distinct / nw, np.log1p(distinct) / np.log1p(nw),
        sum(map(COMMON.__contains__, words)) / nw, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(1 for x in lines if x and x[-1] not in ends) / len(lines),
        (kind.count(b"# ") + kind.count(b"#n")) / nw, (kind.count(b"! ") + kind.count(b"!n")) / nw, kind.count(b" | ") / nw, kind.count(b"UU") / n, len(zlib.compress(data, 1)) / n,
        most("#").max(), most("U").max(), most("|").max(), most("!").max(), most("a", "o").min(),
    ]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, reg: float) -> np.ndarray:
    """The step for each bin: a tree of few leaves over ordered bins, split greedily."""
    edges = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + reg)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                c = np.arange(a + 1, b)
                up = gain(a, c) + gain(c, b) - gain(a, b)
                k = int(np.argmax(up))
                if up[k] > best[0]:
                    best = (float(up[k]), int(c[k]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + reg)
    return out


def _cross(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Over a grid of bins: the best cut in four quadrants, its gain and the step for each cell."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not a.size or not b.size:
        return 0.0, np.zeros_like(g)

    def quads(c: np.ndarray) -> tuple:
        one, left, top = c[a, b], c[a, -1], c[-1, b]
        return one, left - one, top - one, c[-1, -1] - left - top + one

    up = sum(x**2 / (y + reg) for x, y in zip(quads(cg), quads(ch))) - cg[-1, -1] ** 2 / (ch[-1, -1] + reg)
    i, j = np.unravel_index(int(np.argmax(up)), up.shape)
    step = np.empty_like(g)
    for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + reg)
    return float(up[i, j]), step


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Gam:
    """Tables per feature and per pair of features; ``fit`` learns them, ``score`` adds them up."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 150, pairs: int = 6, pair_rounds: int = 60, rate: float = 0.1, leaves: int = 3, reg: float = 2.0):
        self.bins, self.coarse, self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.leaves, self.reg = bins, coarse, rounds, pairs, pair_rounds, rate, leaves, reg
        self.base, self.edges, self.wide, self.tables, self.pairs = 0.0, [], [], [], []

    @staticmethod
    def _quantiles(x: np.ndarray, n: int) -> np.ndarray:
        """Cuts between bins, each midway between two values, so that none rests on a value itself."""
        values = np.unique(x)
        if len(values) > n:
            values = np.unique(np.quantile(x, np.linspace(0, 1, n + 1), method="nearest"))
        return (values[1:] + values[:-1]) / 2

    def _binned(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        fine = [np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)]
        return fine, [np.searchsorted(e, x[:, j]) for j, e in enumerate(self.wide)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        n = len(y)
        share = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [self._quantiles(x[:, j], self.bins) if n else np.zeros(0) for j in range(x.shape[1])]
        self.wide = [self._quantiles(x[:, j], self.coarse) if n else np.zeros(0) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if n == 0 or y.min() == y.max():
            return self
        fine, wide = self._binned(x)
        now = np.full(n, self.base)
        for _ in range(self.rounds):
            for j, b in enumerate(fine):
                if len(self.tables[j]) < 2:
                    continue
                p = sigmoid(now)
                step = self.rate * _tree(np.bincount(b, y - p, len(self.tables[j])), np.bincount(b, p * (1 - p), len(self.tables[j])), self.leaves, self.reg)
                self.tables[j] += step
                now += step[b]
        p = sigmoid(now)
        g, h, found = y - p, p * (1 - p), []
        for i, j in combinations(range(x.shape[1]), 2):
            shape = len(self.wide[i]) + 1, len(self.wide[j]) + 1
            cell = wide[i] * shape[1] + wide[j]
            up, _ = _cross(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)), self.reg)
            found.append((up, i, j))
        self.pairs = [(i, j, np.zeros((len(self.wide[i]) + 1, len(self.wide[j]) + 1))) for _, i, j in sorted(found, reverse=True)[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, table in self.pairs:
                p = sigmoid(now)
                cell = wide[i] * table.shape[1] + wide[j]
                _, step = _cross(*(np.bincount(cell, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p))), self.reg)
                table += self.rate * step
                now += self.rate * step[wide[i], wide[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, wide = self._binned(x)
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, fine):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[wide[i], wide[j]]
        return sigmoid(total)


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or "") for t in texts], np.float64).reshape(len(texts), len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Gam:
    """A model from the labelled documents that are not held out; equal ids count once (the text with the smallest hash)."""
    doc = F.col(id_col).cast("long")
    rows = labels.select(doc.alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(doc.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64())), batch.column(3)], ["doc_id", "label", "x", "h"])

    found = texts.join(F.broadcast(rows), "doc_id").select("doc_id", "text", "label", F.xxhash64("text").alias("h"))
    made = found.mapInArrow(run, "doc_id long, label int, x array<double>, h long")
    got = made.groupBy("doc_id").agg(F.min_by("x", "h").alias("x"), F.min("label").alias("label")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(NAMES))
    return Gam().fit(x, got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Gam, text_col: str = "text") -> DataFrame:
    """(doc, score): each row as a struct of all its columns, with its score; a map over the rows."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a few thousand numbers
    rows, at = docs.select(whole_row(docs)), docs.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = shared.value.score(_matrix(batch.column(0).field(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], schema.names)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted.

    The score is a function of the text alone, 0 to 1, higher where label 1 is likelier. Null and empty texts have the
    features zero and get the score of that. A null id is not held out. Without labels, or with one class only, every
    score is the smoothed share of label 1. Repeated rows get the same score each. An empty table gives an empty
    result. Other columns are not looked at.
    """
    model = fit(docs, labels, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    rows = score(own, model).select("doc.doc_id", "score").select("doc_id", held.alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they are, whatever their names."""
    return score(docs, fit(docs, labels, id_col, text_col), text_col).where(F.col("score") >= THRESHOLD).select("doc.*")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
