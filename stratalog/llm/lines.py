"""Line dedup: hashes range-partitioned with a secondary sort, per-document keep bitmaps as the result.

Only DataFrame functions. Lines travel as hashes with document and position, never as text. A line's occurrences are
first combined per salt of the document, so a line that a third of all documents hold is spread over many tasks; what
is left of a line (a row per salt at most) is range-partitioned by hash and sorted by document and position, and one
pass tells the number of documents and which of them keeps the line. The result per document is a bitmap of its lines,
compressed as runs of dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, content_key, documents, id_text, materialize, release, whole_row, with_bit

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 64


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z in lower case, other letters as they are."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2: the row, doc_id, pos, h1, h2: the line) of every line whose key is long enough."""
    rows = docs.select("doc_id", "text", *content_key(F.col("doc_id"), F.col("text")))
    lines = rows.select("k1", "k2", "doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keys.select("k1", "k2", "doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int, keep: str) -> DataFrame:
    """(h1, h2, keeper) of the lines that at least ``min_docs`` documents hold; keeper is the largest or smallest doc_id."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = lines.withColumn("salt", F.pmod("k1", F.lit(SALTS))).repartition(n, "h1", "h2", "salt")
    once = salted.groupBy("h1", "h2", "salt", "k1", "k2", "doc_id").agg(F.min("pos").alias("pos"))
    ends = {"largest": F.max_by, "smallest": F.min_by}[keep]
    part = once.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"), ends("doc_id", "doc_id").alias("doc_id"), F.min("pos").alias("pos"))
    run = part.repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    line = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = run.select("h1", "h2", F.row_number().over(line).alias("nth"), F.sum("n").over(whole).alias("docs"), (F.max if keep == "largest" else F.min)("doc_id").over(whole).alias("keeper"))
    return told.where((F.col("nth") == 1) & (F.col("docs") >= min_docs)).select("h1", "h2", "keeper")


def dropped_runs(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: str = "largest") -> DataFrame:
    """(k1, k2, runs): for each document that loses lines the compressed bitmap, as runs (start, length) of dropped positions."""
    lines = materialize(line_hashes(docs, min_chars))
    frequent = materialize(repeated_lines(lines, min_docs, keep))
    some = with_bit(lines, "h1", bit_table(frequent, "h1")).where("_hit")  # few lines are frequent; only these are shuffled
    gone = some.join(frequent, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("k1", "k2", "pos")
    gone = gone.groupBy("k1", "k2", "pos").agg(F.lit(1).alias("one")).drop("one")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("k1", "k2").orderBy("pos"))
    runs = gone.withColumn("island", island).groupBy("k1", "k2", "island").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
    out = materialize(runs.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs")))
    release(lines, frequent)
    return out


def with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` (k1, k2, ...) with their runs, null if they have none; only rows that may have some are shuffled."""
    marked = with_bit(rows, "k1", bit_table(runs, "k1"))
    none = F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")
    own = rows.columns
    touched = marked.where("_hit").select(*own).join(runs, ["k1", "k2"], "left").select(*own, "runs")
    return marked.where("not _hit").select(*own, none).unionByName(touched)


def kept_lines(text: Column, runs: Column) -> Column:
    """The text without the lines of the runs; linear in lines, however many runs there are."""
    lines = split_lines(text)
    gone = F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(runs.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep: str = "largest") -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, dropped (the runs), kept (the remaining text).

    A line's key is the line without white space ([\\x20\\x09-\\x0D]) at its ends and with A-Z in lower case. Keys of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines but those in the
    ``keep`` ("largest" or "smallest") doc_id. A null or empty text is one empty line and stays. Equal rows (id and text)
    count as one document and get the same result each; rows that share an id but not the text count apart and keep
    together. A null id keeps a line only if no other id holds it. An empty table gives an empty result. Other columns
    are not looked at.
    """
    plain = id_text(docs, id_col, text_col)
    runs = dropped_runs(plain, min_chars, min_docs, keep)
    rows = with_runs(plain.select("doc_id", "text", *content_key(F.col("doc_id"), F.col("text"))), runs)
    n = F.aggregate("runs", F.lit(0), lambda s, r: s + r["length"])
    return rows.select(
        "doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_dropped"), F.col("runs").alias("dropped"), kept_lines(F.col("text"), F.col("runs")).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """All rows and columns of ``docs``, their texts without the lines that :func:`dedup_lines` drops; a null text stays null."""
    runs = dropped_runs(id_text(docs, id_col, text_col), **rule)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = with_runs(docs.select(whole_row(docs), *content_key(F.col(f"`{id_col}`").cast("long"), text)), runs)
    own = lambda c: F.col("doc").getField(c)
    return rows.select(*[(kept_lines(own(c), F.col("runs")) if c == text_col else own(c)).alias(c) for c in docs.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
