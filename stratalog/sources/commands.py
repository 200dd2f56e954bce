"""Command lines: what each one asks for, and its arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Command grammar, in the order in which it is tried (fixed values).
GRAMMAR = [
    ("get", 2, r"^get\s\w+$"),
    ("delete", 3, r"^delete\s\w+$"),
    ("put", 1, r"^put\s\w+\s.+$"),
    ("exit", -1, r"^exit$"),
    ("make", 4, r"^(bf|cms|hll) make \w+$"),
    ("destroy", 5, r"^(bf|cms|hll) destroy \w+$"),
    ("fingerprint", 8, r"^fingerprint \w+ .+$"),
    ("add", 6, r"^(bf|cms|hll) put \w+ .+$"),
    ("check", 7, r"^(bf|cms) check \w+ .+$|^hll check \w+$"),
    ("simhash", 9, r"^simhash \w+ \w+$"),
    ("prefixscan", 10, r"^prefixscan \w+ \d+ \d+$"),
    ("rangescan", 11, r"^rangescan \w+-\w+ \d+ \d+$"),
    ("prefixiterate", 12, r"^prefixiterate \w+$"),
    ("rangeiterate", 13, r"^rangeiterate \w+-\w+$"),
]
INVALID = 0
#: Valid lines that cost no token: they go on with an open cursor.
FREE = r"^(next|stop)$"


def option(line: Column) -> Column:
    out = F.lit(INVALID)
    for _, code, pattern in reversed(GRAMMAR):
        out = F.when(line.rlike(pattern), F.lit(code)).otherwise(out)
    return out


def parse(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds option (its code), charged (it takes a token), key and argument to command lines; trailing line ends are dropped.

    A null line is invalid. ``put`` keeps everything after the key, one blank apart, as its argument.
    """
    line = F.coalesce(F.rtrim(F.regexp_replace(F.col(line_col), r"[\r\n]+$", "")), F.lit(""))
    out = lines.withColumn("__line", line)
    line = F.col("__line")
    key = F.regexp_extract(line, r"^(?:put|get|delete|fingerprint|simhash|prefixscan|prefixiterate|(?:bf|cms|hll) (?:make|destroy|put|check)) (\w+)", 1)
    argument = F.regexp_extract(line, r"^(?:put|fingerprint|simhash|(?:bf|cms|hll) (?:put|check)) \w+ (.+)$", 1)
    out = out.withColumns({"option": option(line), "key": key, "argument": argument})
    return out.withColumn("charged", F.col("option") != INVALID).drop("__line")


def operations(parsed: DataFrame) -> DataFrame:
    """The puts and deletes among parsed commands, as (seq, ts, key, value, tombstone)."""
    rows = parsed.where(F.col("option").isin(1, 3))
    return rows.select("seq", "ts", "key", F.col("argument").cast("binary").alias("value"), (F.col("option") == 3).alias("tombstone"))


def scans(parsed: DataFrame, line_col: str = "line") -> DataFrame:
    """(seq, prefix, low, high, page, size) of the scan commands; numbers beyond a long are null, as are the parts that a command lacks."""
    line = F.rtrim(F.regexp_replace(F.col(line_col), r"[\r\n]+$", ""))
    part = lambda pattern, i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    numbers = r"^(?:prefixscan|rangescan) \S+ (\d+) (\d+)$"
    return parsed.where(F.col("option").isin(10, 11)).select(
        "seq", part(r"^prefixscan (\w+) ", 1).alias("prefix"), part(r"^rangescan (\w+)-(\w+) ", 1).alias("low"), part(r"^rangescan (\w+)-(\w+) ", 2).alias("high"),
        part(numbers, 1).try_cast("long").alias("page"), part(numbers, 2).try_cast("long").alias("size"),
    )


def text_lines(rows: DataFrame, number: str = "place") -> DataFrame:
    """(place, line): the numbered lines in which a scan is shown."""
    text = F.concat(F.col(number).cast("string"), F.lit(". key: "), F.col("key"), F.lit("\tvalue: "), F.coalesce(F.col("value").cast("string"), F.lit("")))
    return rows.select(F.col(number).alias("place"), text.alias("line"))
