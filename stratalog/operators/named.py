"""Named Bloom filters, Count-Min sketches, HyperLogLogs and fingerprints, kept and answered from a log of commands.

A log has (seq, kind, name, action, argument). ``make`` gives the parameters ("n p", "epsilon delta" or "precision"),
``put`` an element, ``check`` a question (no argument for hll). A make whose parameters are not valid does nothing, as do
puts and checks of structures that don't exist. Checks are answered by the structures as the log leaves them. All
structures of a kind are answered at once: aggregations by name and cell, with partial sums, so a hot name or element
costs a row per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1_64, position_of
from .fingerprints import distances, fingerprint
from .sketches import elements, structures

#: What arguments of make look like (fixed values).
PARAMETERS = {"bf": r"^\d+ 0\.\d+$", "cms": r"^0\.\d+ 0\.\d+$", "hll": r"^\d+$"}
#: Precisions that a HyperLogLog may have.
PRECISIONS = range(4, 17)


def _number(argument: Column, i: int) -> Column:
    return F.try_element_at(F.split(argument, " "), F.lit(i)).try_cast("double")


def valid(kind: Column, argument: Column) -> Column:
    """Whether a make has parameters that its kind accepts; a null argument has none."""
    fits = F.lit(False)
    for k, pattern in PARAMETERS.items():
        one, two = _number(argument, 1), _number(argument, 2)
        inside = one.between(PRECISIONS.start, PRECISIONS.stop - 1) if k == "hll" else (one > 0) & (two > 0)
        fits = fits | ((kind == k) & argument.rlike(pattern) & inside)
    return F.coalesce(fits, F.lit(False))


def effective(log: DataFrame) -> DataFrame:
    """The log without makes that do nothing."""
    return log.where((F.col("action") != "make") | valid(F.col("kind"), F.col("argument")))


def sized(log: DataFrame, kind: str) -> DataFrame:
    """(name, width, depth) of the structures of a kind: bits and hashes, columns and rows, or registers and precision."""
    one, two = _number(F.col("parameters"), 1), _number(F.col("parameters"), 2)
    if kind == "bf":
        width = F.greatest(F.lit(1), F.floor(-one * F.ln(two) / (math.log(2) ** 2)))
        depth = F.greatest(F.lit(1), F.floor(width / one * math.log(2)))
    elif kind == "cms":
        width, depth = F.ceil(math.e / one), F.ceil(F.ln(1 / two))
    else:
        width, depth = F.pow(F.lit(2.0), one), one
    return structures(log).where(F.col("kind") == kind).select("name", width.cast("long").alias("width"), depth.cast("int").alias("depth"))


def _spots(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """(name, value, ..., row, pos): the cells of each value in its structure; a row per structure is few, but not bounded."""
    rows = values.join(sizes, "name").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    return rows.withColumn("pos", position_of(F.col("value"), F.col("row"), F.col("width"))).drop("width", "depth")


def _asked(log: DataFrame, kind: str) -> DataFrame:
    return log.where((F.col("kind") == kind) & (F.col("action") == "check") & F.col("argument").isNotNull()).select("name", F.col("argument").alias("value")).distinct()


def _counted(log: DataFrame, kind: str) -> DataFrame:
    put = elements(log).where((F.col("kind") == kind) & F.col("element").isNotNull())
    return put.groupBy("name", F.col("element").alias("value")).agg(F.count("*").alias("n"))


def check_blooms(log: DataFrame) -> DataFrame:
    """(name, value, present) for each question to a filter that exists."""
    log = effective(log)
    sizes = sized(log, "bf")
    bits = _spots(_counted(log, "bf").drop("n"), sizes).select("name", "pos").distinct().withColumn("is_set", F.lit(1))
    hit = _spots(_asked(log, "bf"), sizes).join(bits, ["name", "pos"], "left")
    return hit.groupBy("name", "value").agg((F.count("*") == F.count("is_set")).alias("present"))


def check_cms(log: DataFrame) -> DataFrame:
    """(name, value, estimate) for each question to a sketch that exists; never below the true count."""
    log = effective(log)
    sizes = sized(log, "cms")
    cells = _spots(_counted(log, "cms"), sizes).groupBy("name", "row", "pos").agg(F.sum("n").alias("cnt"))
    hit = _spots(_asked(log, "cms"), sizes).join(cells, ["name", "row", "pos"], "left")
    return hit.groupBy("name", "value").agg(F.min(F.coalesce("cnt", F.lit(0))).cast("long").alias("estimate"))


def check_hlls(log: DataFrame) -> DataFrame:
    """(name, estimate) for each HyperLogLog that exists and is asked; the form that is exact to its formula."""
    log = effective(log)
    sizes = sized(log, "hll")
    asked = log.where((F.col("kind") == "hll") & (F.col("action") == "check")).select("name").distinct()
    values = _counted(log, "hll").join(sizes, "name").withColumn("h", fnv1_64("value"))
    bucket = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64) - F.col("depth"))
    low = F.lit(-(2**63))
    zeros = F.when(F.col("h") == 0, 64).when(F.col("h") == low, 63).otherwise(F.bit_count(F.col("h").bitwiseAND(-F.when(F.col("h") == low, F.lit(1)).otherwise(F.col("h"))) - 1))
    registers = values.groupBy("name", bucket.alias("bucket")).agg(F.max(zeros + 1).alias("rank"))
    sums = registers.groupBy("name").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("used"))
    rows = asked.join(sizes, "name").join(sums, "name", "left")
    m, used = F.col("width").cast("double"), F.coalesce("used", F.lit(0))
    empty = m - used
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (F.coalesce("s", F.lit(0.0)) + empty)
    small, top = F.when(empty > 0, m * F.ln(m / F.when(empty > 0, empty))).otherwise(F.col("raw")), float(2**32)
    large = -top * F.ln(1 - F.when(F.col("raw") < top, F.col("raw")) / top)
    out = rows.withColumn("raw", raw)
    return out.select("name", F.when(F.col("raw") <= 2.5 * m, small).when(F.col("raw") > top / 30, large).otherwise(F.col("raw")).alias("estimate"))


def fingerprints_by_name(log: DataFrame) -> DataFrame:
    """(id, fp): the fingerprint of the last text of each name, from (seq, name, text)."""
    last = log.groupBy("name").agg(F.max_by(F.coalesce("text", F.lit("")), "seq").alias("text"))
    return fingerprint(last, "name", "text")


def simhash_answers(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, distance) for pairs of names of which both have a fingerprint."""
    return distances(asked.select("a", "b").distinct(), fingerprints_by_name(log))
