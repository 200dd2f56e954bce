"""Text fingerprints: signed sums of word hashes' bits, and their Hamming distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hamming, md5_low64, words

# Words that say nothing, lower case only (fixed values).
STOP_WORDS = (
    "a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "from", "by", "with",
    "about", "above", "across", "after", "against", "along", "amid", "among", "around", "as",
    "before", "behind", "below", "beneath", "beside", "between", "beyond", "but", "concerning",
    "considering", "despite", "down", "during", "except", "for", "from", "in", "inside", "into",
    "like", "near", "of", "off", "on", "onto", "out", "over", "past", "regarding", "round", "since",
    "through", "to", "toward", "under", "underneath", "until", "unto", "up", "upon", "with", "within",
    "without",
)

#: A fingerprint has 63 bits, with values 2**1 to 2**63; they are the lowest 63 bits of the word's MD5.
BITS = 63


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word, n) without stop words; case counts."""
    each = docs.select(F.col(id_col).alias("id"), F.explode(words(F.col(text_col))).alias("word"))
    return each.where(~F.col("word").isin(*STOP_WORDS)).groupBy("id", "word").agg(F.count("*").alias("n"))


def fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) per id, as a signed long. A text without words has all bits set.

    Each of the 63 columns is one sum over the words, so a row per word is never blown up to one per bit. A document's words
    are summed where they are read; what is shuffled is a row per id and task. Null texts have no words.
    """
    each = docs.select(F.col(id_col).alias("id"), F.explode_outer(words(F.col(text_col))).alias("word"))
    each = each.select("id", F.when(~F.col("word").isin(*STOP_WORDS), md5_low64(F.col("word"))).alias("h"))
    signed = lambda i: F.when(F.col("h").isNull(), 0).when(F.getbit("h", F.lit(i)) == 1, 1).otherwise(-1)
    sums = each.groupBy("id").agg(*[F.sum(signed(i)).alias(f"s{i}") for i in range(BITS)])
    weight = lambda i: F.lit(2 ** (i + 1) if i < 62 else -(2**63)).cast("long")
    total = F.lit(0).cast("long")
    for i in range(BITS):
        total = total.bitwiseOR(F.when(F.col(f"s{i}") >= 0, weight(i)).otherwise(F.lit(0).cast("long")))
    return sums.select("id", total.alias("fp"))


def distances(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """(a, b, distance) of the pairs (a, b) of names of which both have a fingerprint."""
    one, two = (fps.select(F.col("id").alias(x), F.col("fp").alias(f"fp_{x}")) for x in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", hamming(F.col("fp_a"), F.col("fp_b")).cast("long").alias("distance"))
