"""Secret scans: a random forest removes false positives. DataFrame functions only on the path over documents.

Candidates are long unbroken tokens. Their length, runs and changes of character classes, how much of them common
words cover, whether they stand in a path or URL, and the words next to them are computed as columns. The forest is
grown on the driver from labelled findings, a bounded table, and becomes one column expression of nested conditions.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import content_key, documents, whole_row

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
BEFORE, AFTER = 64, 32
TREES, DEPTH, LEAST_LEAF = 24, 6, 4
#: Labelled findings that the forest is grown from, at most.
MAX_FINDINGS = 20_000
THRESHOLD = 0.5
#: Common words and syllables whose cover speaks against a secret (fixed values).
DICTIONARY = (
    "the and ing ion tion ent for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat den und ein sch ich che ung ver ber heit keit lich que ment eau aux elle"
    " ción mente ado ara los las example test sample dummy placeholder your here user name key value data file path index module class function string image content default config"
).split()
# What the words before a finding may say (fixed values).
SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|passwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key)"
DIGEST_WORDS = r"(?i)(commit|checksum|sha-?\d*|md5|digest|etag|uuid|guid|hash|revision|integrity)"
DUMMY_WORDS = r"(?i)(example|sample|dummy|placeholder|your|xxxx|test|fake|redacted|changeme|lorem)"

FEATURES = ["size", "runs", "changes", "digits", "uppers", "alphanumeric", "hex", "distinct", "covered", "longest_letters", "path", "assigned", "quoted", "secret_word", "digest_word", "dummy_word", "own_dummy"]


def features(cand: Column, before: Column, after: Column) -> dict[str, Column]:
    n, low = F.length(cand), F.lower(cand)
    share = lambda kind: (n - F.length(F.regexp_replace(cand, kind, ""))) / n
    flag = lambda c: c.cast("double")
    runs = F.regexp_count(cand, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"))
    whole = F.concat(F.right(before, F.lit(1)), cand)
    cols = {
        "size": n, "runs": runs, "changes": runs / n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "alphanumeric": share("[A-Za-z0-9]"),
        "hex": flag(cand.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "distinct": F.size(F.array_distinct(F.split(cand, ""))) / F.least(n, F.lit(64)),
        "covered": (n - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))) / n,
        "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(cand, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)),
        "path": flag(whole.rlike("^[./:~]|^.?[A-Za-z0-9_-]{1,24}/[A-Za-z0-9_/-]+$") | before.rlike(r"(://|\w/|\\)\S*$")),
        "assigned": flag(before.rlike("[=:]\\s*[\"'`]?$")), "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "secret_word": flag(before.rlike(SECRET_WORDS + r"\W{0,6}$")), "digest_word": flag(before.rlike(DIGEST_WORDS + r"\W{0,6}$")),
        "dummy_word": flag(F.concat(before, after).rlike(DUMMY_WORDS)), "own_dummy": flag(cand.rlike(DUMMY_WORDS) | cand.rlike(r"(.)\1{5}|0123456789|abcdefgh")),
    }
    return {k: cols[k].cast("double") for k in FEATURES}


def candidates(docs: DataFrame) -> DataFrame:
    """From (doc_id, text): (doc_id, k1, k2, nth, start, cand, before, after) per candidate; start counts characters."""
    rows = docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", "text", *content_key(F.col("doc_id"), F.col("text")))
    cut = rows.select("doc_id", "k1", "k2", F.split("text", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    near = F.transform(F.col("found"), lambda c, i: F.struct(c.alias("cand"), F.length(F.get(F.col("gaps"), i)).alias("gap"), F.right(F.get(F.col("gaps"), i), F.lit(BEFORE)).alias("before"), F.left(F.get(F.col("gaps"), i + 1), F.lit(AFTER)).alias("after")))
    each = cut.select("doc_id", "k1", "k2", F.posexplode(near).alias("nth", "x")).select("doc_id", "k1", "k2", "nth", "x.*")
    order = Window.partitionBy("k1", "k2", "copy").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Equal rows are told apart by a number, so that places are summed over one row's candidates only.
    each = each.withColumn("copy", F.row_number().over(Window.partitionBy("k1", "k2", "nth").orderBy("nth")))
    return each.withColumn("start", F.sum(F.col("gap") + F.length("cand")).over(order) - F.length("cand")).drop("gap", "copy")


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """(text around a candidate, 1 for a secret): findings of the usual kinds, true and false, from a fixed seed."""
    rng = random.Random(seed)
    alnum, lower_hex = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    syllables = [w for w in DICTIONARY if w.isascii() and len(w) < 6]
    take = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k))
    values = [
        lambda: take(lower_hex, rng.choice([32, 40, 48, 64])), lambda: take(lower_hex, rng.choice([32, 40])).upper(), lambda: take(alnum, rng.randint(20, 64)),
        lambda: take(alnum + "+/", rng.choice([27, 43, 86])) + "=", lambda: "AK" + take(alnum[:26] + "0123456789", 18), lambda: "gh" + rng.choice("pos") + "_" + take(alnum, 36), lambda: "sk-" + take(alnum, rng.choice([32, 48])),
    ]
    names = ["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "Bearer", "credential", "private_key", "API-KEY", "SECRET_KEY"]
    joins = [' = "{}"', '="{}"', ": {}", "={}", ": '{}'", " {}", ' := "{}"']
    false = [
        lambda: prose(1) + " " + "".join(rng.choice(syllables) for _ in range(rng.randint(7, 14))), lambda: rng.choice(names) + rng.choice(joins).format("your_" + rng.choice(["api_key", "secret_token", "access_key"]) + "_here_" + word()),
        lambda: rng.choice(names) + rng.choice(joins).format(rng.choice(["x", "0", "X", "a", "-"]) * rng.randint(20, 40)), lambda: rng.choice(["see ", "from ", "in ", "/", "./", "open "]) + "/".join(word() for _ in range(rng.randint(4, 7))),
        lambda: "https://" + word() + ".example.com/" + "-".join(word() for _ in range(rng.randint(4, 8))), lambda: rng.choice(["commit ", "sha1: ", "checksum=", "md5: ", "sha256:", "digest ", "etag: "]) + take(lower_hex, rng.choice([32, 40, 64])),
        lambda: rng.choice(["uuid ", "id: ", "guid="]) + "-".join(take(lower_hex, k) for k in (8, 4, 4, 4, 12)), lambda: "data:image/png;base64," + take(alnum + "+/", rng.randint(120, 400)),
        lambda: "".join(w.title() for w in prose(rng.randint(5, 9)).split()), lambda: "_".join(word() for _ in range(rng.randint(4, 8))), lambda: rng.choice(["phone ", "number ", "card "]) + take("0123456789", rng.randint(20, 30)),
        lambda: rng.choice(names) + rng.choice(joins).format("EXAMPLE" + take(alnum[:26], 4) + "EXAMPLEKEY" + take("0123456789", 4)), lambda: "-" * rng.randint(20, 60), lambda: "_" * rng.randint(20, 60),
        lambda: rng.choice(names) + " of the " + "".join(rng.choice(syllables) for _ in range(9)),
    ]
    out = []
    for i in range(n):
        body = rng.choice(names) + rng.choice(joins).format(rng.choice(values)()) if i % 2 else rng.choice(false)()
        out.append((f"{prose(rng.randint(0, 6))} {body} {prose(rng.randint(0, 4))}", i % 2))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> tuple | float:
    """A tree: (feature, cut, left, right), or a leaf's share of label 1; a random part of the features at each split."""
    share = float(y.mean()) if len(y) else 0.5
    if depth == 0 or len(y) < 2 * LEAST_LEAF or share in (0.0, 1.0):
        return round(share, 6)
    best = (1e-9, None)
    for j in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAST_LEAF) & (at <= len(y) - LEAST_LEAF)]
        if len(at):
            n, left = len(y), t[at - 1]
            gini = lambda k, s: s * (k - s) / k
            gain = gini(n, t[-1]) - gini(at, left) - gini(n - at, t[-1] - left)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (int(j), float((v[at[k]] + v[at[k] - 1]) / 2)))
    if best[1] is None:
        return round(share, 6)
    j, cut = best[1]
    low = x[:, j] <= cut
    return j, cut, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 4) -> list:
    rng = np.random.default_rng(seed)
    bags = [rng.integers(0, len(y), len(y)) for _ in range(trees)] if len(y) else [np.zeros(0, int)]
    return [grow(x[b], y[b], rng) for b in bags]


def predict(tree: tuple | float, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_column(tree: tuple | float) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    j, cut, left, right = tree
    return F.when(F.col(FEATURES[j]) <= cut, tree_column(left)).otherwise(tree_column(right))


def train(spark: SparkSession, findings: list[tuple[str, int]] | None = None) -> list:
    """The forest of the labelled findings (text around a candidate, label)."""
    findings = labelled_findings() if findings is None else findings
    if len(findings) > MAX_FINDINGS:
        raise ValueError(f"{len(findings)} labelled findings; at most {MAX_FINDINGS} are taken")
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(findings)], "doc_id long, text string")
    made = candidates(rows).withColumns(features(F.col("cand"), F.col("before"), F.col("after"))).select("doc_id", "start", *FEATURES).collect()
    made = sorted(made)
    return forest(np.array([r[2:] for r in made], float).reshape(len(made), len(FEATURES)), np.array([findings[r[0]][1] for r in made], float))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: list[tuple[str, int]] | None = None) -> DataFrame:
    """A row per candidate: doc_id, nth (in its document), start, length (characters), score, is_secret, finding.

    The score is the forest's mean share of true findings, 0 to 1. Null, empty and candidate-free texts have no rows.
    Repeated rows have theirs each; null ids are kept. An empty table gives an empty result. Other columns are not
    looked at.
    """
    trees = train(docs.sparkSession, findings)
    rows = candidates(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    wide = rows.withColumns(features(F.col("cand"), F.col("before"), F.col("after")))
    score = reduce(lambda a, b: a + b, map(tree_column, trees)) / len(trees)
    out = wide.select("doc_id", "nth", F.col("start").cast("long").alias("start"), F.length("cand").alias("length"), F.round(score, 6).alias("score"), F.col("cand").alias("finding"))
    return out.select("doc_id", "nth", "start", "length", "score", (F.col("score") >= THRESHOLD).alias("is_secret"), "finding")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """The documents with the findings that are secrets masked, by id; longer ones first, so that none is left in part.

    All columns are kept, whatever their names. Rows that share an id get the findings of all of them; null ids get none.
    """
    size = F.array_sort(F.collect_set(F.struct((-F.length("finding")).alias("size"), "finding")))
    bad = found.where("is_secret").groupBy("doc_id").agg(size.alias("bad"))
    rows = docs.select(whole_row(docs), F.col(f"`{id_col}`").cast("long").alias("doc_id")).join(bad, "doc_id", "left")
    own = lambda c: F.col("doc").getField(c)
    clean = F.when(F.col("bad").isNull(), own(text_col)).otherwise(F.aggregate("bad", own(text_col), lambda t, b: F.replace(t, b["finding"], F.lit(mask))))
    return rows.select(*[(clean if c == text_col else own(c)).alias(c) for c in docs.columns])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir))
    return rows.select("doc_id", "nth", "start", "length", "score", "is_secret", F.sha2("finding", 256).alias("finding_sha256"))
