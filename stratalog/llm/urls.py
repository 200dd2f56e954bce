"""URL filters by a temporal list join.

Dated list entries (a key is listed or delisted on a day) become validity intervals; every capture is judged by the
entries active at its fetch time. Captures meet the list in equi-joins on their host, its parent domains and their path
prefixes, each narrowed to the interval that holds the fetch time: an as-of join per key. Captures that share URL and day
are one, so a hot page or host costs what it has in distinct URLs, and the list is broadcast only while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Intervals that are broadcast at most, about 100 bytes each.
BROADCAST_ROWS = 200_000
FOREVER = "9999-12-31"

#: The list of the query below (fixed values): key, category, day, action. Keys: a domain, or a domain with a path.
ENTRIES = [
    ("casino-win.example.com", "gambling", "2024-01-15", "add"),
    ("casino-win.example.com", "gambling", "2024-09-01", "remove"),
    ("adult-x.example.net", "adult", "2024-03-01", "add"),
    ("blog.tionsh.example.com", "spam", "2024-02-10", "add"),
    ("blog.tionsh.example.com", "spam", "2024-04-20", "remove"),
    ("blog.tionsh.example.com", "spam", "2024-10-05", "add"),
    ("tionble.example.org/en", "mirror", "2024-05-01", "add"),
    ("tionble.example.org/en", "mirror", "2024-07-01", "remove"),
    ("ththon.example.org/de", "mirror", "2024-06-15", "add"),
    ("ththre.example.net", "malware", "2024-01-01", "add"),
    ("ththre.example.net", "malware", "2024-01-20", "remove"),
    ("ththre.example.net", "phishing", "2024-08-01", "add"),
]


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, since, until): an entry holds until the next of its key and category; only listed ones stay.

    On one day a removal comes after an addition. Null keys, days and actions take no part; equal entries are one.
    """
    rows = entries.select(F.lower("key").alias("key"), F.coalesce("category", F.lit("")).alias("category"), F.col("day").cast("date").alias("since"), "action")
    rows = rows.where("key is not null and since is not null and action in ('add', 'remove')").distinct()
    order = Window.partitionBy("key", "category").orderBy("since", "action")
    rows = rows.withColumn("until", F.coalesce(F.lead("since").over(order), F.lit(FOREVER).cast("date")))
    return rows.where("action = 'add' and since < until").select("key", "category", "since", "until")


def host_of(url: Column) -> Column:
    """Lower case, without port, user and a leading "www."; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.regexp_replace(host, r"^www\.|\.$", "")


def depths(listed: DataFrame) -> tuple[int, int]:
    """The most host labels and the most path parts that a key of the list has."""
    at = F.split("key", "/")
    parts = F.size(F.filter(F.slice(at, 2, F.size(at)), lambda p: p != ""))
    most = listed.agg(F.max(F.size(F.split(at[0], r"\."))).alias("labels"), F.max(parts).alias("parts")).first()
    return most["labels"] or 1, most["parts"] or 0


def keys_of(url: Column, most_labels: int, most_parts: int) -> Column:
    """The host and its parent domains, each alone and with the path's first parts, as deep as the list goes."""
    host, path = host_of(url), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - most_labels + 1)
    domains = F.transform(F.sequence(first, F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = F.transform(F.sequence(F.lit(0), F.least(F.lit(most_parts), F.size(parts))), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.concat_ws("/", F.slice(parts, 1, n)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """A row per capture: page_id, fetched, host, blocked, rule (the longest active key), category, n_rules.

    A key blocks a URL if it is the host, a parent domain, or one of these with the first parts of the path, and was
    listed on the fetch day (since <= day < until). Several active: the longest, then the smallest category names the
    rule. Null or malformed URLs and null days are not blocked. Repeated rows get a row each; an empty list blocks
    nothing; empty captures give an empty result. Other columns are not looked at.
    """
    rows = captures.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("fetched"))
    valid = materialize(intervals(entries))
    small = valid.count() <= BROADCAST_ROWS
    once = rows.where("url is not null and fetched is not null").select("url", "fetched").distinct()
    probes = once.select("url", "fetched", F.explode(keys_of(F.col("url"), *depths(valid))).alias("key"))
    listed = F.broadcast(valid) if small else valid
    active = probes.join(listed, "key").where("fetched >= since and fetched < until")
    verdicts = active.groupBy("url", "fetched").agg(F.count("*").alias("n_rules"), F.min(F.struct((-F.length("key")).alias("size"), "key", "category")).alias("top"))
    verdicts = materialize(verdicts.select("url", "fetched", "n_rules", F.col("top.key").alias("rule"), F.col("top.category").alias("category")))
    out = rows.join(verdicts, ["url", "fetched"], "left")
    return out.select("page_id", "fetched", host_of(F.col("url")).alias("host"), F.col("rule").isNotNull().alias("blocked"), "rule", "category", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Pages have no fetch time; a day of 2024 is derived from page_id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", day.alias("fetched"))
    out = judge(pages, spark.createDataFrame(ENTRIES, "key string, category string, day string, action string"))
    return out.withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


ORACLE = f"""
WITH e(key, category, since, action) AS (VALUES {", ".join(f"('{k}', '{c}', DATE '{d}', '{a}')" for k, c, d, a in ENTRIES)}),
v AS (SELECT key, category, since, action, coalesce(lead(since) OVER (PARTITION BY key, category ORDER BY since, action), DATE '{FOREVER}') AS until FROM e),
p AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS fetched,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\\.|\\.$', '') AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.page_id, v.key, v.category, row_number() OVER (PARTITION BY p.page_id ORDER BY length(v.key) DESC, v.key, v.category) AS nth,
  count(*) OVER (PARTITION BY p.page_id) AS n
  FROM p JOIN v ON v.action = 'add' AND p.fetched >= v.since AND p.fetched < v.until
  AND (p.host = split_part(v.key, '/', 1) OR ends_with(p.host, '.' || split_part(v.key, '/', 1)))
  AND (NOT contains(v.key, '/') OR starts_with(p.path || '/', '/' || split_part(v.key, '/', 2) || '/')))
SELECT p.page_id, strftime(p.fetched, '%Y-%m-%d') AS fetched, p.host, m.key IS NOT NULL AS blocked, m.key AS rule, m.category, coalesce(m.n, 0)::BIGINT AS n_rules
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.nth = 1
"""
