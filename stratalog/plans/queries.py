"""The queries: each applies operators to the tables in a folder. Keys start with the operators' short names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv1_64, seeded_position, varint_size
from ..operators import cache, codecs, compact, fingerprints, latest, limits, merkle, named, runs, sketches
from ..schema import Config
from ..sources import commands, oplog
from ..sources.scratch import materialize, scratch_path
from ..streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Operations in a batch, bytes in a log segment and page size of the queries.
CAPACITY, SEGMENT, DENSITY = 500, 16_384, 5
CONFIG = Config(tables_to_compress=4, max_lsm_levels=4, first_leveled_size=10_000, leveled_inc=10)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.from_events(table(spark, sf_dir, "events"))


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.col("value").cast("string"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return oplog.from_table(c, F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return oplog.from_table(p, F.col("p_name"), F.concat_ws("|", "p_brand", "p_type"), F.col("p_partkey"))


def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command line for each event."""
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    n = F.col("event_id").cast("string")
    kinds = [
        F.concat_ws(" ", F.lit("put"), key, F.col("event_type"), n), F.concat_ws(" ", F.lit("get"), key), F.concat_ws(" ", F.lit("delete"), key), F.concat(F.lit("prefixscan u 1 "), n),
        F.concat_ws(" ", F.lit("bf put"), key, n), F.concat_ws(" ", F.lit("rangescan a-u"), n, n), F.concat_ws(" ", F.lit("hll check"), key, n), F.lit("next"), F.concat(F.lit("fingerprint "), key, F.lit(" some text")),
        F.concat_ws(" ", F.lit("cms make"), key), F.concat_ws(" ", F.lit("hll check"), key), F.lit("exit"), F.concat_ws(" ", F.lit("simhash"), key, key), F.concat_ws(" ", F.lit("put"), key), F.concat(F.lit("rangeiterate a-"), key),
        F.concat_ws(" ", F.lit("prefixiterate"), key), F.concat_ws(" ", F.lit("cms destroy"), key),
    ]
    line = F.element_at(F.array(*kinds), (F.pmod("event_id", F.lit(len(kinds))) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), line.alias("line"))


# Sources, log and records


@query
def s2_classify(spark, d):
    return commands.parse(command_lines(spark, d)).select("seq", "option", "charged", "key", "argument")


@query
def s3_command_state(spark, d):
    """Commands to log to state."""
    return shown(latest.live(oplog.records(commands.operations(commands.parse(command_lines(spark, d)))))).select("key", "value", "seq")


@query
def s4_records(spark, d):
    return shown(events_log(spark, d)).select("seq", "ts", "key", "value", "tombstone", "key_size", "value_size")


@query
def s5_record_bytes(spark, d):
    log = events_log(spark, d)
    return log.groupBy("tombstone").agg(F.count("*").alias("records"), F.sum(oplog.record_size()).alias("bytes"))


@query
def s6_packed_bytes(spark, d):
    """Sizes in the compressed form; without the checksum's varint, which DuckDB can't compute."""
    log = events_log(spark, d)
    rows = runs.encode(log, runs.dictionary(log))
    size = runs.packed_size(F.col("id")) - varint_size(F.col("crc"))
    return rows.select("seq", "id", size.alias("packed_bytes"))


@query
def s7_wal_segments(spark, d):
    return oplog.segments(events_log(spark, d), SEGMENT).groupBy("segment").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.min("at").alias("first_at"))


@query
def s8_replay(spark, d):
    """The log written, read back with checksums verified, and replayed."""
    path = scratch_path(spark)
    oplog.append(events_log(spark, d), path)
    return shown(latest.live(oplog.read(spark, path))).select("key", "value", "ts", "seq")


@query
def s9_truncate(spark, d):
    """The state of what is left of the log after its first 4,000 operations go."""
    return shown(latest.latest(oplog.truncated(events_log(spark, d), 4000))).select("key", "value", "seq", "tombstone")


@query
def s10_watermarks(spark, d):
    return oplog.watermarks(events_log(spark, d), CAPACITY, SEGMENT)


@query
def s11_recovery(spark, d):
    """State from flushed runs and the log after their last operation."""
    log = events_log(spark, d)
    flushed = runs.flush(log.where(F.col("seq") < 5000), CAPACITY)
    both = flushed.select("seq", "ts", "key", "value", "tombstone", "crc", "key_size", "value_size").unionByName(oplog.truncated(log, 5000))
    return shown(latest.live(both)).select("key", "value", "seq")


@query
def s12_memtable_batches(spark, d):
    b = oplog.batches(events_log(spark, d), CAPACITY)
    return b.groupBy("batch").agg(F.count("*").alias("operations"), F.countDistinct("key").alias("keys"), F.min("seq").alias("first_seq"))


@query
def s13_sorted_memtable(spark, d):
    """Every batch's content, whatever structure holds it."""
    return shown(runs.flush(events_log(spark, d), CAPACITY)).select("run_id", "key", "value", "seq", "tombstone")


@query
def s16_flush(spark, d):
    return shown(runs.flush(events_log(spark, d), CAPACITY)).select("run_id", "level", "key", "value", "seq", "tombstone")


@query
def s18_dense_index(spark, d):
    return runs.dense_index(runs.flush(events_log(spark, d), CAPACITY)).select("run_id", "key", "nth", "at")


@query
def s19_sparse_index(spark, d):
    return runs.index_offsets(runs.flush(events_log(spark, d), CAPACITY), DENSITY)


@query
def s20_run_bloom(spark, d):
    """Set bits of every run's filter."""
    return runs.blooms(runs.flush(events_log(spark, d), CAPACITY), CAPACITY, 0.1)


@query
def s22_read_runs(spark, d):
    """Runs written as files and read back with pruning to two of them."""
    path = scratch_path(spark)
    runs.write(runs.flush(events_log(spark, d), CAPACITY), path)
    return shown(runs.read(spark, path, [1, 2], verify=True)).select(F.col("run_id").cast("long").alias("run_id"), "key", "value", "seq")


@query
def s23_catalog(spark, d):
    path = scratch_path(spark)
    runs.write(runs.flush(events_log(spark, d), CAPACITY), path)
    return runs.catalog(spark.read.parquet(path)).groupBy("level").agg(F.count("*").alias("runs"), (F.min("file_bytes") > 0).alias("sized"))


@query
def s25_populate(spark, d):
    return shown(latest.live(oplog.populate(spark, 1000, 100))).select("key", "value", "seq")


# Lookups, filters, scans


@query
def m1_latest(spark, d):
    return shown(latest.latest(events_log(spark, d))).select("key", "value", "ts", "seq", "tombstone")


@query
def m1_latest_part(spark, d):
    """Many versions for each key."""
    return shown(latest.latest(parts(spark, d))).select("key", "value", "seq")


@query
def f1_get(spark, d):
    return shown(latest.get(events_log(spark, d), "u0001", "u0007", "u0042", "u0099", "nobody"))


@query
def f2_get_memtable(spark, d):
    """Lookup in the batches that are not flushed."""
    b = oplog.batches(events_log(spark, d), CAPACITY).where("batch >= 17").drop("batch")
    return shown(latest.get(b, "u0001", "u0007", "u0042", "u0099"))


@query
def f3_get_runs(spark, d):
    """Lookup in runs alone."""
    return shown(latest.get(runs.flush(events_log(spark, d), CAPACITY), "u0001", "u0007", "u0042"))


@query
def f4_candidate_runs(spark, d):
    """Runs that may hold a key, by key range."""
    return runs.may_contain(runs.manifest(runs.flush(customers(spark, d), 200)), "Customer#000000777").select("run_id", "min_key", "max_key")


@query
def f4_lookup(spark, d):
    """Runs that all keys, and as many that no run holds, need after key ranges and filters."""
    rows = runs.flush(events_log(spark, d), CAPACITY)
    keys = rows.select("key").distinct()
    asked = keys.unionByName(keys.select(F.concat("key", F.lit("x")).alias("key")))
    return runs.lookup_runs(asked, runs.manifest(rows), runs.blooms(rows, CAPACITY, 0.1), CAPACITY, 0.1)


@query
def f5_hide_system_keys(spark, d):
    log = events_log(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ["", "bf ", "cms ", "hll ", "fingerprint ", "tokenLog "])), (F.pmod("seq", F.lit(6)) + 1).cast("int"))
    mixed = latest.live(log.withColumn("key", F.concat(kind, "key")))
    return latest.user_rows(mixed).select("key", latest.namespace(F.col("key")).alias("namespace"), "seq")


@query
def f5_namespaces(spark, d):
    log = events_log(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ["", "bf ", "cms ", "hll ", "fingerprint ", "tokenLog "])), (F.pmod("seq", F.lit(6)) + 1).cast("int"))
    return log.select(latest.namespace(F.concat(kind, "key")).alias("namespace")).groupBy("namespace").agg(F.count("*").alias("records"))


@query
def f6_prefix(spark, d):
    return shown(latest.prefix(events_log(spark, d), "u00")).select("key", "value")


@query
def f7_range(spark, d):
    return shown(latest.key_range(events_log(spark, d), "u0010", "u0050")).select("key", "value")


@query
def f8_range_runs(spark, d):
    return runs.may_contain(runs.manifest(runs.flush(customers(spark, d), 200)), "Customer#000000300", "Customer#000000500").select("run_id", "rows")


@query
def f9_tombstones(spark, d):
    return latest.latest(events_log(spark, d)).groupBy("tombstone").agg(F.count("*").alias("keys"))


@query
def f10_checksums(spark, d):
    """Records with a damaged value are found by their checksum."""
    log = events_log(spark, d)
    hurt = log.withColumn("value", F.when(F.pmod("seq", F.lit(100)) == 7, F.concat("value", F.lit(b"!"))).otherwise(F.col("value")))
    return oplog.damaged(hurt).select("seq", "key")


@query
def f11_merkle_contained(spark, d):
    """All documents against a tree of those in one language."""
    docs = table(spark, d, "documents")
    tree = materialize(merkle.leaves(docs.where("lang = 'en'"), F.col("text"), "doc_id"))
    return merkle.contained(docs, F.col("text"), tree).select("doc_id")


@query
def f11_proof_path(spark, d):
    """Every document's way through the tree of all; only proofs that lead to the root are returned."""
    leaves = materialize(merkle.leaves(table(spark, d, "documents"), F.col("text"), "doc_id"))
    paths = materialize(merkle.proofs(leaves, merkle.build(leaves)))
    return paths.join(merkle.proven(leaves, paths).select("pos"), "pos").select("pos", "nth", "level", F.lower(F.hex("hash")).alias("hash"))


@query
def l1_sorted(spark, d):
    return shown(latest.live(events_log(spark, d))).select("key", "value").orderBy("key")


@query
def l2_prefix_scan(spark, d):
    return shown(latest.prefix_scan(events_log(spark, d), "u00", 2, 10))


@query
def l2_prefix_scan_past_end(spark, d):
    return shown(latest.prefix_scan(events_log(spark, d), "u00", 99, 10))


@query
def l3_range_scan(spark, d):
    return shown(latest.range_scan(events_log(spark, d), "u0020", "u0090", 3, 15))


@query
def l3_customer_scan(spark, d):
    return shown(latest.range_scan(customers(spark, d), "Customer#000000100", "Customer#000000900", 5, 20))


@query
def l4_pages(spark, d):
    """Every page of a prefix scan at once, with places."""
    return shown(latest.pages(latest.prefix(events_log(spark, d), "u"), 10))


@query
def l4_iterate(spark, d):
    """What a cursor over a prefix gives, call by call, until it ends."""
    rows = latest.prefix(events_log(spark, d), "u00")
    return latest.pages(rows, 1).select(F.col("page").alias("call"), "key", F.col("value").cast("string").alias("value"))


@query
def l5_iterate(spark, d):
    """What a cursor over a range gives, call by call."""
    rows = latest.key_range(events_log(spark, d), "u0010", "u0050")
    return latest.pages(rows, 1).select(F.col("page").alias("call"), "key", F.col("value").cast("string").alias("value"))


@query
def s26_scan_lines(spark, d):
    """A prefix scan's pages of ten as numbered lines."""
    rows = latest.pages(latest.prefix(events_log(spark, d), "u"), 10)
    return commands.text_lines(rows.withColumn("nth", (F.col("page") - 1) * 10 + F.col("place")), "nth")


@query
def x13_scan_arguments(spark, d):
    return commands.scans(commands.parse(command_lines(spark, d)))


@query
def l7_cache(spark, d):
    return shown(cache.cached(events_log(spark, d), 5))


@query
def w5_recent_puts(spark, d):
    return shown(cache.recent_puts(parts(spark, d), 5))


# Joins and set operations


@query
def j1_merge_sources(spark, d):
    """Runs and log together, newest version of each key; both hold the same operations."""
    log = events_log(spark, d)
    both = runs.flush(log, CAPACITY).select(*log.columns).unionByName(log)
    return shown(latest.live(both)).select("key", "value", "seq")


@query
def j3_overlapping_runs(spark, d):
    """Runs over the same keys, at two levels."""
    m = runs.manifest(runs.flush(events_log(spark, d), CAPACITY))
    return runs.overlaps(m.withColumn("level", F.when(F.pmod("run_id", F.lit(2)) == 0, F.lit(2)).otherwise(F.col("level"))))


@query
def j4_incorrect_elements(spark, d):
    """Documents that a tree of those in one language doesn't hold."""
    docs = table(spark, d, "documents")
    tree = materialize(merkle.leaves(docs.where("lang = 'en'"), F.col("text"), "doc_id"))
    return merkle.incorrect(docs, F.col("text"), tree).select("doc_id")


@query
def j5_bloom_join(spark, d):
    """Line items kept by a filter over the parts of one brand, then joined with them."""
    p = table(spark, d, "part").where("p_brand = 'Brand#13'").select("p_partkey", "p_brand")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    bloom = sketches.bloom_build(p, "p_partkey", 200, 0.05)
    kept = sketches.bloom_semi_join(lines, "l_partkey", bloom, 200, 0.05)
    return kept.join(p, kept.l_partkey == p.p_partkey).groupBy("l_partkey").agg(F.count("*").alias("line_items"))


@query
def j6_fingerprint_pairs(spark, d):
    """Every document's distance to the last one of its source."""
    docs = table(spark, d, "documents")
    last = docs.groupBy("source").agg(F.max("doc_id").alias("b"))
    pairs = docs.join(last, "source").select(F.col("doc_id").alias("a"), "b")
    return fingerprints.distances(pairs, fingerprints.fingerprint(docs, "doc_id", "text"))


@query
def j7_dictionary(spark, d):
    """Keys to ids and back."""
    log = events_log(spark, d).select("seq", "key")
    ids = materialize(runs.dictionary(log))
    return runs.decode(runs.encode(log, ids), ids).join(ids, "key").groupBy("key", "id").agg(F.count("*").alias("records"))


@query
def u1_union(spark, d):
    log = events_log(spark, d)
    flushed = runs.flush(log, CAPACITY).select(*log.columns)
    return flushed.unionByName(log).groupBy("key").agg(F.count("*").alias("versions"), F.max("seq").alias("seq"))


@query
def u3_set_difference(spark, d):
    """Orders with returned lines but no accepted ones."""
    lines = table(spark, d, "lineitem")
    key = lambda flag: lines.where(F.col("l_returnflag") == flag).select("l_orderkey")
    return key("R").distinct().join(key("A"), "l_orderkey", "left_anti")


# Sketches


@query
def a4_bloom_build(spark, d):
    return sketches.bloom_build(table(spark, d, "lineitem"), "l_suppkey", 100, 0.01)


@query
def a5_bloom_check(spark, d):
    """All parts against a filter of those with a line item of the largest quantity, made for as many as there are."""
    largest = table(spark, d, "lineitem").where("l_quantity = 50")
    n = largest.agg(F.countDistinct("l_partkey")).first()[0]
    bloom = sketches.bloom_build(largest, "l_partkey", max(n, 1), 0.1)
    return sketches.bloom_check(table(spark, d, "part"), "p_partkey", bloom, max(n, 1), 0.1)


@query
def a6_cms_build(spark, d):
    return sketches.cms_build(table(spark, d, "lineitem"), "l_partkey", 0.01, 0.01)


@query
def a7_cms_estimate(spark, d):
    cms = sketches.cms_build(table(spark, d, "lineitem"), "l_partkey", 0.01, 0.01)
    return sketches.cms_estimate(table(spark, d, "part"), "p_partkey", cms, 0.01, 0.01)


@query
def a1_hll_registers(spark, d):
    return sketches.hll_registers(table(spark, d, "lineitem"), "l_partkey", 10)


@query
def a2_hll_estimate(spark, d):
    registers = sketches.hll_registers(table(spark, d, "lineitem"), "l_partkey", 10)
    return sketches.hll_estimate(registers, 10).select(F.round("estimate", 4).alias("estimate"))


@query
def a3_hll_merge(spark, d):
    lines = table(spark, d, "lineitem")
    halves = [sketches.hll_registers(lines.where(F.pmod("l_orderkey", F.lit(2)) == i), "l_partkey", 8) for i in (0, 1)]
    return sketches.hll_merge(*halves)


@query
def a2_distinct_count(spark, d):
    """The accurate count: within 5 % of the exact one."""
    lines = table(spark, d, "lineitem")
    exact = lines.agg(F.countDistinct("l_partkey").alias("exact"))
    return sketches.distinct_count(lines, "l_partkey").crossJoin(exact).select((F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"), "exact")


@query
def a11_word_counts(spark, d):
    return fingerprints.word_counts(table(spark, d, "documents"), "doc_id", "text").groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query
def a13_fingerprints(spark, d):
    return fingerprints.fingerprint(table(spark, d, "documents"), "doc_id", "text")


@query
def a9_merkle_levels(spark, d):
    tree = merkle.build(merkle.leaves(table(spark, d, "documents"), F.col("text"), "doc_id"))
    return tree.groupBy("level").agg(F.count("*").alias("nodes"), F.min(F.when(F.col("pos") == 0, F.lower(F.hex("hash")))).alias("first_hash"))


@query
def a9_merkle_root(spark, d):
    tree = merkle.build(merkle.leaves(table(spark, d, "documents"), F.col("text"), "doc_id"))
    return merkle.root(tree).select("level", F.lower(F.hex("hash")).alias("root"))


@query
def a14_manifest(spark, d):
    return runs.manifest(runs.flush(events_log(spark, d), CAPACITY))


@query
def a15_levels(spark, d):
    return runs.levels(runs.manifest(compact.compact(runs.flush(events_log(spark, d), CAPACITY), CONFIG)))


# Functions


@query
def x2_positions(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.posexplode(seeded_position(F.col("s_name"), 3, 100_003)).alias("seed", "pos"))


@query
def x5_fnv(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", fnv1_64("s_name").alias("h"))


@query
def x6_hamming(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.bit_count(F.col("event_id").bitwiseXOR(F.col("user_id"))).cast("long").alias("distance"))


# Changes and structures


@query
def d_put_overwrite(spark, d):
    """Every delete is followed by a put of the same key, later than the whole log."""
    log = events_log(spark, d)
    again = log.where("tombstone").select((F.col("seq") + 1_000_000_000).alias("seq"), F.lit(4_000_000_000).alias("ts"), "key", F.lit("new").alias("value"), F.lit(False).alias("tombstone"))
    return shown(latest.live(log.unionByName(oplog.records(again)))).select("key", "value", "seq")


@query
def d_delete(spark, d):
    """Deletes write tombstones for live keys alone, and keep their values."""
    log = events_log(spark, d)
    keys = spark.createDataFrame([("u0001", 1), ("u0002", 2), ("u0003", 3), ("zzz", 4)], "key string, n long")
    dead = oplog.deletions(latest.live(log), keys, 1_000_000, 4_000_000_000)
    return shown(dead).select("key", "value", "tombstone", "seq")  # never looked up by seq or ts: those of the log may be as large


def structure_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.element_at(F.array(F.lit("bf"), F.lit("cms"), F.lit("hll")), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    action = F.when(F.pmod("event_id", F.lit(50)) == 0, "make").when(F.pmod("event_id", F.lit(333)) == 5, "destroy").otherwise("put")
    return e.select(F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("n"), F.pmod("user_id", F.lit(20)).cast("string")).alias("name"), action.alias("action"), F.col("event_type").alias("argument"))


@query
def d_make_destroy(spark, d):
    return sketches.structures(structure_log(spark, d)).select("kind", "name", "parameters", "made")


@query
def d_add_elements(spark, d):
    return sketches.elements(structure_log(spark, d)).groupBy("kind", "name").agg(F.count("*").alias("elements"), F.countDistinct("element").alias("kinds"))


def named_log(spark: SparkSession, d: str) -> DataFrame:
    """Makes (some with parameters that are not valid), destroys, puts and checks of named structures."""
    e = table(spark, d, "events")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    i = F.col("event_id")
    kind = pick(["bf", "cms", "hll"], F.pmod(i, F.lit(3)))
    action = F.when(F.pmod(i, F.lit(500)) < 3, "make").when(F.pmod(i, F.lit(3331)) == 7, "destroy").when(F.pmod(i, F.lit(7)) == 0, "check").otherwise("put")
    good, bad = pick(["60 0.05", "0.05 0.1", "10"], F.pmod(i, F.lit(3))), pick(["0 0.1", "0.1 0.0", "260"], F.pmod(i, F.lit(3)))
    value = F.concat_ws(":", "event_type", F.pmod("user_id", F.lit(40)).cast("string"))
    argument = F.when(action == "make", F.when(F.pmod(i, F.lit(1500)) < 3, bad).otherwise(good)).otherwise(value)
    return e.select(i.alias("seq"), kind.alias("kind"), F.concat(F.lit("n"), F.pmod("user_id", F.lit(4)).cast("string")).alias("name"), action.alias("action"), argument.alias("argument"))


@query
def d_check_bf(spark, d):
    return named.check_blooms(named_log(spark, d))


@query
def d_check_cms(spark, d):
    return named.check_cms(named_log(spark, d))


@query
def d_check_hll(spark, d):
    out = named.check_hlls(named_log(spark, d))
    return out.select("name", F.round("estimate", 6).alias("estimate"))


def texts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("name"), "text")


@query
def d_fingerprint(spark, d):
    """The fingerprint of each name's last text."""
    return named.fingerprints_by_name(texts_by_source(spark, d)).select(F.col("id").alias("name"), "fp")


@query
def d_simhash(spark, d):
    """Distances of all names' fingerprints to that of one."""
    names = texts_by_source(spark, d).select(F.col("name").alias("a"), F.lit("src0").alias("b"))
    return named.simhash_answers(texts_by_source(spark, d), names)


@query
def s5_record_layout(spark, d):
    """Records as bytes, without the checksum, which DuckDB can't compute."""
    data = F.hex(codecs.record_to_bytes())
    return events_log(spark, d).select("seq", F.lower(F.substring(data, 9, 1_000_000)).alias("layout"))


@query
def a8_bloom_bytes(spark, d):
    bloom = sketches.bloom_build(table(spark, d, "part"), "p_brand", 100, 0.1)
    return codecs.bloom_to_bytes(bloom, 100, 0.1).select(F.md5("data").alias("md5"), F.octet_length("data").cast("long").alias("bytes"))


@query
def a8_cms_bytes(spark, d):
    cms = sketches.cms_build(table(spark, d, "lineitem"), "l_partkey", 0.05, 0.05)
    return codecs.cms_to_bytes(cms, 0.05, 0.05).select(F.md5("data").alias("md5"), F.octet_length("data").cast("long").alias("bytes"))


# Compaction


@query
def c2_size_tiered(spark, d):
    return runs.levels(runs.manifest(compact.compact(runs.flush(events_log(spark, d), CAPACITY), CONFIG))).select("level", "runs")


@query
def c3_leveled_state(spark, d):
    """Leveled compaction leaves the state as it was."""
    leveled = Config(compression_type="leveled", first_leveled_size=20_000, leveled_inc=4, max_lsm_levels=3)
    done = compact.compact(materialize(runs.flush(events_log(spark, d), 2000)), leveled)
    return shown(latest.live(done)).select("key", "value", "seq")


@query
def c3_levels(spark, d):
    """What leveled compaction leaves on each level."""
    leveled = Config(compression_type="leveled", first_leveled_size=20_000, leveled_inc=4, max_lsm_levels=3)
    return runs.levels(runs.manifest(compact.compact(materialize(runs.flush(events_log(spark, d), CAPACITY)), leveled)))


@query
def c4_compacted_state(spark, d):
    """Size-tiered compaction leaves the state as it was, tombstones included."""
    done = compact.compact(runs.flush(events_log(spark, d), CAPACITY), CONFIG)
    return shown(latest.latest(done)).select("key", "value", "seq", "tombstone")


# State over time


def requests(spark: SparkSession, d: str) -> DataFrame:
    return events_log(spark, d).select(F.col("key").alias("group_key"), "ts", "seq")


@query
def t1_rate_limit(spark, d):
    """A bucket of 2 for each user, filled again after six hours."""
    return limits.rate_limit(requests(spark, d), 2, 21_600)


@query
def t2_charged(spark, d):
    """Only valid commands take tokens; one bucket for all."""
    rows = commands.parse(command_lines(spark, d)).where("charged").select(F.lit("all").alias("group_key"), "ts", "seq")
    return limits.rate_limit(rows, 5, 21_600).groupBy("allowed").agg(F.count("*").alias("requests"))


@query
def t3_request_log(spark, d):
    return limits.request_log(limits.rate_limit(requests(spark, d), 2, 21_600))


@query
def t4_ring(spark, d):
    """Which of three batches in memory each batch replaces."""
    b = oplog.batches(events_log(spark, d), CAPACITY).groupBy("batch").agg(F.max("seq").alias("last_seq"))
    return b.select("batch", F.pmod("batch", F.lit(3)).alias("slot"), F.when(F.col("batch") >= 3, F.col("batch") - 3).alias("flushed"), "last_seq")


@query
def t6_stream_latest(spark, d):
    """The log as a stream, in micro-batches."""
    path = scratch_path(spark)
    oplog.append(events_log(spark, d), path)
    return shown(live.stream_latest(spark, path, 1)).select("key", "value", "seq", "tombstone")
