"""Hand-made logs: versions, deletes, pages, batches, runs, compaction, limits, caches."""

import random
import zlib

import pytest

from stratalog.operators import cache, compact, latest, limits, runs, sketches
from stratalog.schema import Config
from stratalog.sources import commands, oplog


def log_of(spark, *ops):
    """Operations (seq, key, value or None for a delete[, ts])."""
    rows = [(o[0], o[3] if len(o) > 3 else o[0], o[1], (o[2] or "old").encode(), o[2] is None) for o in ops]
    return oplog.records(spark.createDataFrame(rows, "seq long, ts long, key string, value binary, tombstone boolean"))


def shown(df):
    return sorted((r.key, bytes(r.value).decode()) for r in df.collect())


def random_ops(n, keys, seed, deletes=0.2):
    rng = random.Random(seed)
    return [(i, f"k{rng.randrange(keys):03d}", None if rng.random() < deletes else f"v{i}") for i in range(n)]


def state(ops):
    out = {}
    for _, k, v, *_ in ops:
        out.pop(k, None)
        if v is not None:
            out[k] = v
    return out


def test_ties_and_deletes(spark):
    log = log_of(spark, (1, "a", "1", 5), (2, "a", "2", 5), (3, "b", "1"), (4, "b", None), (5, "c", "1"), (6, "c", None), (7, "c", "2"))
    assert shown(latest.live(log)) == [("a", "2"), ("c", "2")]
    assert shown(latest.get(log, "b", "c")) == [("c", "2")]


def test_late_version_loses(spark):
    assert shown(latest.live(log_of(spark, (1, "a", "new", 9), (2, "a", "late", 3)))) == [("a", "new")]


def test_ranges_and_pages(spark):
    log = log_of(spark, *[(i, k, k) for i, k in enumerate(["a", "b", "c", "x1", "x2", "bf n", "tokenLog 17"])])
    assert [k for k, _ in shown(latest.key_range(log, "a", "c"))] == ["a", "b", "c"]
    assert shown(latest.key_range(log, "c", "a")) == []
    assert [k for k, _ in shown(latest.prefix(log, "x"))] == ["x1", "x2"]
    assert [k for k, _ in shown(latest.user_rows(latest.live(log)))] == ["a", "b", "c", "x1", "x2"]
    scan = latest.prefix(log, "")
    assert [r.key for r in latest.page(scan, 2, 3).collect()] == ["x1", "x2"]
    assert latest.page(scan, 0, 3).count() == latest.page(scan, 1, 0).count() == latest.page(scan, 99, 3).count() == 0
    placed = sorted((r.page, r.place, r.key) for r in latest.pages(scan, 2).collect())
    assert placed == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "x1"), (3, 1, "x2")]


def test_byte_order_and_cursor(spark):
    cursor = latest.prefix_iterate(log_of(spark, *[(i, k, k) for i, k in enumerate(["A", "Z", "_", "a", "0"])]), "")
    assert [cursor.next().key for _ in range(5)] == ["0", "A", "Z", "_", "a"] and cursor.next() is None
    cursor = latest.range_iterate(log_of(spark, (1, "a", "1"), (2, "b", "1")), "a", "b")
    assert cursor.next().key == "a"
    cursor.stop()
    assert cursor.next() is None


def test_get_is_a_range_of_one(spark):
    ops = random_ops(300, 20, 1)
    log = log_of(spark, *ops)
    for key in ("k001", "k007", "nobody"):
        assert shown(latest.get(log, key)) == shown(latest.key_range(log, key, key))


def test_checksums(spark):
    log = log_of(spark, (1, "a", "1"), (2, "b", "2"))
    assert {r.key: r.crc for r in log.collect()} == {"a": zlib.crc32(b"1"), "b": zlib.crc32(b"2")}
    from pyspark.sql import functions as F

    hurt = log.withColumn("value", F.when(F.col("key") == "a", F.lit(b"x")).otherwise(F.col("value")))
    assert [r.key for r in oplog.damaged(hurt).collect()] == ["a"]


def test_batches_count_puts(spark):
    log = log_of(spark, *[(i, "k", str(i)) for i in range(7)])
    assert sorted(r["count"] for r in oplog.batches(log, 5).groupBy("batch").count().collect()) == [2, 5]


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    ops = [(i * 9000, "k", str(i)) for i in range(50)]
    got = {r.seq: r.before for r in oplog.running(log_of(spark, *ops), F.lit(2), "before").collect()}
    assert got == {s: 2 * i for i, (s, *_) in enumerate(ops)}


def test_deletions_only_of_live_keys(spark):
    log = log_of(spark, (1, "a", "1"), (2, "b", None))
    keys = spark.createDataFrame([("a", 0), ("b", 1), ("z", 2)], "key string, n long")
    dead = oplog.deletions(latest.live(log), keys, 100, 100)
    assert [(r.key, bytes(r.value), r.tombstone) for r in dead.collect()] == [("a", b"1", True)]
    assert shown(latest.live(log.unionByName(dead))) == []


@pytest.mark.parametrize("kind", ["size-tiered", "leveled"])
def test_compaction_keeps_the_state(spark, kind):
    ops = random_ops(600, 60, 2)
    log = log_of(spark, *ops)
    config = Config(compression_type=kind, tables_to_compress=3, max_lsm_levels=3, first_leveled_size=3000, leveled_inc=2)
    flushed = runs.flush(log, 50)
    done = compact.compact(flushed, config)
    before = sorted((r.key, r.seq, r.tombstone) for r in latest.latest(log).collect())
    assert sorted((r.key, r.seq, r.tombstone) for r in latest.latest(done).collect()) == before
    left = compact.listed(runs.manifest(done))
    assert compact.step(left, config) is None and len(left) < 12
    assert dict(shown(latest.live(done))) == state(ops)


def plain_leveled(ops, capacity, config):
    """Levels of runs after leveled compaction, a run at a time: {level: [(rows, bytes), ...]}."""
    now = []
    for a in range(0, len(ops), capacity):
        now.append((1, a // capacity, {k: (ts, seq, v) for seq, k, v, ts in ops[a : a + capacity]}))
    size = lambda run: sum(29 + len(k) + len(v[2] or "old") for k, v in run.items())
    new = len(now)
    while True:
        for level in range(1, config.max_lsm_levels):
            own = sorted((r for r in now if r[0] == level), key=lambda r: r[1])
            if sum(size(r[2]) for r in own) > config.first_leveled_size * config.leveled_inc ** (level - 1):
                break
        else:
            return {x: sorted((len(r[2]), size(r[2])) for r in now if r[0] == x) for x in {r[0] for r in now}}
        low, high = min(own[0][2]), max(own[0][2])
        group = [own[0], *(r for r in now if r[0] == level + 1 and min(r[2]) <= high and max(r[2]) >= low)]
        one = {}
        for r in group:
            for k, v in r[2].items():
                one[k] = max(one.get(k, v), v, key=lambda x: x[:2])
        now = [r for r in now if r not in group] + [(level + 1, new, one)]
        new += 1


def test_leveled_compaction_against_a_loop(spark):
    rng = random.Random(4)
    ops = [(i, f"{'abcd'[i // 150]}{rng.randrange(40):02}", rng.choice([None, "x" * rng.randrange(1, 30)]), i // 3) for i in range(600)]
    config = Config(compression_type="leveled", tables_to_compress=3, max_lsm_levels=3, first_leveled_size=3000, leveled_inc=1)
    done = compact.compact(runs.flush(log_of(spark, *ops), 50), config)
    got = {}
    for r in compact.listed(runs.manifest(done)):
        got.setdefault(r.level, []).append((r.rows, r.bytes))
    want = plain_leveled(ops, 50, config)
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 1 and len(want.get(3, [])) > 1


def test_runs_on_disk(spark, tmp_path):
    log = log_of(spark, *random_ops(200, 30, 3))
    flushed = runs.flush(log, 50)
    runs.write(flushed, f"{tmp_path}/runs")
    back = runs.read(spark, f"{tmp_path}/runs", verify=True)
    key = lambda r: (r.run_id, r.key, r.seq)
    assert sorted(map(key, back.collect())) == sorted(map(key, flushed.collect()))
    assert {r.run_id for r in runs.read(spark, f"{tmp_path}/runs", [1]).collect()} == {1}
    assert runs.catalog(spark.read.parquet(f"{tmp_path}/runs")).count() == 4


def test_log_on_disk_and_stream(spark, tmp_path):
    from stratalog.streaming import live

    ops = random_ops(300, 25, 4)
    for part in (ops[:100], ops[100:200], ops[200:]):
        oplog.append(log_of(spark, *part), f"{tmp_path}/log")
    assert dict(shown(latest.live(oplog.read(spark, f"{tmp_path}/log")))) == state(ops)
    assert dict(shown(live.stream_latest(spark, f"{tmp_path}/log", 1).where("not tombstone"))) == state(ops)


def test_rate_limit(spark):
    def passed(times, capacity=2, cooldown=60):
        rows = spark.createDataFrame([("g", t, i) for i, t in enumerate(times)], "group_key string, ts long, seq long")
        return [r.allowed for r in sorted(limits.rate_limit(rows, capacity, cooldown).collect(), key=lambda r: r.seq)]

    assert passed([0, 1, 2, 61, 62, 200]) == [True, True, False, True, True, True]
    assert passed([0, 1, 60, 61]) == [True, True, False, True]  # a refill comes after the cooldown, not at its end


def test_rate_limit_against_a_loop(spark):
    rng = random.Random(5)
    rows = sorted((rng.choice("ab"), rng.randrange(2000)) for _ in range(400))
    rows = [(g, t, i) for i, (g, t) in enumerate(rows)]
    want, buckets = [], {}
    for g, t, _ in rows:
        b = buckets.setdefault(g, [0, 3])
        if t > b[0] + 50:
            b[:] = [t, 3]
        want.append(b[1] > 0)
        b[1] = max(b[1] - 1, 0)
    got = limits.rate_limit(spark.createDataFrame(rows, "group_key string, ts long, seq long"), 3, 50).collect()
    assert [r.allowed for r in sorted(got, key=lambda r: r.seq)] == want


def test_rate_limit_stream(spark, tmp_path):
    from stratalog.sources.scratch import scratch_path
    from stratalog.streaming import live

    schema = "group_key string, ts long, seq long"
    for i, times in enumerate([(0, 1), (2, 61), (62, 200)]):
        spark.createDataFrame([("g", t, 10 * i + k) for k, t in enumerate(times)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.rate_limit_stream(source, 2, 60).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [r.allowed for r in sorted(got, key=lambda r: r.seq)] == [True, True, False, True, True, True]


@pytest.mark.parametrize("deletes,seed", [(0.0, 6), (0.3, 7), (0.6, 8)])
def test_cache_against_a_loop(spark, deletes, seed):
    ops = random_ops(200, 12, seed, deletes)
    held = []
    for _, k, v in ops:
        here = k in held
        if here:
            held.remove(k)
        if v is not None:
            held.append(k)
            held = held[-5:]
    assert {r.key for r in cache.cached(log_of(spark, *ops), 5).collect()} == set(held)


def test_commands(spark):
    lines = ["put a 1 2", "put a", "get a", "get a b", "delete a\r\n", "exit", "bf make n", "hll destroy n", "cms put n x y", "hll check n", "hll check n x", "bf check n x", "fingerprint n some text", "simhash a b", "prefixscan a 1 2", "rangescan a-b 1 2", "prefixiterate a", "rangeiterate a-b", "next", "", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    got = [(r.option, r.argument) for r in sorted(commands.parse(rows).collect(), key=lambda r: r.seq)]
    assert [o for o, _ in got] == [1, 0, 2, 0, 3, -1, 4, 5, 6, 7, 0, 7, 8, 9, 10, 11, 12, 13, 0, 0, 0]
    assert got[0][1] == "1 2" and got[8][1] == "x y" and got[12][1] == "some text"


def test_config(tmp_path):
    assert Config(memtable_size=2, refill_cooldown=601, compression_type="x").validated() == Config()
    (tmp_path / "c.json").write_text('{"cahce_size": 9, "filter_precsion": 0.2, "tables_to_compress": 99, "unknown": 1}')
    c = Config.load(str(tmp_path / "c.json"))
    assert (c.cache_size, c.filter_precision, c.tables_to_compress) == (9, 0.2, 8)
    c.save(str(tmp_path / "d.json"))
    assert Config.load(str(tmp_path / "d.json")) == c and Config.load(str(tmp_path / "none.json")) == Config()


def test_populate(spark):
    assert shown(latest.live(oplog.populate(spark, 10, 3))) == [("0", "0000"), ("1", "1111"), ("2", "2222")]


def test_structures(spark):
    rows = [(1, "bf", "a", "make", "10"), (2, "bf", "a", "put", "x"), (3, "bf", "a", "destroy", ""), (4, "bf", "a", "put", "lost"), (5, "bf", "a", "make", "20"), (6, "bf", "a", "put", "y"), (7, "cms", "b", "put", "nothing")]
    log = spark.createDataFrame(rows, "seq long, kind string, name string, action string, argument string")
    assert [tuple(r) for r in sketches.structures(log).collect()] == [("bf", "a", "20", 5)]
    assert [r.element for r in sketches.elements(log).collect()] == ["y"]
