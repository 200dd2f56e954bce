"""Byte forms: round trips, damaged bytes, and which make commands count."""

from pyspark.sql import functions as F

from stratalog.operators import codecs, named, sketches


def test_records_round_trip(spark):
    rows = [(1, 0, False, "k", b"v"), (2**32 - 1, 1_700_000_000, True, "longer key", b""), (0, 2**62, False, "", bytes(range(256)))]
    df = spark.createDataFrame(rows, "crc long, ts long, tombstone boolean, key string, value binary")
    data = df.select(codecs.record_to_bytes().alias("data"))
    back = codecs.records_from_bytes(data, "data").select("crc", "ts", "tombstone", "key", "value").collect()
    assert sorted((r.crc, r.ts, r.tombstone, r.key, bytes(r.value)) for r in back) == sorted(rows)
    first = data.first().data
    assert bytes(first) == (1).to_bytes(4, "little") + bytes(8) + b"\0" + (1).to_bytes(8, "little") * 2 + b"kv"
    cut = spark.createDataFrame([(bytes(first[:-1]),), (bytes(first) + b"x",), (b"",), (None,)], "data binary")
    assert all(r.crc is None and r.key is None for r in codecs.records_from_bytes(cut, "data").collect())


def test_filters_round_trip(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(30)], "v string")
    bloom = sketches.bloom_build(df, "v", 30, 0.05)
    data = codecs.bloom_to_bytes(bloom, 30, 0.05)
    assert sorted(codecs.bloom_from_bytes(data).collect()) == sorted(bloom.collect())
    none = codecs.bloom_to_bytes(bloom.limit(0), 30, 0.05).first().data
    assert len(none) == len(data.first().data) and set(none[-sketches.bloom_params(30, 0.05)[0] :]) == {0}


def test_parameters_of_makes(spark):
    rows = [("bf", "10 0.1", True), ("bf", "0 0.1", False), ("bf", "10 1.1", False), ("bf", "10", False), ("cms", "0.1 0.2", True), ("cms", "0.0 0.2", False), ("cms", "1 0.2", False), ("hll", "4", True), ("hll", "16", True), ("hll", "17", False), ("hll", "260", False), ("hll", "x", False), ("hll", None, False), ("other", "4", False)]
    df = spark.createDataFrame(rows, "kind string, argument string, want boolean")
    assert [r.got == r.want for r in df.select("want", named.valid(F.col("kind"), F.col("argument")).alias("got")).collect()] == [True] * len(rows)


def test_checks_of_missing_structures(spark):
    rows = [(1, "bf", "a", "make", "10 0.1"), (2, "bf", "a", "put", "x"), (3, "bf", "a", "check", "x"), (4, "bf", "b", "check", "x"), (5, "cms", "c", "make", "0.1 0.1"), (6, "cms", "c", "put", "x"), (7, "cms", "c", "put", "x"), (8, "cms", "c", "check", "x"), (9, "cms", "c", "check", "y"), (10, "bf", "d", "make", "10 0.1"), (11, "bf", "d", "destroy", None), (12, "bf", "d", "check", "x"), (13, "hll", "h", "make", "10"), (14, "hll", "h", "check", None)]
    log = spark.createDataFrame(rows, "seq long, kind string, name string, action string, argument string")
    assert [tuple(r) for r in named.check_blooms(log).collect()] == [("a", "x", True)]
    got = {(r.name, r.value): r.estimate for r in named.check_cms(log).collect()}
    assert got[("c", "x")] == 2 and set(got) == {("c", "x"), ("c", "y")}
    assert [(r.name, round(r.estimate, 6)) for r in named.check_hlls(log).collect()] == [("h", 0.0)]
