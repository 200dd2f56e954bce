"""Neighbours, URL filter, secret scan, pipeline."""

import random

import duckdb
import numpy as np
import pytest

from stratalog.llm import ann, secrets, urls

INF = float("inf")


def vectors(seed=1, n=900, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(n, dim)).astype(np.float32))]
    rows += [(2000 + i, rows[40][1]) for i in range(60)]  # copies, queries among them
    rows += [(3000, None), (3020, [0.0] * dim), (3040, [1.0, None] + [0.0] * (dim - 2)), (3060, [INF] + [0.0] * (dim - 1)), (3080, [float("nan")] * dim), (3100, [1.0]), (None, rows[3][1]), (60, rows[60][1]), (3120, [-0.0] * (dim - 1) + [2.0]), (3121, [0.0] * (dim - 1) + [2.0])]
    return rows


def plain(rows, k, every):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    for i, v in sorted(ok):
        if i % every == 0:
            s = x @ np.array(v)
            order = [j for j in np.lexsort((ids, -np.round(s, 9))) if ids[j] != i][:k]
            yield i, [(int(ids[j]), round(float(s[j]), 6)) for j in order]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    return out


def test_neighbours_of_a_small_table(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, query_id string, rank int")
    got, want = found(ann.neighbours(df)), dict(plain(rows, 20, 20))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 20 * len(want)
    assert ann.neighbours(df.limit(0)).count() == 0


def test_all_if_there_are_few(spark):
    df = spark.createDataFrame([(i * 10, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    got = found(ann.neighbours(df))
    assert got[0] == [(10, 1.0), (20, 1.0), (30, 1.0), (40, 1.0)] and got[20] == [(40, 9.0), (30, 7.0), (10, 3.0), (0, 1.0)]
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert found(ann.neighbours(one)) == {}


def test_many_lists_and_parts(spark, monkeypatch):
    for name, value in (("LIST", 16), ("PART", 8), ("LISTS", 12), ("BEAM", 12), ("DEGREE", 8)):
        monkeypatch.setattr(ann, name, value)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = found(ann.neighbours(df)), dict(plain(rows, 20, 20))
    assert got.keys() == want.keys()
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.8 * 20 * len(want)


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(600, 12))
    g = ann.Graph(c, 1.0)
    x = rng.normal(size=(200, 12))
    ids, dist = g.search(x, 48)
    true = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (ids[:, 0] == true.argmin(1)).mean() > 0.95 and (np.diff(dist, axis=1) >= 0).all()


ENTRIES = [("bad.com", "a", "2024-01-10", "add"), ("bad.com", "a", "2024-02-10", "remove"), ("bad.com", "a", "2024-03-01", "add"), ("sub.bad.com/x", "b", "2024-01-01", "add"), ("BAD.com", "c", "2024-01-15", "add"),
           ("bad.com", "c", "2024-01-15", "remove"), (None, "a", "2024-01-01", "add"), ("q.org/a/b", "d", "2024-01-01", "add"), ("q.org/a/b", "d", "2024-01-01", "add")]


def judged(spark, captures, entries=ENTRIES):
    df = spark.createDataFrame([(i, u, d, "x") for i, (u, d) in enumerate(captures)], "page_id long, url string, fetched string, rule string")
    return [(r.blocked, r.rule, r.category, r.n_rules) for r in sorted(urls.judge(df, spark.createDataFrame(entries, "key string, category string, day string, action string")).collect(), key=lambda r: r.page_id)]


def test_urls_are_judged_at_their_time(spark):
    day = lambda u, d: (u, d)
    got = judged(spark, [
        day("http://bad.com/", "2024-01-09"), day("http://bad.com/", "2024-01-10"), day("https://www.BAD.com:80/p?q#f", "2024-02-09"), day("http://bad.com", "2024-02-10"), day("http://user@a.sub.bad.com/x/y", "2024-03-02"),
        day("http://notbad.com/", "2024-04-01"), day("http://sub.bad.com/xx", "2024-02-15"), day("http://q.org/a/b/c", "2024-05-01"), day("http://q.org/a/bc", "2024-05-01"), day(None, "2024-01-01"), day("http://bad.com/", None), day("nonsense", "2024-01-11"), day("", "2024-01-11"),
    ])
    no = (False, None, None, 0)
    assert got == [no, (True, "bad.com", "a", 1), (True, "bad.com", "a", 1), no, (True, "sub.bad.com/x", "b", 2), no, no, (True, "q.org/a/b", "d", 1), no, no, no, no, no]


def test_urls_without_a_list_and_by_shuffle(spark, monkeypatch):
    assert judged(spark, [("http://bad.com/", "2024-01-11")] * 2, []) == [(False, None, None, 0)] * 2
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert judged(spark, [("http://bad.com/", "2024-01-11")] * 3) == [(True, "bad.com", "a", 1)] * 3


def test_url_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    got = urls.op6_url_filter(spark, d)
    want = con.execute(urls.ORACLE)
    names = [c[0] for c in want.description]
    key = lambda r: r[0]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.fixture(scope="module")
def found_in(spark):
    def run(texts):
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, score string, nth int")
        return sorted(tuple(r) for r in secrets.scan(df).collect())

    return run


def test_secrets(found_in):
    h = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'é text token = "{h}" more', f"commit {h} fixed it", "internationalizationofeverything is a word", None, "", "short tokens only", f'api_key="{h}" and secret: {h}', f'api_key="{h}" and secret: {h}', "see src/library/module/handler/index", "x" * 5000, "password = xxxxxxxxxxxxxxxxxxxxxxxxxxxx"]
    rows = found_in(texts)
    for doc, _, start, length, _, _, cand in rows:
        assert texts[doc][start : start + length] == cand
    assert {(r[0], r[5]) for r in rows} >= {(0, True), (1, False), (2, False), (6, True), (7, True), (8, False), (9, False), (10, False)}
    assert [r[1] for r in rows if r[0] == 6] == [0, 1] and not any(r[0] in (3, 4, 5) for r in rows)


def test_forest_is_right_on_new_findings(spark):
    trees = secrets.train(spark)
    fresh = secrets.labelled_findings(600, seed=99)
    rows = secrets.candidates(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(fresh)], "doc_id long, text string"))
    wide = rows.withColumns(secrets.features(rows.cand, rows.before, rows.after))
    from functools import reduce

    score = reduce(lambda a, b: a + b, map(secrets.tree_column, trees)) / len(trees)
    made = wide.select("doc_id", *secrets.FEATURES, score.alias("score")).collect()
    for r in random.Random(1).sample(made, 40):  # the column is the forest
        assert abs(r["score"] - np.mean([secrets.predict(t, np.array(r[1:-1])) for t in trees])) < 1e-9
    assert np.mean([(r["score"] >= 0.5) == fresh[r["doc_id"]][1] for r in made]) > 0.95


def test_redaction(spark):
    h = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = spark.createDataFrame([(1, f'token = "{h}"'), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs, secrets.scan(docs)).collect()}
    assert got == {1: 'token = "<SECRET>"', 2: "clean", 3: None}


def test_pipeline(spark):
    import corpus_pipeline as cp

    from stratalog.llm.common import materialize

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, d))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4] > 0
    packed = materialize(cp.STAGES[-1][1](spark, docs, d))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    whole = cp.run(spark, d)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
