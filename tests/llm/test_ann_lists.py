"""The lists that a query reads must grow with the number of lists."""

import numpy as np

from stratalog.llm import ann


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 8)  # 1,000 lists
    x = np.random.default_rng(1).normal(size=(8000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, k=20, every=40).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, 8000, 40):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-s)[:20].tolist()))
    print("recall", hits / (200 * 20))
    assert hits >= 0.9 * 200 * 20
