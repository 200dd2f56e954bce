"""Entries of any depth block."""

from stratalog.llm import urls


def test_deep_hosts_and_paths(spark):
    host = "a.b.c.d.e.f.g.h.example.com"
    pages = [(1, "https://x.example.com/1/2/3/4/5/6", "2024-05-05"), (2, f"https://{host}/p", "2024-05-05"), (3, "https://x.example.com/1/2/3/4/6", "2024-05-05"), (4, f"https://z.{host}/", "2024-05-05"), (5, "https://b.c.d.e.f.g.h.example.com/", "2024-05-05")]
    entries = [("x.example.com/1/2/3/4/5", "deep", "2024-01-01", "add"), (host, "long", "2024-01-01", "add")]
    df = spark.createDataFrame(pages, "page_id long, url string, fetched string")
    rules = {r.page_id: r.rule for r in urls.judge(df, spark.createDataFrame(entries, "key string, category string, day string, action string")).collect()}
    assert rules == {1: entries[0][0], 2: host, 3: None, 4: host, 5: None}
