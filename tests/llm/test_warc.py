from datetime import datetime, timedelta

import pyspark.sql.functions as F

from inkwell.llm import warc as W

T0 = datetime(2024, 1, 1)
SCHEMA = "record_id string, type string, url string, date timestamp, headers map<string,string>, payload string, page string"


def at(h):
    return T0 + timedelta(hours=h)


ROWS = [
    ("r1", "response", "http://A.com/x?utm_a=1&q=2#f", at(0), {"etag": "1", "content-type": "t", "x": "old"}, "body one", ""),
    ("r2", "response", "https://a.com:443/x?q=2", at(50), {"etag": "2"}, "body two é", ""),
    ("v0", "revisit", "http://a.com/x?q=2", at(0), {"etag": "1"}, None, ""),
    ("v1", "revisit", "http://a.com/x?q=2", at(1), {"etag": "1", "x": "new", "vary": "a"}, None, ""),
    ("v2", "revisit", "http://a.com/x?q=2", at(51), {"etag": "1"}, None, ""),
    ("v3", "revisit", "http://a.com/x?q=2", at(900), {"etag": "2"}, None, ""),
    ("v3", "revisit", "http://a.com/x?q=2", at(900), {"etag": "2"}, None, ""),
    ("v4", "revisit", "http://b.com", at(900), {"etag": "2"}, None, ""),
    ("v5", "revisit", None, at(900), {"etag": "2"}, None, ""),
    ("v6", "revisit", "http://a.com/x?q=2", None, None, None, ""),
    ("r3", "response", "http://c.com", at(3), {"last-modified": "d"}, "", ""),
    ("v7", "revisit", "http://c.com/", at(5), {"last-modified": "d", "etag": "9"}, None, ""),
    ("v8", "revisit", "http://c.com/", at(5), {}, None, ""),
]


def test_cases_by_hand(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for width in (W.BUCKET_SECONDS, 3600, 10**9):
        got = sorted((r.record_id, r.outcome, r.refers_to) for r in W.resolve(df, width).collect())
        assert got == [("v0", "no_response", None), ("v1", "resolved", "r1"), ("v2", "changed", None), ("v3", "resolved", "r2"), ("v3", "resolved", "r2"), ("v4", "no_response", None), ("v5", "no_response", None), ("v6", "no_response", None), ("v7", "resolved", "r3"), ("v8", "changed", None)], width
    by = {r.record_id: r for r in W.resolve(df).collect()}
    assert by["v1"].headers == {"etag": "1", "content-type": "t", "x": "old", "vary": "a"} and by["v1"].payload_bytes == 8
    assert by["v3"].payload_bytes == len("body two é".encode()) and by["v2"].headers is None


def test_hot_url_equals_brute_force(spark):
    rows = [(f"r{i:04}", "response", "http://a.com/", at(i * 37 % 1000), {"etag": str(i)}, str(i), "") for i in range(150)]
    rows += [(f"v{i:04}", "revisit", "http://a.com", at(i * 53 % 1100), {"etag": str(i % 150)}, None, "") for i in range(300)]
    want = {}
    for v in rows[150:]:
        best = max(((r[3], r[0]) for r in rows[:150] if r[3] < v[3]), default=None)
        want[v[0]] = None if best is None else best[1] if best[1] == f"r{int(v[4]['etag']):04}" else "other"
    got = W.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 300
    for r in got:
        assert r.refers_to == (want[r.record_id] if want[r.record_id] != "other" else None)
        assert r.outcome == {None: "no_response", "other": "changed"}.get(want[r.record_id], "resolved")


def test_parse(spark):
    text = "WARC/1.1\r\nWARC-Record-ID: <a>\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/y:z\r\nWARC-Date: 2024-01-02T03:04:05Z\r\n\r\nHTTP/1.1 200 OK\r\nETag: \"1\"\r\nA: 1\r\na: 2\r\nbroken\r\n\r\nbody\r\n\r\nmore"
    r, none = W.parse(spark.createDataFrame([(text,), (None,)], "raw string")).collect()
    assert (r.record_id, r.type, r.url, r.date) == ("<a>", "response", "http://x/y:z", datetime(2024, 1, 2, 3, 4, 5))
    assert r.headers == {"etag": '"1"', "a": "2"} and r.payload == "body\r\n\r\nmore"
    assert none.record_id is None
    assert W.parse(spark.createDataFrame([("garbage",)], "raw string")).first().date is None


def test_no_rows_and_null_pages(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert W.resolve(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.com", "x"), (2, "http://a.com", "x")], "page_id long, url string, html string")
    assert W.resolve(W.parse(W.crawl(pages))).where(F.col("record_id") == "<revisit-2>").count() == 1
