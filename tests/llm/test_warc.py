from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from leadlode.llm import warc

SCHEMA = "record_id long, url string, ts long, status int, headers string, payload_digest string, payload_length long, canonical string"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://www.A.example:80/x/#top", "a.example/x"),
        ("https://a.example/x?utm_source=q&b=2&a=1", "a.example/x?a=1&b=2"),
        ("a.example", "a.example"),
        ("HTTPS://a.example/?ref=1", "a.example"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(evaluate, url, want):
    assert evaluate(warc.canonical_url(F.col("x")), [url]) == [want]


def test_headers(evaluate):
    text = warc.header_text(warc.parsed_headers(F.col("x")))
    assert evaluate(text, ["B: 1\r\na : x: y\r\nb: 2\r\nno colon\r\n: none", "", None]) == ["a: x: y\nb: 2", "", ""]


def plain(rows):
    out = {}
    for r in rows:
        i, url, ts, status, tag = r
        if status != 304:
            out[i] = ("full", None)
            continue
        before = [x for x in rows if x[1] == url and x[3] == 200 and (x[2], x[0]) < (ts, i)]
        base = max(before, key=lambda x: (x[2], x[0]), default=None)
        if base is None:
            out[i] = ("no_original", None)
        elif tag is None:
            out[i] = ("no_validator", None)
        else:
            out[i] = ("resolved", base[0]) if tag == base[4] else ("changed", None)
    return out


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_as_of_join(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(i, rnd.choice(["u/a", "u/b", "u/c"]), rnd.randrange(60), rnd.choice([200, 304, 304]), rnd.choice(["1", "2", None])) for i in range(200)]
    full = [(i, u, t, s, f'ETag: "{e}"' if e else "", f"d{i}" if s == 200 else None, i, "own") for i, u, t, s, e in rows]
    got = warc.resolve_revisits(spark.createDataFrame(full, SCHEMA), ranges).collect()
    assert {r["row"]["record_id"]: (r["outcome"], r["refers_to"]) for r in got} == plain(rows)
    assert all(r["payload_digest"] == f"d{r['refers_to']}" for r in got if r["outcome"] == "resolved")
    assert all(r["row"]["canonical"] == "own" for r in got)


def test_odd_rows(spark):
    rows = [
        (1, "http://a/x", 5, 200, 'ETag: W/"1"\r\nContent-Length: 9\r\nCache-Control: a', "d1", 9, None),
        (2, "https://www.a/x/", 5, 304, 'etag: "1"\r\nContent-Length: 0\r\nCache-Control: b\r\nX: y', None, None, None),
        (2, "https://www.a/x/", 5, 304, 'etag: "1"\r\nContent-Length: 0\r\nCache-Control: b\r\nX: y', None, None, None),
        (3, None, 6, 304, 'etag: "1"', None, None, None),
        (4, "http://a/x", None, 304, 'etag: "1"', None, None, None),
        (None, "http://a/x", 7, 304, None, None, None, None),
        (6, "http://a/x", 8, 404, "", "d6", 1, None),
        (7, "", 9, None, "x" * 100_000, None, None, None),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r["row"]["record_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[2]["refers_to"] == 1 and by[2]["headers"] == 'cache-control: b\ncontent-length: 9\netag: "1"\nx: y'
    assert [by[k]["outcome"] for k in (1, 3, 4, None, 6, 7)] == ["full", "no_original", "no_original", "no_validator", "other", "other"]
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
