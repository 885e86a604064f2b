import random

import pytest

from tilewright.llm import revisits as m

SCHEMA = "capture_id long, url string, time long, status_code int, etag string, last_modified string, headers map<string,string>"


def brute(captures):
    bare = lambda t: t[2:] if t and t[:2] in ("W/", "w/") else t
    out = {}
    for cid, url, time, code, etag, modified, headers in captures:
        if code != 304:
            continue
        at = -(1 << 62) if time is None else time
        full = [c for c in captures if c[3] == 200 and c[1] == url and (-(1 << 62) if c[2] is None else c[2]) <= at]
        if not full:
            out[cid] = ("orphan", None, headers or {})
            continue
        best = max(full, key=lambda c: (-(1 << 62) if c[2] is None else c[2], c[0]))
        agreed = bare(etag) == bare(best[4]) if etag is not None else modified == best[5] if modified is not None else True
        merged = {**(best[6] or {}), **{k: v for k, v in (headers or {}).items() if k in m.PERMITTED}}
        out[cid] = ("resolved", best[0], merged) if agreed else ("mismatch", None, headers or {})
    return out


def found(df):
    return {r.capture_id: (r.status, r.source_id, r.headers) for r in df.collect()}


@pytest.mark.parametrize("bucket", [1, 20, 5000])
def test_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET", bucket)
    rng = random.Random(bucket)
    rows = []
    for i in range(400):
        url = rng.choice(["http://hot.example.com/x"] * 5 + [f"http://e.com/{k}" for k in range(12)])
        code = rng.choice([200, 304, 304, 404, None])
        etag, modified = rng.choice(['"a"', 'W/"a"', '"b"', None]), rng.choice(["d1", "d2", None])
        headers = rng.choice([None, {}, {"date": str(i), "content-type": "t", "x": "1"}, {"etag": "e"}])
        rows.append((i, url, rng.choice([None, *range(60)]), code, etag, modified, headers))
    assert found(m.resolve(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_canonical(spark):
    urls = {
        "HTTP://Ex.com:80/A/?b=2&utm_x=1&a=1#f": "http://ex.com/A?a=1&b=2", "https://e.com": "https://e.com", "https://e.com:443/": "https://e.com", "http://e.com:443/": "http://e.com:443",
        None: "", "": "", "x?": "x", "http://e.com/?": "http://e.com", "http://e.com/a?ref=1&reference=2": "http://e.com/a?reference=2",
    }
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", m.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == urls


def test_query_and_payload(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    captures = m.captures_of_pages(pages)
    rows = [(r.capture_id, r.c, r.time, r.status_code, r.etag, r.last_modified, r.headers) for r in captures.withColumn("c", m.canonical_url(captures["url"])).collect()]
    want = brute(rows)
    got = {r.capture_id: (r.status, r.source_id) for r in m.op6_warc_revisits(spark, sf).collect()}
    assert got == {k: v[:2] for k, v in want.items()} and len(got) == pages.count()
    assert {s for s, _ in got.values()} == {"resolved", "mismatch", "orphan"}
    bodies = captures.withColumn("payload", captures["url"])
    taken = m.with_payload(m.resolve(captures), bodies, "payload").collect()
    assert all((r.payload is None) == (r.source_id is None) for r in taken) and len(taken) == len(got)


def test_odd_rows(spark):
    rows = [(1, None, None, 200, None, None, None), (2, None, None, 304, None, None, None), (3, "u", 5, 304, '"x"', None, None), (3, "u", 5, 304, '"x"', None, None), (4, "u", 5, 200, '"x"', None, None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA + ", canonical string, bucket int")
    got = m.resolve(df).collect()
    assert sorted((r.capture_id, r.status, r.source_id) for r in got) == [(2, "resolved", 1), (3, "resolved", 4), (3, "resolved", 4)]
    assert m.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
