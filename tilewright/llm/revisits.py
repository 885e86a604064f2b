"""Not-modified revisit resolution for web archives.

A ``revisit`` capture (HTTP 304) has no body of its own. It resolves to the latest earlier full response (status 200) of its canonical URL,
an as-of join on (canonical URL, time), and takes that response's payload if the validators agree:
a revisit with an entity tag needs the weak-equal tag of that response; one without a tag needs an equal ``last_modified``; one with neither is taken as it is.
``status`` says which case holds: ``resolved``, ``mismatch`` (validators differ; nothing is merged) or ``orphan`` (no earlier response).

Headers of the merged response: those of the full response, overridden by what a 304 may carry
(``cache-control``, ``content-location``, ``date``, ``etag``, ``expires``, ``vary``, ``last-modified``, ``set-cookie``, ``age``, ``via``, ``warning``).

The as-of join runs on narrow rows without bodies, in two levels, so that a URL with very many captures is no single task: time is cut into buckets of
about ``BUCKET`` captures by approximate quantiles of all times; in a (URL, bucket) a window finds the latest full response so far; the
latest of each earlier bucket is carried in by a window over bucket summaries, one row for each (URL, bucket). Payloads are joined last, by capture id.

Defined cases: at equal times full responses come before revisits, and of equally late full responses the one of largest id wins;
null URLs are one URL; null times are earliest; null header maps are empty; repeated captures give repeated rows but ids are expected to be unique among
full responses; an empty table gives no rows; only the columns named here are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import table

BUCKET = 5000
CUTS = 1000
# Header fields that a not-modified response may replace.
PERMITTED = "age cache-control content-location date etag expires last-modified set-cookie vary via warning".split()


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment, a trailing slash of the path or tracking parameters; parameters sorted."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    front = F.lower(F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1))
    rest = bare.substr(F.char_length(front) + 1, F.char_length(bare))
    path = F.regexp_replace(F.substring_index(rest, "?", 1), r"/+$", "")
    query = F.when(F.locate("?", rest) > 0, rest.substr(F.locate("?", rest) + 1, F.char_length(rest))).otherwise("")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|fbclid|gclid|ref|sessionid|sid)(=|$)"))), "&")
    host = F.regexp_replace(F.regexp_replace(front, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^[wW]/", "")


def resolve(captures: DataFrame) -> DataFrame:
    """``captures(capture_id, url, time, status_code, etag, last_modified, headers)``: each revisit with ``canonical``, ``source_id``, ``source_time``, ``status`` and
    merged ``headers``."""
    full = F.coalesce(F.col("status_code") == 200, F.lit(False))
    revisit = F.coalesce(F.col("status_code") == 304, F.lit(False))
    rows = captures.where(full | revisit).select(
        "capture_id",
        canonical_url(F.col("url")).alias("canonical"),
        F.coalesce(F.col("time"), F.lit(-(1 << 62))).alias("time"),
        full.alias("full"),
        F.col("etag"),
        F.col("last_modified"),
        F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")).alias("headers"),
    )
    stats = captures.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("time", [i / CUTS for i in range(1, CUTS)], 10_000).alias("q")).first()
    wanted = min(CUTS, max(1, stats["n"] // BUCKET))
    cuts = sorted({stats["q"][min(len(stats["q"]) - 1, i * CUTS // wanted)] for i in range(1, wanted)}) if stats["q"] else []
    # the place of the time among the cuts, by bisection over a constant array
    found = F.lit(0)
    if cuts:
        bounds = F.lit(cuts)
        step, found = 1 << (len(cuts).bit_length() - 1), F.lit(0)
        rows = rows.withColumn("bucket", found)
        while step:
            ahead = F.col("bucket") + step
            rows = rows.withColumn("bucket", F.when((ahead <= len(cuts)) & (F.get(bounds, ahead - 1) <= F.col("time")), ahead).otherwise(F.col("bucket")))
            step >>= 1
    else:
        rows = rows.withColumn("bucket", found)
    offer = F.when(F.col("full"), F.struct("time", F.col("capture_id").alias("id"), "etag", "last_modified", "headers"))
    rows = rows.withColumn("offer", offer)
    inside = W.partitionBy("canonical", "bucket").orderBy("time", F.col("full").desc(), "capture_id").rowsBetween(W.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last("offer", ignorenulls=True).over(inside)).where(~F.col("full")).drop("offer")
    latest = rows.groupBy("canonical", "bucket").agg(F.max_by("offer", F.when(F.col("full"), F.struct("time", "capture_id"))).alias("own"))
    carried = latest.select(
        F.col("canonical").alias("__u"), F.col("bucket").alias("__b"), F.last("own", ignorenulls=True).over(W.partitionBy("canonical").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)).alias("far")
    )
    both = near.join(carried, (near["canonical"] == carried["__u"]) & (near["bucket"] == carried["__b"]), "left")
    both = both.withColumn("source", F.coalesce("near", "far"))
    tags = F.when(F.col("etag").isNotNull(), F.coalesce(weak(F.col("etag")) == weak(F.col("source.etag")), F.lit(False)))
    dates = F.when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("source.last_modified"), F.lit(False)))
    agreed = F.coalesce(tags, dates, F.lit(True))
    status = F.when(F.col("source").isNull(), "orphan").when(agreed, "resolved").otherwise("mismatch")
    own = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("source.headers", lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    return both.withColumn("status", status).select(
        "capture_id",
        "canonical",
        "time",
        "status",
        F.when(F.col("status") == "resolved", F.col("source.id")).alias("source_id"),
        F.when(F.col("status") == "resolved", F.col("source.time")).alias("source_time"),
        F.when(F.col("status") == "resolved", merged).otherwise(F.col("headers")).alias("headers"),
    )


def with_payload(resolved: DataFrame, captures: DataFrame, payload: str) -> DataFrame:
    """``resolved`` with the column ``payload`` of its source; null where there is none."""
    sources = captures.select(F.col("capture_id").alias("source_id"), payload)
    return resolved.join(sources, "source_id", "left")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """An archive made of ``pages(page_id, url, html)``: the page as a full response at time 3 ``page_id`` with a digest as its
    entity tag, and a revisit of it at a later time, 3 (``page_id`` + 40) + 1. Of each 16 revisits one has another tag, one a weak tag, one only a date; every
    32nd page is only a revisit."""
    digest = F.substring(F.sha2(F.coalesce(F.col("html"), F.lit("")), 256), 1, 16)
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    page = pages.select("page_id", "url", digest.alias("digest"), F.octet_length("html").alias("length"), F.pmod("page_id", F.lit(16)).alias("case"), (F.pmod("page_id", F.lit(32)) == 31).alias("lost"))
    day = lambda c: F.date_format(F.timestamp_seconds(c * 3600), "yyyy-MM-dd HH:mm:ss")
    kinds = F.explode(F.when(F.col("lost"), F.array(F.lit(304))).otherwise(F.array(F.lit(200), F.lit(304))))
    rows = page.withColumn("status_code", kinds).withColumn("time", F.when(F.col("status_code") == 200, F.col("page_id") * 3).otherwise((F.col("page_id") + 40) * 3 + 1))
    again = F.col("status_code") == 304
    etag = F.when(again & (F.col("case") == 3), quote(F.lit("other"))).when(again & (F.col("case") == 5), F.concat(F.lit("W/"), quote("digest"))).when(again & (F.col("case") == 7), None).otherwise(quote("digest"))
    modified = day(F.col("page_id"))
    headers = F.when(again, F.create_map(F.lit("date"), day(F.col("time")), F.lit("content-length"), F.lit("0"))).otherwise(
        F.create_map(F.lit("date"), day(F.col("time")), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.coalesce(F.col("length"), F.lit(0)).cast("string"))
    )
    return rows.select((F.col("page_id") * 2 + again.cast("long")).alias("capture_id"), "url", "time", "status_code", etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = resolve(captures_of_pages(pages))
    return found.select("capture_id", "canonical", "time", "status", "source_id", "source_time", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers")))).alias("headers"))


_CANONICAL = r"""
  SELECT *, regexp_replace(regexp_replace(front, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
    || regexp_replace(split_part(rest, '?', 1), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS canonical
  FROM (SELECT *, list_filter(string_split(CASE WHEN contains(rest, '?') THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END, '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|ref|sessionid|sid)(=|$)')) AS kept
    FROM (SELECT *, substr(bare, length(front) + 1) AS rest
      FROM (SELECT *, lower(regexp_extract(bare, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) AS front
        FROM (SELECT *, regexp_replace(coalesce(url, ''), '#.*$', '', 's') AS bare FROM pages) a) b) c) d
"""

#: The same in SQL: pages as an archive, then an as-of join.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, canonical, substr(sha256(coalesce(html, '')), 1, 16) AS digest, coalesce(strlen(html), 0) AS length, page_id % 16 AS kind FROM ({_CANONICAL}) u),
f AS (SELECT page_id * 2 AS capture_id, canonical, page_id * 3 AS time, '"' || digest || '"' AS etag, length FROM p WHERE page_id % 32 <> 31),
r AS (SELECT page_id * 2 + 1 AS capture_id, page_id, canonical, (page_id + 40) * 3 + 1 AS time,
    CASE WHEN kind = 3 THEN '"other"' WHEN kind = 7 THEN NULL ELSE '"' || digest || '"' END AS etag FROM p),
j AS (SELECT r.*, f.capture_id AS fid, f.time AS ftime, f.etag AS fetag, f.length AS flength,
    row_number() OVER (PARTITION BY r.capture_id ORDER BY f.time DESC, f.capture_id DESC) AS k
  FROM r LEFT JOIN f ON f.canonical = r.canonical AND f.time <= r.time),
s AS (SELECT *, CASE WHEN fid IS NULL THEN 'orphan' WHEN etag IS NOT NULL THEN CASE WHEN etag = fetag THEN 'resolved' ELSE 'mismatch' END
    WHEN page_id = fid // 2 THEN 'resolved' ELSE 'mismatch' END AS status,
    strftime(epoch_ms(time * 3600000), '%Y-%m-%d %H:%M:%S') AS day FROM j WHERE k = 1)
SELECT capture_id, canonical, time, status, CASE WHEN status = 'resolved' THEN fid END AS source_id, CASE WHEN status = 'resolved' THEN ftime END AS source_time,
  CASE WHEN status = 'resolved' THEN '{{"content-length":"' || flength || '","content-type":"text/html","date":"' || day || '"}}' ELSE '{{"content-length":"0","date":"' || day || '"}}' END AS headers
FROM s
"""
