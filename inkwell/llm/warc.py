"""WARC records, and the resolution of not-modified revisits.

A revisit record says that a page had not changed since it was last fetched; it has no payload. Each is joined to the
latest full response of the same canonical URL before it. The join is accepted if the validators agree: equal entity
tags where both sides have one, else equal Last-Modified dates. The result takes the payload of the response and its
headers, updated by those headers of the revisit that a 304 response may update.

The as-of join survives a URL with most of the records: records are first summed up by (URL, date), each (URL, day)
finds its last response by an aggregation, a window over the days of a URL carries it forward, and only the dates of
a day, 86,400 if they are whole seconds, are ordered. Revisits are joined to their (URL, date) and then to the response; a date or a
response with many revisits is joined by broadcast. Only (date, id) of responses is carried; their headers are joined
afterwards, and payloads stay out of every shuffle.

Defined results: a revisit without an earlier response has outcome `no_response`, with other validators `changed`;
equal dates are not earlier; of responses with one date the greatest record id wins; null URLs match nothing; records
with null dates are never matched; repeated header names keep the last value; repeated records each get a row; of
responses that share an id the one with the least payload digest is referred to; very long payloads are only digested
and counted; other columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import written
from inkwell.llm.urlfilter import lower_ascii
from inkwell.operators.graph import with_hubs

#: Headers of a 304 response that update the stored ones (RFC 7232, section 4.1, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
BUCKET_SECONDS = 86_400
CRLF = "\r\n"


def canonical(url: Column) -> Column:
    """Host in lower case without its default port, no scheme, fragment or tracking parameters; empty paths are '/'."""
    host = F.regexp_replace(lower_ascii(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)), r":(80|443)$", "")
    path = F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))), "&")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def header_map(block: Column) -> Column:
    """Lines `Name: value` as a map; names in lower case, the last of equal names wins; other lines are skipped."""
    lines = F.filter(F.split(block, CRLF), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(lower_ascii(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    last = F.filter(pairs, lambda p, i: F.array_position(F.slice(names, i + 2, F.size(names)), p["k"]) == 0)
    return F.map_from_entries(last)


def parse(records: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Record texts to columns: (record_id, type, url, date, headers of the HTTP response, payload)."""
    raw = F.col(raw_col)
    head = F.substring_index(raw, CRLF * 2, 1)
    body = F.regexp_extract(raw, r"(?s)^.*?\r\n\r\n(.*)$", 1)
    named = records.select(header_map(head).alias("warc"), body.alias("body"))
    return named.select(
        F.col("warc")["warc-record-id"].alias("record_id"),
        F.col("warc")["warc-type"].alias("type"),
        F.col("warc")["warc-target-uri"].alias("url"),
        F.try_to_timestamp(F.col("warc")["warc-date"], F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias("date"),
        header_map(F.substring_index("body", CRLF * 2, 1)).alias("headers"),
        F.regexp_extract("body", r"(?s)^.*?\r\n\r\n(.*)$", 1).alias("payload"),
    )


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row a revisit: (record_id, url, date, refers_to, outcome, headers, payload_sha256, payload_bytes).

    records: (record_id, type, url, date, headers map<string,string>, payload).
    """
    payload = F.when(F.col("type") == "response", F.col("payload"))
    slim = written(records.select("record_id", "type", "url", "date", "headers", canonical(F.col("url")).alias("page"), F.sha2(payload, 256).alias("payload_sha256"), F.octet_length(payload).alias("payload_bytes")), "warc-records")
    full = slim.where("type = 'response'")
    place = F.when(F.col("type") == "response", F.struct("date", "record_id"))
    points = slim.where("page is not null and date is not null and type in ('response', 'revisit')")
    moments = written(points.groupBy("page", "date").agg(F.max(place).alias("newest"), F.count_if(F.col("type") == "revisit").alias("n")).withColumn("bucket", F.floor(F.unix_timestamp("date") / bucket_seconds)), "warc-moments")
    per = moments.groupBy("page", "bucket").agg(F.max("newest").alias("last"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("page", "bucket", F.last("last", ignorenulls=True).over(earlier("page").orderBy("bucket")).alias("carried"))
    seen = moments.withColumn("seen", F.last("newest", ignorenulls=True).over(earlier("page", "bucket").orderBy("date"))).where("n > 0")
    matched = written(seen.join(carried, ["page", "bucket"]).select("page", "date", F.coalesce("seen", "carried")["record_id"].alias("refers_to"), "n"), "warc-matches")
    asked = slim.where("type = 'revisit'").select("record_id", "url", "date", "headers", "page", "date")
    total = asked.count()
    found = with_hubs(asked, matched, ["page", "date"], "n", total, "left").drop("n")
    times = matched.where("refers_to is not null").groupBy("refers_to").agg(F.sum("n").alias("n"))
    kept = F.min(F.struct("payload_sha256", "payload_bytes", F.array_sort(F.map_entries("headers")).alias("stored"))).alias("kept")
    source = full.groupBy(F.col("record_id").alias("refers_to")).agg(kept).select("refers_to", F.col("refers_to").alias("source"), F.map_from_entries("kept.stored").alias("stored"), "kept.payload_sha256", "kept.payload_bytes").join(times, "refers_to")
    both = with_hubs(found, source, ["refers_to"], "n", total, "left")
    new, old = F.col("headers"), F.col("stored")
    tags = new["etag"].isNotNull() & old["etag"].isNotNull()
    agrees = F.when(tags, new["etag"] == old["etag"]).otherwise(F.coalesce(new["last-modified"] == old["last-modified"], F.lit(False)))
    outcome = F.when(F.col("source").isNull(), "no_response").when(agrees, "resolved").otherwise("changed")
    may = F.map_filter(new, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(may), k)), may)
    done = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select("record_id", "url", "date", F.when(done, F.col("refers_to")).alias("refers_to"), "outcome", F.when(done, merged).alias("headers"), F.when(done, F.col("payload_sha256")).alias("payload_sha256"), F.when(done, F.col("payload_bytes")).alias("payload_bytes"))


def as_header(headers: Column) -> Column:
    """The map as lines in the order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def crawl(pages: DataFrame) -> DataFrame:
    """Record texts of a crawl that fetched every page once in full and asked again later, or sometimes earlier.

    The second fetch of a page was answered 304, with the page's entity tag, or with an old one for every seventh page.
    """
    hours = F.col("page_id") % 2000
    stamp = lambda h: F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + h * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    asked = F.when(F.col("page_id") % 7 == 0, F.lit('"old"')).otherwise(tag)
    again = stamp(hours + (F.col("page_id") * 5) % 90 - 10)

    def text(kind: str, first: str, when: Column, *http: Column | str, body: Column | None = None) -> Column:
        lines = ["WARC/1.1", F.concat(F.lit(f"WARC-Record-ID: <{kind}-"), F.col("page_id").cast("string"), F.lit(">")), f"WARC-Type: {kind}", F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Date: "), when), "", first, F.concat(F.lit("Date: "), when), *http, ""]
        joined = F.concat_ws(CRLF, *[x if isinstance(x, Column) else F.lit(x) for x in lines])
        return F.concat(joined, F.lit(CRLF), body if body is not None else F.lit(""))

    full = text("response", "HTTP/1.1 200 OK", stamp(hours), F.concat(F.lit("ETag: "), tag), "Content-Type: text/html", "Cache-Control: max-age=60", body=F.coalesce("html", F.lit("")))
    none = text("revisit", "HTTP/1.1 304 Not Modified", again, F.concat(F.lit("ETag: "), asked), "Content-Type: text/plain", "Cache-Control: max-age=90", "Server: cache")
    return pages.select(F.explode(F.array(full, none)).alias("raw"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = resolve(parse(crawl(pages)))
    return found.select("record_id", "url", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "refers_to", "outcome", as_header(F.col("headers")).alias("headers"), "payload_sha256", F.col("payload_bytes").cast("long").alias("payload_bytes"))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS tag,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (page_id % 2000) AS fetched,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (page_id % 2000 + (page_id * 5) % 90 - 10) AS again,
    regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':(80|443)$', '') AS host,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS query
  FROM pages
), c AS (
  SELECT *, host || (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN len(query) = 0 THEN '' ELSE '?' || array_to_string(query, '&') END) AS page FROM p
), matched AS (
  SELECT r.page_id, arg_max(f.page_id, (f.fetched, '<response-' || f.page_id || '>')) AS source
  FROM c r JOIN c f ON f.page = r.page AND f.fetched < r.again GROUP BY r.page_id
), merged AS (
  SELECT r.*, f.page_id AS source, f.tag AS stored, f.html AS payload, strftime(r.again, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
    f.page_id IS NOT NULL AND r.page_id % 7 <> 0 AND f.tag = r.tag AS done
  FROM c r LEFT JOIN matched m USING (page_id) LEFT JOIN c f ON f.page_id = m.source
)
SELECT '<revisit-' || page_id || '>' AS record_id, url, strftime(again, '%Y-%m-%d %H:%M:%S') AS fetched,
  CASE WHEN done THEN '<response-' || source || '>' END AS refers_to,
  CASE WHEN source IS NULL THEN 'no_response' WHEN done THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN done THEN 'cache-control: max-age=90' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || stamp || chr(10) || 'etag: "' || tag || '"' END AS headers,
  CASE WHEN done THEN sha256(payload) END AS payload_sha256,
  CASE WHEN done THEN strlen(payload) END AS payload_bytes
FROM merged
"""
