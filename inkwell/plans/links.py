"""Queries on pages and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import links as L
from inkwell.registry import query, table

HOST = "lower(regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
HREFS = "hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) AS url FROM pages)"
MADE = "CASE page_id % 5 WHEN 0 THEN 'BROKEN' WHEN 1 THEN 'REDIRECT' WHEN 2 THEN 'TIMEOUT' ELSE 'WORKING' END"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def hrefs(spark: SparkSession, sf: str) -> DataFrame:
    return L.extract_pages(pages(spark, sf)).select("page_id", F.explode("hrefs").alias("url"))


@query("s3_extract_pages", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title, array_to_string(regexp_extract_all(html, '(?is)<h[1-6][^>]*>([^<]*)</h[1-6]>', 1), '|') AS headings, len(regexp_extract_all(html, '(?i)href="([^"]*)"', 1))::BIGINT AS hrefs,
  length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::BIGINT AS chars FROM pages""")
def extract_pages(spark: SparkSession, sf: str) -> DataFrame:
    return L.extract_pages(pages(spark, sf)).select("page_id", "title", F.array_join("headings", "|").alias("headings"), F.size("hrefs").cast("long").alias("hrefs"), F.length("text").cast("long").alias("chars"))


@query("s4_parse_url_list", r"""WITH l AS (SELECT page_id, url || ' , #note;' || substr(url, strpos(url, '://') + 3) || chr(10) || url || ';plain,' AS t FROM pages), c AS (SELECT page_id, generate_subscripts(p, 1) - 1 AS pos, trim(unnest(p)) AS item FROM (SELECT page_id, string_split_regex(t, '[\n,;]') AS p FROM l)),
u AS (SELECT page_id, pos, CASE WHEN regexp_matches(item, '^(http|https|ftp)://') THEN item WHEN contains(item, '.') AND item NOT LIKE '.%' THEN 'https://' || item END AS url FROM c WHERE item <> '' AND item NOT LIKE '#%') SELECT page_id, url, min(pos)::INTEGER AS pos FROM u WHERE url IS NOT NULL GROUP BY ALL""")
def parse_url_list(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.expr("substring(url, instr(url, '://') + 3)")
    text = F.concat("url", F.lit(" , #note;"), bare, F.lit("\n"), "url", F.lit(";plain,"))
    return L.parse_url_list(pages(spark, sf).select("page_id", text.alias("t")), "page_id", "t")


@query("t19_classify_link", rf"WITH {HREFS}, a AS (SELECT url FROM hrefs UNION ALL SELECT url FROM pages) SELECT CASE WHEN trim(url) = '' THEN 'empty' WHEN trim(url) LIKE '#%' THEN 'bookmark' WHEN regexp_matches(trim(url), '^(\\\\|//)[^/\\]') THEN 'network_path' WHEN regexp_matches(trim(url), '^([A-Za-z]:[\\/]|file:|/|\.{{1,2}}/)') THEN 'file_path' WHEN regexp_matches(trim(url), '(?i)^mailto:') THEN 'mailto' WHEN regexp_matches(trim(url), '(?i)^(https?|ftp)://') THEN 'web' ELSE 'unknown' END AS kind, count(*) AS links FROM a GROUP BY 1")
def classify_link(spark: SparkSession, sf: str) -> DataFrame:
    every = hrefs(spark, sf).select("url").unionByName(pages(spark, sf).select("url"))
    return every.groupBy(L.classify_link(F.col("url")).alias("kind")).agg(F.count("*").alias("links"))


@query("r9_link_format_rules", rf"""WITH {HREFS}, a AS (SELECT url FROM hrefs UNION ALL SELECT url FROM pages UNION ALL SELECT replace(url, '.com', '.con') FROM pages UNION ALL SELECT replace(url, '://', ':///') FROM pages), h AS (SELECT url, {HOST.format("url")} AS h FROM a),
i AS (SELECT unnest(list_filter([CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN 'no scheme' END, CASE WHEN h = '' THEN 'no host' END, CASE WHEN contains(h, '..') THEN 'double dot' END, CASE WHEN regexp_matches(url, '\s') THEN 'space' END, CASE WHEN contains(url, ':///') THEN 'triple slash' END, CASE WHEN regexp_matches(h, '\.(con|cmo|ocm|ogr|nte)$') THEN 'misspelt top-level domain' END, CASE WHEN h <> '' AND NOT contains(h, '.') THEN 'no dot in host' END], lambda x: x IS NOT NULL)) AS issue FROM h) SELECT issue, count(*) AS links FROM i GROUP BY 1""")
def link_format_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf)
    every = hrefs(spark, sf).select("url").unionByName(p.select("url")).unionByName(p.select(F.replace("url", F.lit(".com"), F.lit(".con")).alias("url"))).unionByName(p.select(F.replace("url", F.lit("://"), F.lit(":///")).alias("url")))
    return every.select(F.explode(L.format_issues(F.col("url"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("links"))


SHORT = "|".join(s.replace(".", r"\.") for s in L.SHORTENERS)


@query("r11_suspicious_urls", rf"""WITH a AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'http://10.0.0.' || page_id || '/x' FROM pages UNION ALL SELECT page_id, 'http://a.b.c.d.e.example.com:8080/u@v?' || page_id FROM pages UNION ALL SELECT page_id, 'https://bit.ly/' || page_id FROM pages), h AS (SELECT *, {HOST.format("url")} AS n FROM a),
s AS (SELECT *, regexp_replace(string_split(n, ':')[1], '\.[^.]*$', '') AS stem, regexp_extract(n, ':(\d+)$', 1) AS port FROM h),
r AS (SELECT page_id, url, list_filter([CASE WHEN regexp_matches(n, '^\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') THEN 'ip address' END, CASE WHEN regexp_matches(n, '{SHORT}') THEN 'shortener' END, CASE WHEN contains(string_split(url, '?')[1], '@') THEN 'at sign' END, CASE WHEN length(n) - length(replace(n, '.', '')) > 4 THEN 'deep subdomain' END,
  CASE WHEN length(stem) > 0 AND length(regexp_replace(stem, '[^0-9]', '', 'g')) > length(stem) * 0.5 THEN 'mostly digits' END, CASE WHEN length(n) > 50 THEN 'long host' END, CASE WHEN port <> '' AND port NOT IN ('80', '443') THEN 'odd port' END], lambda x: x IS NOT NULL) AS r FROM s) SELECT page_id, url, array_to_string(r, ', ') AS reasons FROM r WHERE len(r) > 0""")
def suspicious_urls(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    each = F.array("url", F.concat(F.lit("http://10.0.0."), i, F.lit("/x")), F.concat(F.lit("http://a.b.c.d.e.example.com:8080/u@v?"), i), F.concat(F.lit("https://bit.ly/"), i))
    return pages(spark, sf).select("page_id", F.explode(each).alias("url")).withColumn("r", L.suspicious(F.col("url"))).where(F.size("r") > 0).select("page_id", "url", F.array_join("r", ", ").alias("reasons"))


def _any(of: str, phrases: tuple[str, ...], points: int) -> str:
    return f"CASE WHEN regexp_matches({of}, '{'|'.join(phrases).replace(chr(39), chr(39) * 2)}') THEN {points} ELSE 0 END"


@query("r12_soft_404", rf"WITH l AS (SELECT page_id, lower(html) AS h FROM pages UNION ALL SELECT page_id, '<title>404</title><h1>not found</h1>' || page_id FROM pages) SELECT signals, signals >= 3 AS error_page, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, (CASE WHEN length(trim(regexp_replace(h, '(?s)<[^>]+>', '', 'g'))) < 500 THEN 1 ELSE 0 END + {_any('regexp_extract(h, ' + chr(39) + '(?s)<title[^>]*>([^<]+)</title>' + chr(39) + ', 1)', L.TITLE_ERRORS, 3)} + {_any('substr(h, 1, 2000)', L.STRONG_ERRORS, 2)} + {_any('substr(h, 1, 2000)', L.WEAK_ERRORS, 1)} + CASE WHEN regexp_matches(h, '<h[1-3][^>]*>[^<]*(?:404|not found|page missing)[^<]*</h[1-3]>') THEN 2 ELSE 0 END)::INTEGER AS signals FROM l) GROUP BY ALL")
def soft_404(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf).select("page_id", "html")
    bad = p.select("page_id", F.concat(F.lit("<title>404</title><h1>not found</h1>"), F.col("page_id").cast("string")).alias("html"))
    signals = L.soft_404(F.col("html"))
    return p.unionByName(bad).groupBy(signals.alias("signals"), (signals >= L.SOFT_404).alias("error_page")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


RULES = [(1, "suffix", ".html"), (2, "contains", "utm_"), (3, "prefix", "http://m."), (4, "regex", r"/de/[0-9]+$"), (5, "contains", "blog.")]


@query("j9_apply_exclusions", r"WITH e AS (SELECT page_id, CASE WHEN lower(url) LIKE '%.html' THEN 1 WHEN contains(lower(url), 'utm_') THEN 2 WHEN lower(url) LIKE 'http://m.%' THEN 3 WHEN regexp_matches(url, '(?i)/de/[0-9]+$') THEN 4 WHEN contains(lower(url), 'blog.') THEN 5 END AS rule FROM pages) SELECT rule, count(*) AS hits, min(page_id) AS first_page FROM e GROUP BY 1")
def apply_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy(L.excluded_by(F.col("url"), RULES).alias("rule")).agg(F.count("*").alias("hits"), F.min("page_id").alias("first_page"))


@query("u3_dedupe_urls", f"WITH {HREFS} SELECT url, count(*) AS times, min(page_id) AS first_page FROM hrefs GROUP BY 1")
def dedupe_urls(spark: SparkSession, sf: str) -> DataFrame:
    return L.dedupe_urls(hrefs(spark, sf))


@query("f6_domain_category", rf"WITH h AS (SELECT {HOST.format('url')} AS h FROM pages) SELECT h AS domain, CASE WHEN regexp_matches(h, '\.gov|\.mil') THEN 'government' WHEN regexp_matches(h, '\.edu') THEN 'educational' WHEN regexp_matches(h, '\.com|\.co|\.biz|\.io|\.tech|\.net') THEN 'commercial' WHEN regexp_matches(h, '\.org') THEN 'organization' WHEN regexp_matches(h, 'sharepoint|intranet|internal|localhost') THEN 'internal' ELSE 'other' END AS category, count(*) AS pages FROM h GROUP BY ALL")
def domain_category(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy(L.host(F.col("url")).alias("domain"), L.domain_category(F.col("url")).alias("category")).agg(F.count("*").alias("pages"))


@query("a58_link_summary", f"WITH r AS (SELECT {HOST.format('url')} AS domain, {MADE} AS status, (page_id * 37 % 900)::DOUBLE AS ms FROM pages) SELECT status, domain, count(*) AS links, min(ms) FILTER (ms > 0) AS fastest, max(ms) AS slowest, count(*) FILTER (status IN ('WORKING', 'REDIRECT')) / count(*)::DOUBLE * 100 AS success_pct FROM r GROUP BY GROUPING SETS ((status), (domain), ())")
def link_summary(spark: SparkSession, sf: str) -> DataFrame:
    five = F.col("page_id") % 5
    status = F.when(five == 0, "BROKEN").when(five == 1, "REDIRECT").when(five == 2, "TIMEOUT").otherwise("WORKING")
    return L.link_summary(pages(spark, sf).select("url", status.alias("status"), (F.col("page_id") * 37 % 900).cast("double").alias("response_ms")))


@query("s5_stale_files", "SELECT 'lib' || (page_id % 3) AS library, CASE WHEN page_id % 4 = 0 THEN 'new' WHEN page_id % 4 = 1 THEN 'changed' ELSE 'current' END AS state, count(*) AS files FROM pages GROUP BY ALL")
def stale_files(spark: SparkSession, sf: str) -> DataFrame:
    filename = F.concat_ws("#", "url", F.col("page_id").cast("string"))  # pages may share a url, files no name
    listing = pages(spark, sf).select(F.concat(F.lit("lib"), (F.col("page_id") % 3).cast("string")).alias("library"), filename.alias("filename"), F.col("page_id").alias("modified"), F.length("html").alias("size"), "page_id")
    manifest = listing.where("page_id % 4 <> 0").withColumn("size", F.when(F.col("page_id") % 4 == 1, F.col("size") + 1).otherwise(F.col("size")))
    return L.stale_files(manifest, listing).groupBy("library", "state").agg(F.count("*").alias("files"))


@query("s6_library_status", "SELECT 'lib' || (page_id % 3) AS library, count(*) AS files, sum(length(html))::BIGINT AS bytes, count(*) FILTER (page_id % 2 = 0) AS scanned, max(page_id) AS last_sync FROM pages GROUP BY 1")
def library_status(spark: SparkSession, sf: str) -> DataFrame:
    m = pages(spark, sf).select(F.concat(F.lit("lib"), (F.col("page_id") % 3).cast("string")).alias("library"), F.length("html").cast("long").alias("size"), (F.col("page_id") % 2 == 0).alias("scanned"), F.col("page_id").alias("modified"))
    return L.library_status(m)
