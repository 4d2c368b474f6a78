"""Links: extraction, classes, format rules, suspicion, exclusions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hosts that shorten links (fixed values).
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "j.mp", "tiny.cc", "rb.gy")
#: Parts of host names by category, in the order they are tried (fixed values).
DOMAIN_CATEGORIES = (("government", (".gov", ".mil")), ("educational", (".edu",)), ("commercial", (".com", ".co", ".biz", ".io", ".tech", ".net")), ("organization", (".org",)), ("internal", ("sharepoint", "intranet", "internal", "localhost")))
#: Phrases of error pages: in titles, and early in the text as strong and weak signals (fixed values).
TITLE_ERRORS = ("not found", "404", "page missing", "page unavailable", "page does not exist")
STRONG_ERRORS = ("page not found", "page you requested could not be found", "this page doesn't exist", "this page does not exist", "the requested url was not found", "oops! page not found", "404 error", "error 404")
WEAK_ERRORS = ("we couldn't find", "we could not find", "no longer available", "has been removed", "has been deleted", "content is unavailable", "content not available", "sorry, we can't find")
#: A page with so many signals counts as an error page.
SOFT_404 = 3


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def domain_category(url: Column) -> Column:
    """The first category one of whose parts the host contains; 'other' if none does."""
    name, out = host(url), None
    for category, parts in DOMAIN_CATEGORIES:
        holds = F.regexp_like(name, F.lit("|".join(p.replace(".", r"\.") for p in parts)))
        out = F.when(holds, category) if out is None else out.when(holds, category)
    return out.otherwise("other")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, headings, hrefs, text): an HTML page's title, h1 to h6 texts, link targets and visible text."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return pages.select("page_id", F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)).alias("title"), F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1)).alias("headings"), F.regexp_extract_all(html, F.lit(r"""(?i)href="([^"]*)\""""), F.lit(1)).alias("hrefs"), text.alias("text"))


def parse_url_list(lists: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, url, pos): urls cut at newlines, commas and semicolons, without comments; https:// is added; the first of equals stays."""
    item = F.trim(F.col("item"))
    cut = lists.select(id_col, F.posexplode(F.split(text_col, r"[\n,;]")).alias("pos", "item")).where((item != "") & ~F.startswith(item, F.lit("#")))
    full = F.when(F.regexp_like(item, F.lit("^(http|https|ftp)://")), item).when(F.contains(item, F.lit(".")) & ~F.startswith(item, F.lit(".")), F.concat(F.lit("https://"), item))
    return cut.select(id_col, "pos", full.alias("url")).where("url is not null").groupBy(id_col, "url").agg(F.min("pos").alias("pos"))


def classify_link(target: Column) -> Column:
    t = F.trim(target)
    return (
        F.when(t.isNull() | (t == ""), "empty")
        .when(F.startswith(t, F.lit("#")), "bookmark")
        .when(F.regexp_like(t, F.lit(r"^(\\\\|//)[^/\\]")), "network_path")
        .when(F.regexp_like(t, F.lit(r"^([A-Za-z]:[\\/]|file:|/|\.{1,2}/)")), "file_path")
        .when(F.regexp_like(t, F.lit("(?i)^mailto:")), "mailto")
        .when(F.regexp_like(t, F.lit("(?i)^(https?|ftp)://")), "web")
        .otherwise("unknown")
    )


def format_issues(url: Column) -> Column:
    """What is wrong with a link's form, in order."""
    name = host(url)
    one = lambda holds, what: F.when(holds, F.lit(what))
    checks = F.array(one(~F.regexp_like(url, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*://")), "no scheme"), one(name == "", "no host"), one(F.contains(name, F.lit("..")), "double dot"), one(F.regexp_like(url, F.lit(r"\s")), "space"), one(F.contains(url, F.lit(":///")), "triple slash"), one(F.regexp_like(name, F.lit(r"\.(con|cmo|ocm|ogr|nte)$")), "misspelt top-level domain"), one((name != "") & ~F.contains(name, F.lit(".")), "no dot in host"))
    return F.filter(checks, lambda x: x.isNotNull())


def suspicious(url: Column) -> Column:
    """Why a URL looks suspicious, in order; empty if nothing does."""
    name = host(url)
    head = F.substring_index(name, ":", 1)
    stem = F.regexp_replace(head, r"\.[^.]*$", "")
    digits = F.length(F.regexp_replace(stem, "[^0-9]", ""))
    port = F.regexp_extract(name, r":(\d+)$", 1)
    one = lambda holds, what: F.when(holds, F.lit(what))
    checks = F.array(one(F.regexp_like(name, F.lit(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")), "ip address"), one(F.regexp_like(name, F.lit("|".join(s.replace(".", r"\.") for s in SHORTENERS))), "shortener"), one(F.contains(F.substring_index(url, "?", 1), F.lit("@")), "at sign"), one(F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) > 4, "deep subdomain"), one((F.length(stem) > 0) & (digits > F.length(stem) * 0.5), "mostly digits"), one(F.length(name) > 50, "long host"), one((port != "") & ~port.isin("80", "443"), "odd port"))
    return F.filter(checks, lambda x: x.isNotNull())


def soft_404(html: Column) -> Column:
    """Signals that a page is an error page though it was served as found: a short body, its title, phrases, headings.

    SOFT_404 of them make it one.
    """
    low = F.lower(F.coalesce(html, F.lit("")))
    early = F.substring(low, 1, 2000)
    title = F.regexp_extract(low, r"(?s)<title[^>]*>([^<]+)</title>", 1)
    has = lambda text, phrases: F.when(F.regexp_like(text, F.lit("|".join(phrases))), 1).otherwise(0)
    short = F.when(F.length(F.trim(F.regexp_replace(low, r"(?s)<[^>]+>", ""))) < 500, 1).otherwise(0)
    heading = F.when(F.regexp_like(low, F.lit(r"<h[1-3][^>]*>[^<]*(?:404|not found|page missing)[^<]*</h[1-3]>")), 2).otherwise(0)
    return short + 3 * has(title, TITLE_ERRORS) + 2 * has(early, STRONG_ERRORS) + has(early, WEAK_ERRORS) + heading


def excluded_by(url: Column, rules: list[tuple[int, str, str]]) -> Column:
    """The number of the first exclusion rule (number, match type, pattern) that fits, or null. Rules are a bounded list."""
    low = F.trim(F.lower(url))
    bare = F.regexp_replace(F.regexp_replace(low, "/+$", ""), "^https?://", "")

    def fits(kind: str, pattern: str) -> Column:
        p = pattern.lower().strip()
        if kind == "exact":
            return bare == p.rstrip("/").removeprefix("https://").removeprefix("http://")
        return {"prefix": F.startswith(low, F.lit(p)), "suffix": F.endswith(low, F.lit(p)), "contains": F.contains(low, F.lit(p)), "regex": F.regexp_like(url, F.lit("(?i)" + pattern))}[kind]

    return F.coalesce(*[F.when(fits(kind, pattern), F.lit(n)) for n, kind, pattern in sorted(rules)])


def link_summary(results: DataFrame) -> DataFrame:
    """Counts by status, by domain, and of all, in one pass; nulls stand for all. results: (url, status, response_ms)."""
    named = results.withColumn("domain", host(F.col("url")))
    agg = [F.count("*").alias("links"), F.min(F.when(F.col("response_ms") > 0, F.col("response_ms"))).alias("fastest"), F.max("response_ms").alias("slowest"), (F.count_if(F.col("status").isin("WORKING", "REDIRECT")) / F.count("*") * 100).alias("success_pct")]
    return named.groupingSets([["status"], ["domain"], []], "status", "domain").agg(*agg)


def dedupe_urls(links: DataFrame) -> DataFrame:
    """Each distinct URL once with how often it occurs and where first: the list that is worth checking."""
    return links.groupBy("url").agg(F.count("*").alias("times"), F.min("page_id").alias("first_page"))


def stale_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """(library, filename, state) of listed files: new, changed (newer, or of another size), or current.

    A row a listed file: of several entries of the manifest for one file the latest counts.
    """
    latest = F.max_by(F.struct("modified", "size"), F.struct("modified", "size"))
    m = manifest.groupBy("library", "filename").agg(latest.alias("m")).select("library", "filename", F.col("m.modified").alias("known"), F.col("m.size").alias("known_size"))
    state = F.when(F.col("known").isNull(), "new").when((F.col("modified") > F.col("known")) | (F.col("size") != F.col("known_size")), "changed").otherwise("current")
    return listing.join(m, ["library", "filename"], "left").select("library", "filename", state.alias("state"))


def library_status(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("library").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("scanned")).alias("scanned"), F.max("modified").alias("last_sync"))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")
