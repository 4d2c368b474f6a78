"""URL filters: rules first, then trust and distrust that spread over the link graph of hosts.

Pages and linked addresses that an allow rule lets through make their hosts trusted seeds, those under a block rule make
them blocked seeds, in proportion to their number; both start vectors sum to 1. Trust is a personalised PageRank from
the trusted seeds along links (who is linked by the trusted is trusted a little); distrust is one from the blocked seeds
against the links (who links to the blocked is distrusted). The mass of hosts without links onward returns to the seeds,
so either score sums to 1 as long as there are seeds, and both are comparable. A host is blocked where its share of
distrust in both passes a threshold.

Both spread in one table and one join an iteration, over arcs that are first summed up by (from, to), so a host with
most pages is one row; hosts with very many links or pages are joined by broadcast. Iterations go on until the scores
change by less than `tolerance` in sum; every iteration's scores are checkpointed.

Defined results: a null url or one without "://" has empty host and path, and the method allows it unless it has a
seed; null html has no links; repeated pages count as repeated links and each get a row; of rules that fit, the longest
wins, and of equally long ones that with the longer host; a very long url or html is read whole; other columns of any
name are ignored; with no pages there are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.graph import with_hubs

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-3, 0.5
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str  # with its leading slash

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(text, verdict) of the longest rule that fits, or null. Rules are a bounded parameter: one expression, no join."""
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host)))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judged_by_rules(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> DataFrame:
    """The given columns with host, path and the rule that fits (struct, or null)."""
    named = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    return named.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))


def linked(judged: DataFrame, rules: tuple[Rule, ...], html_col: str = "html") -> DataFrame:
    """(source, target, trusted, blocked, n) of links to other hosts: how many there are, and how many a rule allows or blocks."""
    found = judged.select(F.col("host").alias("source"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("address"))
    whole = F.when(F.startswith("address", F.lit("//")), F.concat(F.lit("http:"), "address")).otherwise(F.col("address"))
    named = found.select("source", host_of(whole).alias("target"), path_of(whole).alias("path")).where("source <> target and source <> '' and target <> ''")
    verdict = rule_of(F.col("target"), F.col("path"), rules)["verdict"]
    return named.withColumn("verdict", verdict).groupBy("source", "target").agg(F.count_if(F.col("verdict") == "allow").alias("trusted"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count("*").alias("n"))


def seeds(judged: DataFrame, links: DataFrame) -> DataFrame:
    """(host, pages, trusted, blocked) of every host that has pages or is linked to; trusted and blocked sum to 1 each, or 0."""
    own = judged.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("fit.verdict") == "allow").alias("trusted"), F.count_if(F.col("fit.verdict") == "block").alias("blocked"))
    other = links.select(F.col("target").alias("host"), F.lit(0).alias("pages"), "trusted", "blocked")
    hosts = own.unionByName(other).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "trusted", "blocked")]).checkpoint()
    trusted, blocked = hosts.agg(F.coalesce(F.sum("trusted"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    return hosts.select("host", "pages", (F.col("trusted") / F.lit(float(max(1, trusted)))).alias("trusted"), (F.col("blocked") / F.lit(float(max(1, blocked)))).alias("blocked"))


def spread(starts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) at the fixed point; starts: (host, trusted, blocked) of every host, edges: (source, target, n)."""
    out = edges.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("many"))
    into = edges.groupBy("target").agg(F.sum("n").alias("total"), F.count("*").alias("many"))
    count = edges.count()
    along = with_hubs(edges, out, ["source"], "many", count).select(F.col("source").alias("host"), F.col("target").alias("to"), (F.col("n") / F.col("total")).alias("trust_part"), F.lit(0.0).alias("distrust_part"))
    against = with_hubs(edges, into, ["target"], "many", count).select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(0.0).alias("trust_part"), (F.col("n") / F.col("total")).alias("distrust_part"))
    arcs = along.unionByName(against).groupBy("host", "to").agg(F.sum("trust_part").alias("trust_part"), F.sum("distrust_part").alias("distrust_part")).checkpoint()
    onward = arcs.groupBy("host").agg(F.count("*").alias("arcs"), F.max("trust_part").alias("t"), F.max("distrust_part").alias("d"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0)) == 0
    base = starts.join(onward, "host", "left").select("host", "trusted", "blocked", F.coalesce("arcs", F.lit(0)).alias("arcs"), none("t").alias("trust_ends"), none("d").alias("distrust_ends")).checkpoint()
    scores = base.withColumns({"trust": F.col("trusted"), "distrust": F.col("blocked"), "change": F.lit(0.0)})
    turn = count > 0
    total = arcs.count()
    while turn:
        lost_trust, lost_distrust = scores.agg(F.sum(F.when(F.col("trust_ends"), F.col("trust")).otherwise(0.0)), F.sum(F.when(F.col("distrust_ends"), F.col("distrust")).otherwise(0.0))).first()
        given = with_hubs(arcs, scores.select("host", "trust", "distrust", "arcs"), ["host"], "arcs", total).groupBy(F.col("to").alias("host")).agg(F.sum(F.col("trust") * F.col("trust_part")).alias("t"), F.sum(F.col("distrust") * F.col("distrust_part")).alias("d"))
        trust = (1 - damping) * F.col("trusted") + damping * (F.coalesce("t", F.lit(0.0)) + lost_trust * F.col("trusted"))
        distrust = (1 - damping) * F.col("blocked") + damping * (F.coalesce("d", F.lit(0.0)) + lost_distrust * F.col("blocked"))
        moved = scores.drop("change").join(given, "host", "left").withColumns({"new_trust": trust, "new_distrust": distrust})
        change = F.abs(F.col("new_trust") - F.col("trust")) + F.abs(F.col("new_distrust") - F.col("distrust"))
        scores = moved.select(*base.columns, F.col("new_trust").alias("trust"), F.col("new_distrust").alias("distrust"), change.alias("change")).checkpoint()
        turn = scores.agg(F.sum("change")).first()[0] >= tolerance
    return scores.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    judged = judged_by_rules(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), rules)
    edges = linked(judged, rules).checkpoint()
    starts = seeds(judged, edges).checkpoint()
    scores = starts.select("host", "pages").join(spread(starts.drop("pages"), edges.select("source", "target", "n"), tolerance=tolerance), "host").where("pages > 0")
    blocked = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(blocked, "block").otherwise("allow"))
    total = starts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    return with_hubs(judged.select("page_id", "host", "path", "fit"), scores, ["host"], "pages", total).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
