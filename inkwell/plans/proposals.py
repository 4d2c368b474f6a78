"""Queries that compare proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import amount_bucket, count_bucket, normalized_description
from inkwell.operators import proposals as P
from inkwell.registry import query, table

ITEMS = "items AS (SELECT proposal_id, item_id, string_split(p_type, ' ')[1] AS category, amount, quantity, amount / nullif(quantity, 0) AS unit_price FROM (SELECT l_suppkey AS proposal_id, l_partkey AS item_id, round(sum(l_extendedprice), 2) AS amount, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = item_id)"
TOTALS = "totals AS (SELECT proposal_id, round(sum(amount), 2) AS total, count(*) AS items FROM items GROUP BY 1)"


def items(spark: SparkSession, sf: str) -> DataFrame:
    return P.items_from_lineitem(table(spark, sf, "lineitem"), table(spark, sf, "part"))


@query("a61_complete_items", f"WITH {ITEMS}, h AS (SELECT proposal_id, item_id, CASE WHEN item_id % 3 <> 0 THEN quantity END AS q, CASE WHEN item_id % 3 <> 1 THEN unit_price END AS u, CASE WHEN item_id % 3 <> 2 THEN amount END AS a FROM items) SELECT proposal_id, item_id, coalesce(q, floor(a / nullif(u, 0) * 100 + 0.500001::DOUBLE) / 100) AS quantity, coalesce(u, floor(a / nullif(q, 0) * 100 + 0.500001::DOUBLE) / 100) AS unit_price, coalesce(a, floor(q * u * 100 + 0.500001::DOUBLE) / 100) AS amount FROM h")
def complete_items(spark: SparkSession, sf: str) -> DataFrame:
    third = F.col("item_id") % 3
    h = items(spark, sf).select("proposal_id", "item_id", F.when(third != 0, F.col("quantity")).alias("quantity"), F.when(third != 1, F.col("unit_price")).alias("unit_price"), F.when(third != 2, F.col("amount")).alias("amount"))
    return P.complete_items(h)


@query("a62_item_comparison", f"WITH {ITEMS} SELECT item_id, min(amount) AS lowest, max(amount) AS highest, sum(round(amount * 100)::BIGINT)::BIGINT / (100.0::DOUBLE * count(*)) AS mean, count(*) AS vendors, CASE WHEN count(*) >= 2 THEN (max(amount) - min(amount)) / min(amount) * 100 END AS variance_pct, arg_min(proposal_id, (amount, proposal_id)) AS lowest_bidder FROM items WHERE amount > 0 GROUP BY 1")
def item_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return P.item_comparison(items(spark, sf))


@query("a63_category_totals", f"WITH {ITEMS}, t AS (SELECT proposal_id, category, round(sum(amount), 2) AS total FROM items GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT proposal_id FROM items), (SELECT DISTINCT category FROM items)), f AS (SELECT proposal_id, category, coalesce(total, 0.0) AS total FROM g LEFT JOIN t USING (proposal_id, category)) SELECT *, round(CASE WHEN sum(total) OVER o = 0 THEN 0.0 ELSE total / sum(total) OVER o * 100 END, 6) AS share FROM f WINDOW o AS (PARTITION BY proposal_id)")
def category_totals(spark: SparkSession, sf: str) -> DataFrame:
    return P.category_totals(items(spark, sf))


@query("a64_proposal_totals", f"WITH {ITEMS}, {TOTALS} SELECT * FROM totals")
def proposal_totals(spark: SparkSession, sf: str) -> DataFrame:
    return P.proposal_totals(items(spark, sf))


@query("a64_total_spread", f"WITH {ITEMS}, {TOTALS} SELECT min(total) AS lowest, arg_min(proposal_id, (total, proposal_id)) AS lowest_vendor, max(total) AS highest, arg_max(proposal_id, (total, -proposal_id)) AS highest_vendor, (max(total) - min(total)) / min(total) * 100 AS spread_pct FROM totals")
def total_spread(spark: SparkSession, sf: str) -> DataFrame:
    return P.total_spread(items(spark, sf))


#: Offers as the flags need them: some prices missing, some fees, shared companies, and stated totals that may be missing.
OFFERS = f"""{ITEMS}, offers AS (SELECT proposal_id, item_id, CASE WHEN item_id % 17 = 0 AND proposal_id % 4 = 0 THEN 'Fee' ELSE category END AS category, CASE WHEN (item_id + proposal_id) % 11 <> 0 THEN round(amount / (CASE WHEN (item_id * proposal_id) % 29 = 0 THEN 9 ELSE 1 END), 2) END AS amount, 0.5 + (item_id % 6) / 10.0 AS confidence FROM items),
vendors AS (SELECT s_suppkey AS proposal_id, CASE WHEN s_suppkey % 13 <> 0 THEN 'Company ' || (s_suppkey % 3 + s_suppkey // 4 * 4) END AS company, CASE WHEN s_suppkey % 10 <> 0 THEN t END AS total FROM supplier LEFT JOIN (SELECT proposal_id, round(sum(amount), 2) AS t FROM offers GROUP BY 1) ON proposal_id = s_suppkey)"""


def offers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    i, v, part = F.col("item_id"), F.col("proposal_id"), items(spark, sf)
    cheap = F.when((i * v) % 29 == 0, 9).otherwise(1)
    made = part.select("proposal_id", "item_id", F.when((i % 17 == 0) & (v % 4 == 0), "Fee").otherwise(F.col("category")).alias("category"), F.when((i + v) % 11 != 0, F.round(F.col("amount") / cheap, 2)).alias("amount"), (0.5 + (i % 6) / 10.0).alias("confidence"))
    total = made.groupBy("proposal_id").agg(F.round(F.sum("amount"), 2).alias("t"))
    s = F.col("s_suppkey")
    company = F.when(s % 13 != 0, F.concat(F.lit("Company "), (s % 3 + F.floor(s / 4) * 4).cast("string")))
    vendors = table(spark, sf, "supplier").join(total, F.col("proposal_id") == s, "left").select(s.alias("proposal_id"), company.alias("company"), F.when(s % 10 != 0, F.col("t")).alias("total"))
    return made, vendors


FLAGS = f"""{OFFERS}, p AS (SELECT o.*, nullif(lower(trim(company)), '') AS firm FROM offers o LEFT JOIN vendors USING (proposal_id)),
pr AS (SELECT * FROM p WHERE amount > 0),
st AS (SELECT item_id, count(*) AS n, min(amount) AS low, max(amount) AS high, stddev_samp(amount) AS sd, sum(amount) / count(*) AS mean FROM pr GROUP BY 1),
un AS (SELECT a.proposal_id, a.item_id FROM pr a JOIN pr b ON a.item_id = b.item_id AND a.proposal_id <> b.proposal_id GROUP BY ALL HAVING min(a.amount) < round(avg(b.amount), 6) * 0.5),
pairs AS (SELECT a.proposal_id AS x, b.proposal_id AS y FROM pr a JOIN pr b ON a.item_id = b.item_id AND a.proposal_id <> b.proposal_id GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (abs(a.amount - b.amount) < 0.001) / count(*)::DOUBLE > 0.6),
firms AS (SELECT nullif(lower(trim(company)), '') AS firm, count(*) AS offers FROM vendors GROUP BY 1),
pricers AS (SELECT item_id, list(DISTINCT coalesce(firm, '')) AS f FROM p WHERE amount IS NOT NULL GROUP BY 1),
terms AS (SELECT v.proposal_id, count(*) AS n FROM vendors v JOIN firms ON firm = lower(trim(v.company)) AND firms.offers > 1 JOIN pricers ON f = [firm] ANTI JOIN p ON p.proposal_id = v.proposal_id AND p.item_id = pricers.item_id AND p.amount IS NOT NULL GROUP BY 1),
ev AS (SELECT v.proposal_id, coalesce(total, 0) AS total, count(p.item_id) AS items, count(amount) AS priced, count(*) FILTER (amount >= 1000 AND amount % 1000 = 0) AS rnd, coalesce(sum(amount) FILTER (category IN ('Fee', 'Overhead')), 0) AS fees,
  count(DISTINCT category) FILTER (amount IS NOT NULL) AS cats, (SELECT count(DISTINCT item_id) FROM offers) AS all_items, (SELECT count(DISTINCT category) FROM offers) AS all_cats, coalesce(any_value(terms.n), 0) AS terms
  FROM vendors v LEFT JOIN p USING (proposal_id) LEFT JOIN terms ON terms.proposal_id = v.proposal_id GROUP BY v.proposal_id, total),
flags AS (SELECT proposal_id, 'unbalanced_pricing' AS type, 'critical' AS severity, count(*) AS flags, count(*)::DOUBLE AS value FROM un GROUP BY 1
  UNION ALL SELECT proposal_id, 'round_numbers', 'warning', 1, rnd FROM ev WHERE rnd * 2 > items
  UNION ALL SELECT proposal_id, 'missing_items', CASE WHEN all_items - priced - terms > all_items * 0.3 THEN 'critical' ELSE 'warning' END, 1, all_items - priced - terms FROM ev WHERE all_items - priced - terms > 0
  UNION ALL SELECT proposal_id, 'term_specific_items', 'info', 1, terms FROM ev WHERE all_items - priced - terms <= 0 AND terms > 0
  UNION ALL SELECT proposal_id, 'high_fee', 'warning', 1, round(fees / total * 100, 6) FROM ev WHERE total > 0 AND round(fees / nullif(total, 0) * 100, 6) > 20
  UNION ALL SELECT proposal_id, 'extreme_variance', 'warning', count(*), count(*) FROM pr JOIN st USING (item_id) WHERE n > 1 AND round((high - low) / low * 100, 6) > 100 AND amount = high GROUP BY 1
  UNION ALL SELECT proposal_id, 'sparse_data', 'info', 1, items FROM ev WHERE items < 3
  UNION ALL SELECT proposal_id, 'no_total', 'warning', 1, total FROM ev WHERE total = 0
  UNION ALL SELECT x, 'identical_pricing', 'warning', count(*), count(*) FROM pairs GROUP BY 1
  UNION ALL SELECT proposal_id, 'missing_categories', CASE WHEN all_cats - cats >= 2 THEN 'warning' ELSE 'info' END, 1, all_cats - cats FROM ev WHERE all_cats > cats AND cats > 0 AND all_cats >= 2
  UNION ALL SELECT proposal_id, 'price_reasonableness', 'warning', count(*), count(*) FROM pr JOIN st USING (item_id) WHERE n >= 3 AND sd > 0 AND abs(round((amount - mean) / nullif(sd, 0), 6)) > 2 GROUP BY 1)"""


@query("a65_red_flags", f"WITH {FLAGS} SELECT * FROM flags")
def red_flags(spark: SparkSession, sf: str) -> DataFrame:
    return P.red_flags(*offers(spark, sf))


@query("a65_identical_pricing", f"WITH {ITEMS}, r AS (SELECT proposal_id, item_id, round(amount, -4) AS amount FROM items WHERE round(amount, -4) > 0) SELECT a.proposal_id AS a, b.proposal_id AS b, count(*) FILTER (a.amount = b.amount) AS alike, count(*) AS common FROM r a JOIN r b ON a.item_id = b.item_id AND a.proposal_id < b.proposal_id GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (a.amount = b.amount) / count(*)::DOUBLE > 0.6")
def identical_pricing(spark: SparkSession, sf: str) -> DataFrame:
    return P.identical_pricing(items(spark, sf).withColumn("amount", F.round("amount", -4)))


@query("a66_heatmap", f"WITH {ITEMS}, d AS (SELECT item_id, proposal_id, count(*) OVER o AS n, round((amount - avg(amount) OVER o) / avg(amount) OVER o * 100, 6) AS dev FROM items WHERE amount > 0 WINDOW o AS (PARTITION BY item_id)) SELECT item_id, proposal_id, CASE WHEN n > 1 THEN dev END AS deviation_pct, CASE WHEN n = 1 THEN 'single_vendor' WHEN abs(dev) < 5 THEN 'neutral' WHEN dev < -15 THEN 'very_low' WHEN dev < -5 THEN 'low' WHEN dev > 15 THEN 'very_high' ELSE 'high' END AS level FROM d")
def heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return P.heatmap(items(spark, sf))


@query("a67_rate_analysis", f"WITH {ITEMS} SELECT item_id, min(unit_price) AS lowest, max(unit_price) AS highest, round(avg(unit_price), 6) AS mean, count(*) AS vendors, round((max(unit_price) - min(unit_price)) / min(unit_price) * 100, 6) AS spread_pct FROM items WHERE unit_price > 0 GROUP BY 1")
def rate_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return P.rate_analysis(items(spark, sf))


@query("a69_vendor_scores", f"""WITH {FLAGS}, risk AS (SELECT proposal_id, sum(flags * CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS points FROM flags GROUP BY 1),
b AS (SELECT min(total) AS low, max(total) AS high FROM vendors WHERE total > 0), own AS (SELECT proposal_id, count(amount) AS priced, round(avg(confidence), 9)::DOUBLE AS sure FROM offers GROUP BY 1),
s AS (SELECT v.proposal_id, CASE WHEN total > 0 THEN round_even(100 - (total - low) / (high - low) * 80, 0) ELSE 50.0 END::DOUBLE AS price, round_even(coalesce(priced, 0) / (SELECT count(DISTINCT item_id) FROM offers)::DOUBLE * 100, 0) AS completeness, greatest(0, 100 - coalesce(points, 0) * 12)::DOUBLE AS risk,
  round_even(round(coalesce(sure, 1) * 60 + CASE WHEN total > 0 THEN 25 ELSE 0 END + CASE WHEN company IS NULL THEN 0 ELSE 15 END, 6), 0) AS quality FROM vendors v CROSS JOIN b LEFT JOIN own ON own.proposal_id = v.proposal_id LEFT JOIN risk r ON r.proposal_id = v.proposal_id),
o AS (SELECT *, round_even(round(price * 0.40::DOUBLE + completeness * 0.25::DOUBLE + risk * 0.25::DOUBLE + quality * 0.10::DOUBLE, 6), 0) AS overall FROM s)
SELECT *, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END AS grade FROM o""")
def vendor_scores(spark: SparkSession, sf: str) -> DataFrame:
    return P.vendor_scores(*offers(spark, sf))


@query("a71_proposal_metrics", f"WITH {ITEMS} SELECT count(DISTINCT proposal_id) AS vendors, count(DISTINCT item_id) AS items, min(amount) AS lowest, max(amount) AS highest, sum(round(amount * 100)::BIGINT)::BIGINT / (100.0::DOUBLE * count(*)) AS mean, round(sum(amount), 2) AS total FROM items")
def proposal_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return P.proposal_metrics(items(spark, sf))


@query("a77_executive_summary", f"WITH {ITEMS}, c AS (SELECT item_id, min(amount) AS lowest, sum(round(amount * 100)::BIGINT)::BIGINT / (100.0::DOUBLE * count(*)) AS mean, count(*) AS vendors, arg_min(proposal_id, (amount, proposal_id)) AS lowest_bidder FROM items WHERE amount > 0 GROUP BY 1 HAVING count(*) >= 2) SELECT item_id, round((mean - lowest) * vendors, 4) AS saving, lowest_bidder, vendors FROM c ORDER BY 2 DESC, 1 LIMIT 10")
def executive_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.executive_summary(items(spark, sf))


@query("f2_normalized_description", r"SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(trim(lower(p_name || ' of the ' || p_type || ' #' || p_size)), '\b(the|a|an|of|for|and|or|in|to|with|per)\b', ' ', 'g'), '\s+', ' ', 'g')), '\s*#?\d+\s*$', '') AS description FROM part")
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" #"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", normalized_description(name).alias("description"))


@query("f8_buckets", "SELECT CASE WHEN o_totalprice = 0 THEN '$0' WHEN abs(o_totalprice) < 100 THEN '$1-$99' WHEN abs(o_totalprice) < 1000 THEN '$100-$999' WHEN abs(o_totalprice) < 10000 THEN '$1K-$9.9K' WHEN abs(o_totalprice) < 100000 THEN '$10K-$99K' WHEN abs(o_totalprice) < 1000000 THEN '$100K-$999K' WHEN abs(o_totalprice) < 10000000 THEN '$1M-$9.9M' WHEN abs(o_totalprice) < 100000000 THEN '$10M-$99M' ELSE '$100M+' END AS amount, CASE WHEN o_custkey = 0 THEN '0' WHEN o_custkey < 10 THEN '1-9' WHEN o_custkey < 100 THEN '10-99' WHEN o_custkey < 1000 THEN '100-999' ELSE '1000+' END AS customer, count(*) AS orders FROM orders GROUP BY ALL")
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(amount_bucket(F.col("o_totalprice")).alias("amount"), count_bucket(F.col("o_custkey")).alias("customer")).agg(F.count("*").alias("orders"))
