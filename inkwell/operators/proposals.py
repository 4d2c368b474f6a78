"""Comparison of proposals: aligned items by vendor, totals, flags and scores.

Line items: (proposal_id, item_id, category, quantity, amount, confidence), one row a vendor and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import grade
from inkwell.sources.stored import stored

FLAG_POINTS = {"critical": 3, "warning": 2, "info": 1}


def items_from_lineitem(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Line items as vendors' offers for parts; one row for each (vendor, part)."""
    sums = lineitem.groupBy(F.col("l_suppkey").alias("proposal_id"), F.col("l_partkey").alias("item_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.sum("l_quantity").alias("quantity"))
    kind = part.select(F.col("p_partkey").alias("item_id"), F.split("p_type", " ")[0].alias("category"))
    return sums.join(kind, "item_id").withColumn("unit_price", F.col("amount") / F.nullif("quantity", F.lit(0)))


def cents(x: Column) -> Column:
    """To two decimals, halves up; a millionth of a cent is forgiven, so that 0.005 in binary is a half."""
    return F.floor(x * 100 + F.lit(0.500001)) / 100


def complete_items(items: DataFrame) -> DataFrame:
    """The missing one of quantity, unit price and amount from the other two, to two decimals."""
    q, u, a = F.col("quantity"), F.col("unit_price"), F.col("amount")
    return items.select(*[c for c in items.columns if c not in ("quantity", "unit_price", "amount")], F.coalesce(q, cents(a / F.nullif(u, F.lit(0)))).alias("quantity"), F.coalesce(u, cents(a / F.nullif(q, F.lit(0)))).alias("unit_price"), F.coalesce(a, cents(q * u)).alias("amount"))


def money(text: Column) -> Column:
    """A number from text with signs of currency and thousands; parentheses are negative."""
    bare = F.regexp_replace(text, r"[$€£,\s()]", "")
    number = bare.try_cast("decimal(18,2)")
    return F.when(F.regexp_like(text, F.lit(r"^\s*\(.*\)\s*$")), -number).otherwise(number)


def mean() -> Column:
    """The mean amount by whole cents, so that it does not depend on the order of rows."""
    return F.sum(F.round(F.col("amount") * 100).cast("long")) / (F.lit(100.0) * F.count("*"))


def item_comparison(items: DataFrame) -> DataFrame:
    """For each item over positive amounts: range, mean, spread in percent of the lowest (two vendors at least), lowest bidder."""
    per = items.where("amount > 0").groupBy("item_id").agg(F.min("amount").alias("lowest"), F.max("amount").alias("highest"), mean().alias("mean"), F.count("*").alias("vendors"), F.min(F.struct("amount", "proposal_id")).alias("best"))
    return per.select("item_id", "lowest", "highest", "mean", "vendors", F.when(F.col("vendors") >= 2, (F.col("highest") - F.col("lowest")) / F.col("lowest") * 100).alias("variance_pct"), F.col("best.proposal_id").alias("lowest_bidder"))


def category_totals(items: DataFrame) -> DataFrame:
    """(proposal_id, category, total, share): every vendor with every category, zeros kept, share of the vendor's total."""
    total = items.groupBy("proposal_id", "category").agg(F.round(F.sum("amount"), 2).alias("total"))
    grid = items.select("proposal_id").distinct().join(items.select("category").distinct())  # a row for each vendor and category is the result itself
    filled = grid.join(total, ["proposal_id", "category"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    whole = F.sum("total").over(Window.partitionBy("proposal_id"))
    return filled.withColumn("share", F.round(F.when(whole == 0, 0.0).otherwise(F.col("total") / whole * 100), 6))


def proposal_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("proposal_id").agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("items"))


def total_spread(items: DataFrame) -> DataFrame:
    """The lowest and highest total with their vendors, and the spread in percent."""
    t = proposal_totals(items).agg(F.min(F.struct("total", "proposal_id")).alias("l"), F.max(F.struct("total", F.negate("proposal_id").alias("n"))).alias("h"))
    return t.select(F.col("l.total").alias("lowest"), F.col("l.proposal_id").alias("lowest_vendor"), F.col("h.total").alias("highest"), F.negate("h.n").alias("highest_vendor"), ((F.col("h.total") - F.col("l.total")) / F.col("l.total") * 100).alias("spread_pct"))


def heatmap(items: DataFrame) -> DataFrame:
    """(item_id, proposal_id, deviation_pct, level) of positive amounts against the item's mean."""
    w = Window.partitionBy("item_id")
    d = items.where("amount > 0").withColumn("n", F.count("*").over(w)).withColumn("dev", (F.col("amount") - F.avg("amount").over(w)) / F.avg("amount").over(w) * 100)
    dev = F.round("dev", 6)
    level = F.when(F.col("n") == 1, "single_vendor").when(F.abs(dev) < 5, "neutral").when(dev < -15, "very_low").when(dev < -5, "low").when(dev > 15, "very_high").otherwise("high")
    return d.select("item_id", "proposal_id", F.when(F.col("n") > 1, dev).alias("deviation_pct"), level.alias("level"))


def rate_analysis(items: DataFrame) -> DataFrame:
    """Unit prices of each item: range, mean and spread in percent of the lowest."""
    per = items.where("unit_price > 0").groupBy("item_id").agg(F.min("unit_price").alias("lowest"), F.max("unit_price").alias("highest"), F.round(F.avg("unit_price"), 6).alias("mean"), F.count("*").alias("vendors"))
    return per.withColumn("spread_pct", F.round((F.col("highest") - F.col("lowest")) / F.col("lowest") * 100, 6))


def identical_pricing(items: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """Pairs of vendors that price most of their common items alike.

    Candidates come from equal (item, amount) keys: a pair must agree on more than its share of the fewest common items.
    The items in common are counted by meeting at each item, for vendors of candidates alone; what a vendor prices is
    never multiplied by the vendors it agrees with.
    """
    a = items.where("amount > 0").select("item_id", F.round("amount", 2).alias("amount"), F.col("proposal_id").alias("a"))
    b = a.select("item_id", "amount", F.col("a").alias("b"))
    alike = a.join(b, ["item_id", "amount"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("alike"))
    alike = stored(alike.where(F.col("alike") > share * least - 1e-9))
    sides = [df.select(c, "item_id").join(alike.select(c).distinct(), c, "left_semi") for df, c in ((a, "a"), (b, "b"))]
    met = sides[0].join(sides[1], "item_id").where("a < b").select("a", "b")
    common = met.join(alike, ["a", "b"]).groupBy("a", "b").agg(F.first("alike").alias("alike"), F.count("*").alias("common"))
    return common.where((F.col("common") >= least) & (F.col("alike") / F.col("common") > share))


def red_flags(items: DataFrame, vendors: DataFrame) -> DataFrame:
    """(proposal_id, type, severity, flags, value): what is suspicious about each vendor's offer, and how many flags it raises.

    items: (proposal_id, item_id, category, amount), one row a vendor and item, amounts may be null; vendors:
    (proposal_id, company, total) with the stated total. Detectors on items raise a flag for each of them, the others
    one a vendor, and equal pricing one for each other vendor. Vendors are compared through sums that leave their own
    amount out; an item that only one company prices is specific to that company's terms, not missing from them.
    """
    w = Window.partitionBy("item_id")
    firm = F.nullif(F.lower(F.trim("company")), F.lit(""))
    named = items.join(vendors.select("proposal_id", firm.alias("firm")), "proposal_id", "left")
    priced = F.col("amount").isNotNull()
    over = F.when(F.col("amount") > 0, F.col("amount"))
    one_firm = (F.min(F.when(priced, F.coalesce("firm", F.lit("")))).over(w) == F.max(F.when(priced, F.coalesce("firm", F.lit("")))).over(w)) & (F.max("firm").over(w) != "")
    pos = named.withColumns({"n": F.count(over).over(w), "sum": F.sum(over).over(w), "low": F.min(over).over(w), "high": F.max(over).over(w), "sd": F.stddev_samp(over).over(w), "specific": one_firm})
    others = F.round((F.col("sum") - F.col("amount")) / F.nullif(F.col("n") - 1, F.lit(0)), 6)
    z = F.round((F.col("amount") - F.col("sum") / F.nullif("n", F.lit(0))) / F.nullif("sd", F.lit(0.0)), 6)
    above = F.col("amount") > 0
    each = pos.groupBy("proposal_id").agg(
        F.count_if(above & (F.col("n") > 1) & (F.col("amount") < others * 0.5)).alias("unbalanced"),
        F.count_if(priced & (F.col("n") > 1) & (F.round((F.col("high") - F.col("low")) / F.col("low") * 100, 6) > 100) & (F.col("amount") == F.col("high"))).alias("extreme"),
        F.count_if(above & (F.col("n") >= 3) & (F.col("sd") > 0) & (F.abs(z) > 2)).alias("outliers"),
        F.count_if((F.col("amount") >= 1000) & (F.col("amount") % 1000 == 0)).alias("round"),
        F.count("*").alias("items"),
        F.count_if(priced).alias("priced"),
        F.count_if(priced & F.coalesce("specific", F.lit(False))).alias("own_specific"),
        F.countDistinct(F.when(priced, F.coalesce("category", F.lit("Uncategorized")))).alias("categories"),
        F.sum(F.when(F.col("category").isin("Fee", "Overhead"), F.col("amount")).otherwise(0.0)).alias("fees"),
    )
    specific = pos.where(F.col("specific") & priced & F.col("firm").isNotNull()).groupBy("firm").agg(F.countDistinct("item_id").alias("specific"))
    firms = vendors.select(firm.alias("firm")).where("firm is not null").groupBy("firm").agg(F.count("*").alias("offers"))
    alike = identical_pricing(items)
    same = alike.select(F.explode(F.array("a", "b")).alias("proposal_id")).groupBy("proposal_id").agg(F.count("*").alias("same"))
    size = items.agg(F.countDistinct("item_id").alias("all_items"), F.countDistinct(F.coalesce("category", F.lit("Uncategorized"))).alias("all_categories"))  # one row
    full = vendors.select("proposal_id", "total", firm.alias("firm")).join(each, "proposal_id", "left").join(firms.join(specific, "firm", "left"), "firm", "left").join(same, "proposal_id", "left").join(F.broadcast(size))
    full = full.fillna(0, [c for c in full.columns if c not in ("proposal_id", "total", "firm")])
    missing = F.col("all_items") - F.col("priced")
    specific_terms = F.when((F.col("offers") > 1) & (missing > 0), F.col("specific") - F.col("own_specific")).otherwise(0)
    lost = missing - specific_terms
    gone = F.col("all_categories") - F.col("categories")
    total = F.coalesce("total", F.lit(0.0))
    fee = F.round(F.col("fees") / F.nullif(total, F.lit(0.0)) * 100, 6)
    one = lambda kind, severity, n, value, holds: F.when(holds, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), n.cast("long").alias("flags"), value.cast("double").alias("value")))
    critical, warning, info, once = F.lit("critical"), F.lit("warning"), F.lit("info"), F.lit(1)
    flags = F.array(
        one("unbalanced_pricing", critical, F.col("unbalanced"), F.col("unbalanced"), F.col("unbalanced") > 0),
        one("round_numbers", warning, once, F.col("round"), F.col("round") * 2 > F.col("items")),
        one("missing_items", F.when(lost > F.col("all_items") * 0.3, critical).otherwise(warning), once, lost, lost > 0),
        one("term_specific_items", info, once, specific_terms, (lost <= 0) & (specific_terms > 0)),
        one("high_fee", warning, once, fee, (total > 0) & (fee > 20)),
        one("extreme_variance", warning, F.col("extreme"), F.col("extreme"), F.col("extreme") > 0),
        one("sparse_data", info, once, F.col("items"), F.col("items") < 3),
        one("no_total", warning, once, total, total == 0),
        one("identical_pricing", warning, F.col("same"), F.col("same"), F.col("same") > 0),
        one("missing_categories", F.when(gone >= 2, warning).otherwise(info), once, gone, (gone > 0) & (F.col("categories") > 0) & (F.col("all_categories") >= 2)),
        one("price_reasonableness", warning, F.col("outliers"), F.col("outliers"), F.col("outliers") > 0),
    )
    return full.select("proposal_id", F.inline(F.filter(flags, lambda f: f.isNotNull())))


def vendor_scores(items: DataFrame, vendors: DataFrame) -> DataFrame:
    """(proposal_id, price, completeness, risk, quality, overall, grade): 40, 25, 25 and 10 % of the overall score.

    Prices are compared by stated totals above 0 (a vendor without one gets 50); every flag takes 12 times its severity
    from the risk score; quality is made of the items' mean confidence and of stated total and company.
    """
    valid = F.when(F.col("total") > 0, F.col("total"))
    bounds = vendors.agg(F.min(valid).alias("low"), F.max(valid).alias("high"), F.count(valid).alias("many"))
    every = items.agg(F.countDistinct("item_id").alias("all_items"))
    points = F.create_map(*[F.lit(x) for p in FLAG_POINTS.items() for x in p])
    risk = red_flags(items, vendors).groupBy("proposal_id").agg(F.sum(points[F.col("severity")] * F.col("flags")).alias("points"))
    own = items.groupBy("proposal_id").agg(F.count("amount").alias("priced"), F.round(F.avg("confidence"), 9).alias("sure"))
    j = vendors.join(own, "proposal_id", "left").join(risk, "proposal_id", "left").join(F.broadcast(bounds)).join(F.broadcast(every))  # one row each
    price = F.when(valid.isNull(), 50.0).when(F.col("high") > F.col("low"), F.bround(100 - (F.col("total") - F.col("low")) / (F.col("high") - F.col("low")) * 80)).when(F.col("many") > 1, 100.0).otherwise(50.0)
    named = F.when(F.coalesce("company", F.lit("")) != "", 15).otherwise(0)
    quality = F.bround(F.round(F.coalesce("sure", F.lit(1.0)) * 60 + F.when(valid.isNotNull(), 25).otherwise(0) + named, 6))
    j = j.select("proposal_id", price.alias("price"), F.bround(F.coalesce("priced", F.lit(0)) / F.nullif("all_items", F.lit(0)) * 100).alias("completeness"), F.greatest(F.lit(0), 100 - F.coalesce("points", F.lit(0)) * 12).cast("double").alias("risk"), quality.alias("quality"))
    overall = F.bround(F.round(F.col("price") * 0.40 + F.col("completeness") * 0.25 + F.col("risk") * 0.25 + F.col("quality") * 0.10, 6))
    return j.withColumn("overall", overall).withColumn("grade", grade(F.col("overall")))


def proposal_metrics(items: DataFrame) -> DataFrame:
    return items.agg(F.countDistinct("proposal_id").alias("vendors"), F.countDistinct("item_id").alias("items"), F.min("amount").alias("lowest"), F.max("amount").alias("highest"), mean().alias("mean"), F.round(F.sum("amount"), 2).alias("total"))


def executive_summary(items: DataFrame, top: int = 10) -> DataFrame:
    """The items with the greatest saving between the mean and the lowest offer."""
    c = item_comparison(items).where("vendors >= 2").withColumn("saving", F.round((F.col("mean") - F.col("lowest")) * F.col("vendors"), 4))
    return c.orderBy(F.desc("saving"), "item_id").limit(top).select("item_id", "saving", "lowest_bidder", "vendors")
