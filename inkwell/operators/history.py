"""Scan history: latest scans, changes, batches, trends, and statement and issue differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import fingerprint, grade


def scans_from_events(events: DataFrame) -> DataFrame:
    """Events as scans: (scan_id, document_id, scan_time, score, grade, issue_count, category)."""
    score = F.pmod(F.floor("value").cast("int"), F.lit(101))
    return events.select(F.col("event_id").alias("scan_id"), F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("scan_time"), score.alias("score"), grade(score).alias("grade"), F.get_json_object("props", "$.k").cast("int").alias("issue_count"), F.col("event_type").alias("category"))


def latest_scan(scans: DataFrame) -> DataFrame:
    """The scan of greatest id of each document: one aggregation, no join."""
    newest = F.max_by(F.struct(*scans.columns), "scan_id").alias("s")
    return scans.groupBy(F.col("document_id").alias("of")).agg(newest).select("s.*")


def scan_changes(scans: DataFrame) -> DataFrame:
    """Every scan with its number in its document, and what changed since the one before."""
    w = Window.partitionBy("document_id").orderBy("scan_time", "scan_id")
    before = lambda c: F.lag(c).over(w)
    return scans.select("*", F.row_number().over(w).alias("scan_number"), (F.col("score") - before("score")).alias("score_change"), (F.col("issue_count") - before("issue_count")).alias("issue_change"), before("scan_id").isNotNull().alias("is_rescan"))


def score_trend(scans: DataFrame, n: int = 5) -> DataFrame:
    """The last n scans of each document, numbered from the oldest."""
    last = Window.partitionBy("document_id").orderBy(F.desc("scan_time"), F.desc("scan_id"))
    kept = scans.withColumn("back", F.row_number().over(last)).where(F.col("back") <= n)
    again = Window.partitionBy("document_id").orderBy("scan_time", "scan_id")
    return kept.withColumn("step", F.row_number().over(again)).drop("back")


def detect_batches(scans: DataFrame, seconds: int = 30) -> DataFrame:
    """(day, newest_us, scans, least_id): newest first, a scan joins the batch if it is within so many seconds of the batch's first.

    Every time of a day points to the one that begins the next batch if it begins one itself: the latest that is too far
    from it. Times are dealt to buckets just longer than a batch, so that this one is in the bucket before, or the last
    of the latest bucket before that; a bucket has one beginning at most. Times after a gap are beginnings whatever came
    earlier; from them the pointers are followed, and doubled every turn, until no new beginning turns up.
    Batches do not cross midnight; two scans or more are a batch.
    """
    far = seconds * 1_000_000 + 1
    bucket = ((F.col("t") - F.pmod("t", F.lit(far))) / far).cast("long")
    timed = scans.where("scan_time is not null").select(F.to_date("scan_time").alias("day"), F.unix_micros("scan_time").alias("t"), "scan_id")
    per = timed.groupBy("day", "t").agg(F.count("*").alias("n"), F.min("scan_id").alias("least")).withColumn("bucket", bucket).checkpoint()
    by_bucket = Window.partitionBy("day").orderBy("bucket")
    ends = per.groupBy("day", "bucket").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ends = ends.select("day", "bucket", F.lead("first").over(by_bucket).alias("newer"), F.max("last").over(by_bucket.rangeBetween(Window.unboundedPreceding, -2)).alias("older"))
    # a time asks in the bucket before for the latest that is not later in it than itself
    asks = per.select("day", (F.col("bucket") - 1).alias("of"), (F.col("t") - far).alias("at"), F.col("t").alias("asker"))
    given = per.select("day", F.col("bucket").alias("of"), F.col("t").alias("at"), F.lit(None).cast("long").alias("asker"))
    latest = F.max(F.when(F.col("asker").isNull(), F.col("at"))).over(Window.partitionBy("day", "of").orderBy("at", F.asc_nulls_first("asker")).rowsBetween(Window.unboundedPreceding, 0))
    found = asks.unionByName(given).withColumn("inside", latest).where("asker is not null")
    newer = F.lead("at").over(Window.partitionBy("day", "of").orderBy("at"))
    known = found.withColumn("newer_inside", newer).select("day", (F.col("of") + 1).alias("bucket"), F.col("asker").alias("t"), "inside", (F.col("newer_inside") + far).alias("newer_inside"))
    pointed = known.join(ends, ["day", "bucket"]).select("day", "t", F.coalesce("inside", "older").alias("next"), F.coalesce("newer_inside", "newer").alias("newer")).checkpoint()
    begins = pointed.where(F.col("newer").isNull() | (F.col("newer") - F.col("t") >= far)).select("day", "t").checkpoint()
    jumps = pointed.where("next is not null").select("day", "t", "next").checkpoint()
    count = begins.count()
    while True:
        more = begins.join(jumps, ["day", "t"]).select("day", F.col("next").alias("t"))
        begins = begins.unionByName(more).distinct().checkpoint()
        before, count = count, begins.count()
        if count == before:
            break
        ahead = jumps.select("day", F.col("t").alias("next"), F.col("next").alias("after"))
        jumps = jumps.join(ahead, ["day", "next"]).select("day", "t", F.col("after").alias("next")).checkpoint()
    at = begins.select("day", bucket.alias("bucket"), F.col("t").alias("own"))
    above = begins.select("day", (bucket - 1).alias("bucket"), F.col("t").alias("next_own"))
    first = F.when(F.col("own") >= F.col("t"), F.col("own")).otherwise(F.col("next_own"))
    joined = per.join(at, ["day", "bucket"], "left").join(above, ["day", "bucket"], "left").withColumn("newest_us", first)
    return joined.groupBy("day", "newest_us").agg(F.sum("n").alias("scans"), F.min("least").alias("least_id")).where("scans >= 2")


def score_histogram(scans: DataFrame) -> DataFrame:
    """Scores in tens, 90 to 100 together, with zeros for empty buckets."""
    buckets = scans.sparkSession.range(0, 100, 10).select(F.col("id").cast("int").alias("bucket"))
    n = scans.groupBy(F.least(F.floor(F.col("score") / 10) * 10, F.lit(90)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(buckets).join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("scans"))


def trend_change(scans: DataFrame, as_of: Column, days: int = 7, least: float = 1.0) -> DataFrame:
    """Mean score of the last days against the days before: (recent, before, change, direction)."""
    ago = F.datediff(F.to_date(as_of), F.to_date("scan_time"))
    means = scans.agg(F.avg(F.when(ago.between(0, days - 1), F.col("score"))).alias("recent"), F.avg(F.when(ago.between(days, 2 * days - 1), F.col("score"))).alias("before"))
    change = F.col("recent") - F.col("before")
    return means.select("recent", "before", change.alias("change"), F.when(change > least, "up").when(change < -least, "down").otherwise("stable").alias("direction"))


def daily_trend(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.to_date("scan_time").alias("day")).agg(F.avg("score").alias("score"), F.avg("issue_count").alias("issues"), F.count("*").alias("scans"))


def top_issues(scans: DataFrame, last: int = 100, top: int = 15) -> DataFrame:
    """The most frequent categories of the latest scans."""
    recent = scans.orderBy(F.desc("scan_time"), F.desc("scan_id")).limit(last)
    return recent.groupBy("category").agg(F.count("*").alias("scans"), F.sum("issue_count").alias("issues")).orderBy(F.desc("scans"), "category").limit(top)


def landing_metrics(scans: DataFrame) -> DataFrame:
    return scans.agg(F.count("*").alias("scans"), F.countDistinct("document_id").alias("documents"), F.avg("score").alias("score"), F.sum("issue_count").alias("issues"), F.max("scan_time").alias("last_scan"))


def delete_old(scans: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Scans that are not older than so many days."""
    return scans.where(F.datediff(F.to_date(as_of), F.to_date("scan_time")) <= days)


def record_scans(documents: DataFrame, new: DataFrame) -> DataFrame:
    """documents (document_id, last_scan, scan_count) with the new scans counted in; unseen documents are added."""
    per = new.groupBy("document_id").agg(F.max("scan_time").alias("newest"), F.count("*").alias("more"))
    return documents.join(per, "document_id", "full").select("document_id", F.greatest("last_scan", "newest").alias("last_scan"), (F.coalesce("scan_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("scan_count"))


def statement_diff(newer: DataFrame, older: DataFrame, keys: list[str]) -> DataFrame:
    """Statements of a newer and an older scan: (keys, description, status).

    Matched by fingerprint, else by trimmed lower-case description; a match whose directive or role differs is modified.
    Both sides: (keys, description, directive, role).
    """
    text = F.trim(F.lower("description"))
    new = newer.withColumn("fp", fingerprint(F.col("description"))).withColumn("low", text)
    old = older.withColumn("fp", fingerprint(F.col("description"))).withColumn("low", text)
    old_fp = old.groupBy(*keys, "fp").agg(F.max(F.struct("directive", "role")).alias("by_fp"))
    old_low = old.groupBy(*keys, "low").agg(F.max(F.struct("directive", "role")).alias("by_low"))
    match = F.coalesce("by_fp", "by_low")
    same = match["directive"].eqNullSafe(F.col("directive")) & match["role"].eqNullSafe(F.col("role"))
    status = F.when(match.isNull(), "added").when(same, "unchanged").otherwise("modified")
    kept = new.join(old_fp, [*keys, "fp"], "left").join(old_low, [*keys, "low"], "left").select(*keys, "description", status.alias("status"))
    gone = old.join(new.select(*keys, "fp").distinct(), [*keys, "fp"], "left_anti").join(new.select(*keys, "low").distinct(), [*keys, "low"], "left_anti")
    return kept.unionByName(gone.select(*keys, "description", F.lit("removed").alias("status")))


def issue_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(category, added, removed, unchanged) over distinct (category, print) of both sides."""
    a = old.select("category", "print").distinct().withColumn("was", F.lit(1))
    b = new.select("category", "print").distinct().withColumn("is_now", F.lit(1))
    both = a.join(b, ["category", "print"], "full")
    return both.groupBy("category").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("is_now").isNull()).alias("removed"), F.count_if(F.col("was").isNotNull() & F.col("is_now").isNotNull()).alias("unchanged"))


def dedupe_statements(statements: DataFrame, id_col: str = "stmt_id", keep: str = "latest") -> DataFrame:
    """One statement of each fingerprint, the one of greatest (or least) id; blank descriptions are all kept."""
    fp = F.when(F.trim("description") == "", F.concat(F.lit("#"), F.col(id_col).cast("string"))).otherwise(fingerprint(F.col("description")))
    order = F.desc(id_col) if keep == "latest" else F.asc(id_col)
    return statements.withColumn("place", F.row_number().over(Window.partitionBy(fp).orderBy(order))).where("place = 1").drop("place")


def duplicate_statements(statements: DataFrame) -> DataFrame:
    """(fingerprint, copies) of statements that come more than once."""
    return statements.groupBy(fingerprint(F.col("description")).alias("fp")).agg(F.count("*").alias("copies")).where("copies > 1")


def decisions_from_events(events: DataFrame) -> DataFrame:
    """Events as reviewers' decisions: purchase accepts, error rejects, view edits; others are none."""
    decision = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "view", "edited")
    return events.select(F.col("user_id").alias("pattern_key"), F.col("ts"), decision.alias("decision")).where("decision is not null")


def learn_patterns(decisions: DataFrame, accept: float = 0.7, reject: float = 0.3, least: int = 2) -> DataFrame:
    """What is predicted for each pattern: an edit is half an acceptance; too few decisions predict nothing."""
    per = decisions.groupBy("pattern_key").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "rejected", "edited")], F.count("*").alias("total"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    ratio = (F.col("accepted") + F.col("edited") * 0.5) / F.col("total")
    enough = F.col("total") >= least
    return per.withColumn("predicted", F.when(enough & (ratio >= accept), "accept").when(enough & (ratio <= reject), "reject")).withColumn("confidence", F.when(F.col("predicted") == "accept", ratio).when(F.col("predicted") == "reject", 1 - ratio).otherwise(F.lit(0.5)))


def learner_statistics(patterns: DataFrame, confident: float = 0.85) -> DataFrame:
    return patterns.agg(F.count("*").alias("patterns"), F.sum("total").alias("decisions"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum("edited").alias("edited"), F.count_if(F.col("confidence") >= confident).alias("confident"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def predict_actions(fixes: DataFrame, patterns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(pattern_key, action, confidence): a term of the dictionary is rejected for certain, else the pattern's prediction."""
    known = dictionary.select("pattern_key", F.lit(True).alias("known")).distinct()
    joined = fixes.join(known, "pattern_key", "left").join(patterns.select("pattern_key", "predicted", "confidence"), "pattern_key", "left")
    return joined.select("pattern_key", F.when(F.col("known"), "reject").otherwise(F.col("predicted")).alias("action"), F.when(F.col("known"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def role_boost(decisions: DataFrame, valid: DataFrame, invalid: DataFrame) -> DataFrame:
    """(pattern_key, boost): +.20 for known valid, -.30 for known invalid, else the learned leaning within .20 of zero."""
    learned = decisions.groupBy("pattern_key").agg(F.count_if(F.col("decision") == "accepted").alias("a"), F.count_if(F.col("decision") == "rejected").alias("r"), F.count("*").alias("n"))
    flag = lambda d, n: d.select("pattern_key", F.lit(True).alias(n)).distinct()
    joined = learned.join(flag(valid, "valid"), "pattern_key", "left").join(flag(invalid, "invalid"), "pattern_key", "left")
    lean = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), (F.col("a") - F.col("r")) / F.col("n") * 0.4))
    return joined.select("pattern_key", F.when(F.col("valid"), 0.2).when(F.col("invalid"), -0.3).otherwise(lean).alias("boost"))


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(state, n) of the distinct rows of two frames with the same columns: new in b, resolved since a, unchanged."""
    parts = {"new": b.subtract(a), "resolved": a.subtract(b), "unchanged": a.intersect(b)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("state"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def batch_update(rows: DataFrame, updates: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """Rows with the given fields replaced by key, without the deleted ones; nulls in updates change nothing."""
    fields = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias("new_" + c) for c in fields])
    joined = rows.join(deletes.select(key), key, "left_anti").join(new, key, "left")
    return joined.select(*[F.coalesce("new_" + c, c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def recent(df: DataFrame, n: int, time_col: str, id_col: str) -> DataFrame:
    """The n most recent rows: a top-k, never a full sort."""
    return df.orderBy(F.desc(time_col), F.desc(id_col)).limit(n)
