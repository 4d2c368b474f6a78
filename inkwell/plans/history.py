"""Queries on scan history, decisions and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import history as H
from inkwell.registry import query, table

SCANS = """scans AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT event_id AS scan_id, user_id AS document_id, ts AS scan_time, ((floor(value)::INTEGER % 101 + 101) % 101)::INTEGER AS score, (props->>'$.k')::INTEGER AS issue_count, event_type AS category FROM events))"""
DECISIONS = "decisions AS (SELECT * FROM (SELECT user_id AS pattern_key, ts, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'edited' END AS decision FROM events) WHERE decision IS NOT NULL)"
PATTERNS = f"""{DECISIONS}, per AS (SELECT pattern_key, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'edited') AS edited, count(*) AS total, min(ts) AS first_seen, max(ts) AS last_seen FROM decisions GROUP BY 1),
ratio AS (SELECT *, (accepted + edited * 0.5) / total::DOUBLE AS ratio FROM per),
predicted AS (SELECT *, CASE WHEN total >= 2 AND ratio >= 0.7 THEN 'accept' WHEN total >= 2 AND ratio <= 0.3 THEN 'reject' END AS predicted FROM ratio),
patterns AS (SELECT * EXCLUDE (ratio), CASE predicted WHEN 'accept' THEN ratio WHEN 'reject' THEN 1 - ratio ELSE 0.5 END AS confidence FROM predicted)"""
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def stamp(c: str):  # noqa: ANN201
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def scans(spark: SparkSession, sf: str) -> DataFrame:
    return H.scans_from_events(table(spark, sf, "events"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return H.decisions_from_events(table(spark, sf, "events"))


@query("w1_latest_scan", f"WITH {SCANS} SELECT scan_id, document_id, {STAMP.format('scan_time')} AS scan_time, score, grade, issue_count, category FROM scans QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY scan_id DESC) = 1")
def latest_scan(spark: SparkSession, sf: str) -> DataFrame:
    return H.latest_scan(scans(spark, sf)).withColumn("scan_time", stamp("scan_time"))


@query("w2_scan_changes", f"WITH {SCANS} SELECT scan_id, document_id, row_number() OVER o::INTEGER AS scan_number, score - lag(score) OVER o AS score_change, issue_count - lag(issue_count) OVER o AS issue_change, lag(scan_id) OVER o IS NOT NULL AS is_rescan FROM scans WINDOW o AS (PARTITION BY document_id ORDER BY scan_time, scan_id)".replace("row_number() OVER o::INTEGER", "(row_number() OVER o)::INTEGER"))
def scan_changes(spark: SparkSession, sf: str) -> DataFrame:
    return H.scan_changes(scans(spark, sf)).select("scan_id", "document_id", "scan_number", "score_change", "issue_change", "is_rescan")


@query("w3_score_trend", f"WITH {SCANS}, k AS (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY scan_time DESC, scan_id DESC) <= 5) SELECT scan_id, document_id, score, (row_number() OVER (PARTITION BY document_id ORDER BY scan_time, scan_id))::INTEGER AS step FROM k")
def score_trend(spark: SparkSession, sf: str) -> DataFrame:
    return H.score_trend(scans(spark, sf)).select("scan_id", "document_id", "score", "step")


@query("w15_detect_batches", f"""WITH RECURSIVE {SCANS}, o AS (SELECT scan_id, scan_time::DATE AS day, epoch_us(scan_time) AS t, row_number() OVER (PARTITION BY scan_time::DATE ORDER BY scan_time DESC, scan_id DESC) AS i FROM scans),
f AS (SELECT day, i, scan_id, t AS first, 1::BIGINT AS batch FROM o WHERE i = 1 UNION ALL SELECT o.day, o.i, o.scan_id, CASE WHEN f.first - o.t <= 30000000 THEN f.first ELSE o.t END, CASE WHEN f.first - o.t <= 30000000 THEN f.batch ELSE f.batch + 1 END FROM f JOIN o ON o.day = f.day AND o.i = f.i + 1)
SELECT strftime(day, '%Y-%m-%d') AS day, first AS newest_us, count(*) AS scans, min(scan_id) AS least_id FROM f GROUP BY day, batch, first HAVING count(*) >= 2""")
def detect_batches(spark: SparkSession, sf: str) -> DataFrame:
    return H.detect_batches(scans(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("a46_landing_metrics", f"WITH {SCANS} SELECT count(*) AS scans, count(DISTINCT document_id) AS documents, avg(score) AS score, sum(issue_count)::BIGINT AS issues, {STAMP.format('max(scan_time)')} AS last_scan FROM scans")
def landing_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return H.landing_metrics(scans(spark, sf)).withColumn("last_scan", stamp("last_scan"))


@query("a47_score_histogram", f"WITH {SCANS} SELECT b::INTEGER AS bucket, count(scan_id) AS scans FROM range(0, 100, 10) r(b) LEFT JOIN scans ON least(score // 10 * 10, 90) = b GROUP BY b")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return H.score_histogram(scans(spark, sf))


@query("a48_top_issues", f"WITH {SCANS}, r AS (SELECT * FROM scans ORDER BY scan_time DESC, scan_id DESC LIMIT 100) SELECT category, count(*) AS scans, sum(issue_count)::BIGINT AS issues FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_issues(spark: SparkSession, sf: str) -> DataFrame:
    return H.top_issues(scans(spark, sf))


@query("a49_score_trend_change", f"WITH {SCANS}, m AS (SELECT avg(score) FILTER (date_diff('day', scan_time::DATE, DATE '2024-01-20') BETWEEN 0 AND 6) AS recent, avg(score) FILTER (date_diff('day', scan_time::DATE, DATE '2024-01-20') BETWEEN 7 AND 13) AS before FROM scans) SELECT recent, before, recent - before AS change, CASE WHEN recent - before > 1 THEN 'up' WHEN recent - before < -1 THEN 'down' ELSE 'stable' END AS direction FROM m")
def trend_change(spark: SparkSession, sf: str) -> DataFrame:
    return H.trend_change(scans(spark, sf), F.lit("2024-01-20").cast("date"))


@query("a50_daily_trend", f"WITH {SCANS} SELECT strftime(scan_time, '%Y-%m-%d') AS day, avg(score) AS score, avg(issue_count) AS issues, count(*) AS scans FROM scans GROUP BY 1")
def daily_trend(spark: SparkSession, sf: str) -> DataFrame:
    return H.daily_trend(scans(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("s12_record_scans", f"WITH {SCANS}, o AS (SELECT document_id, max(scan_time) AS last_scan, count(*) AS n FROM scans WHERE scan_id % 3 <> 0 GROUP BY 1), w AS (SELECT document_id, max(scan_time) AS newest, count(*) AS more FROM scans WHERE scan_id % 3 = 0 GROUP BY 1) SELECT coalesce(o.document_id, w.document_id) AS document_id, {STAMP.format('greatest(last_scan, newest)')} AS last_scan, coalesce(n, 0) + coalesce(more, 0) AS scan_count FROM o FULL JOIN w ON o.document_id = w.document_id")
def record_scans(spark: SparkSession, sf: str) -> DataFrame:
    s = scans(spark, sf)
    known = s.where("scan_id % 3 <> 0").groupBy("document_id").agg(F.max("scan_time").alias("last_scan"), F.count("*").alias("scan_count"))
    return H.record_scans(known, s.where("scan_id % 3 = 0")).withColumn("last_scan", stamp("last_scan"))


@query("s13_delete_old", f"WITH {SCANS} SELECT category, count(*) AS scans, min(scan_id) AS least_id FROM scans WHERE date_diff('day', scan_time::DATE, DATE '2024-01-20') <= 10 GROUP BY 1")
def delete_old(spark: SparkSession, sf: str) -> DataFrame:
    return H.delete_old(scans(spark, sf), F.lit("2024-01-20").cast("date"), 10).groupBy("category").agg(F.count("*").alias("scans"), F.min("scan_id").alias("least_id"))


@query("k2_recent", f"WITH {SCANS} SELECT scan_id, document_id, score FROM scans ORDER BY scan_time DESC, scan_id DESC LIMIT 200")
def recent(spark: SparkSession, sf: str) -> DataFrame:
    return H.recent(scans(spark, sf), 200, "scan_time", "scan_id").select("scan_id", "document_id", "score")


@query("f13_json_access", "SELECT user_id, sum((props->>'$.k')::INTEGER)::BIGINT AS k, count(*) AS events FROM events GROUP BY 1")
def json_access(spark: SparkSession, sf: str) -> DataFrame:
    parsed = table(spark, sf, "events").select("user_id", F.from_json("props", "k int").alias("p"))
    return parsed.groupBy("user_id").agg(F.sum("p.k").alias("k"), F.count("*").alias("events"))


@query("a54_learn_patterns", f"WITH {PATTERNS} SELECT pattern_key, accepted, rejected, edited, total, predicted, confidence FROM patterns")
def learn_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return H.learn_patterns(decisions(spark, sf)).drop("first_seen", "last_seen")


@query("a55_learner_statistics", f"WITH {PATTERNS} SELECT count(*) AS patterns, sum(total)::BIGINT AS decisions, sum(accepted)::BIGINT AS accepted, sum(rejected)::BIGINT AS rejected, sum(edited)::BIGINT AS edited, count(*) FILTER (confidence >= 0.85) AS confident, {STAMP.format('min(first_seen)')} AS first_seen, {STAMP.format('max(last_seen)')} AS last_seen FROM patterns")
def learner_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return H.learner_statistics(H.learn_patterns(decisions(spark, sf))).withColumns({c: stamp(c) for c in ("first_seen", "last_seen")})


@query("a56_role_boost", f"WITH {DECISIONS}, l AS (SELECT pattern_key, count(*) FILTER (decision = 'accepted') AS a, count(*) FILTER (decision = 'rejected') AS r, count(*) AS n FROM decisions GROUP BY 1) SELECT pattern_key, CASE WHEN pattern_key % 10 = 0 THEN 0.2 WHEN pattern_key % 10 = 1 THEN -0.3 ELSE greatest(-0.2, least(0.2, (a - r) / n::DOUBLE * 0.4)) END AS boost FROM l")
def role_boost(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf)
    return H.role_boost(d, d.where("pattern_key % 10 = 0"), d.where("pattern_key % 10 = 1"))


@query("j26_predict_actions", f"WITH {PATTERNS}, fixes AS (SELECT DISTINCT user_id AS pattern_key FROM events) SELECT pattern_key, CASE WHEN pattern_key % 10 = 3 THEN 'reject' ELSE predicted END AS action, CASE WHEN pattern_key % 10 = 3 THEN 1.0 ELSE coalesce(confidence, 0.0) END AS confidence FROM fixes LEFT JOIN patterns USING (pattern_key)")
def predict_actions(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf)
    fixes = table(spark, sf, "events").select(F.col("user_id").alias("pattern_key")).distinct()
    return H.predict_actions(fixes, H.learn_patterns(d), fixes.where("pattern_key % 10 = 3"))


@query("u1_compare_analyses", f"WITH {SCANS}, a AS (SELECT DISTINCT document_id, category FROM scans WHERE scan_id % 2 = 0), b AS (SELECT DISTINCT document_id, category FROM scans WHERE scan_id % 2 = 1) SELECT 'new' AS state, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS n UNION ALL SELECT 'resolved', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL SELECT 'unchanged', (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))")
def compare_analyses(spark: SparkSession, sf: str) -> DataFrame:
    s = scans(spark, sf).select("document_id", "category", "scan_id")
    return H.compare_sets(s.where("scan_id % 2 = 0").drop("scan_id"), s.where("scan_id % 2 = 1").drop("scan_id"))


@query("u5_batch_update", f"WITH {SCANS} SELECT scan_id, CASE WHEN scan_id % 5 = 0 THEN 'reviewed' ELSE category END AS category, score FROM scans WHERE scan_id % 7 <> 0")
def batch_update(spark: SparkSession, sf: str) -> DataFrame:
    s = scans(spark, sf).select("scan_id", "category", "score")
    return H.batch_update(s, s.where("scan_id % 5 = 0").select("scan_id", F.lit("reviewed").alias("category")), s.where("scan_id % 7 = 0"), "scan_id")


FP = r"substr(md5(trim(regexp_replace(lower({}), '[ \t\n\r]+', ' ', 'g'))), 1, 16)"
TURNS = rf"turns AS (SELECT conv_id, turn, role, text, {FP.format('text')} AS fp, trim(lower(text)) AS low FROM conversations)"


@query("a53_duplicate_statements", f"SELECT {FP.format('text')} AS fp, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_statements(spark: SparkSession, sf: str) -> DataFrame:
    return H.duplicate_statements(table(spark, sf, "documents").withColumnRenamed("text", "description"))


@query("w5_dedupe_statements", f"WITH {TURNS} SELECT conv_id, turn FROM turns QUALIFY row_number() OVER (PARTITION BY CASE WHEN trim(text) = '' THEN '#' || (conv_id * 1000 + turn) ELSE fp END ORDER BY conv_id * 1000 + turn DESC) = 1")
def dedupe_statements(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stmt_id"), "conv_id", "turn", F.col("text").alias("description"))
    return H.dedupe_statements(t).select("conv_id", "turn")


@query("j16_statement_diff", f"""WITH {TURNS}, new AS (SELECT conv_id, t.text, t.role, f.role AS by_fp, l.role AS by_low, f.k AS fk, l.k AS lk FROM (SELECT * FROM turns WHERE turn % 2 = 1) t
  LEFT JOIN (SELECT conv_id, fp, max(role) AS role, 1 AS k FROM turns WHERE turn % 2 = 0 GROUP BY ALL) f USING (conv_id, fp) LEFT JOIN (SELECT conv_id, low, max(role) AS role, 1 AS k FROM turns WHERE turn % 2 = 0 GROUP BY ALL) l USING (conv_id, low)),
s AS (SELECT CASE WHEN fk IS NULL AND lk IS NULL THEN 'added' WHEN (CASE WHEN fk IS NOT NULL THEN by_fp ELSE by_low END) IS NOT DISTINCT FROM role THEN 'unchanged' ELSE 'modified' END AS status FROM new
  UNION ALL SELECT 'removed' FROM turns o WHERE turn % 2 = 0 AND NOT EXISTS (SELECT 1 FROM turns n WHERE n.turn % 2 = 1 AND n.conv_id = o.conv_id AND (n.fp = o.fp OR n.low = o.low)))
SELECT status, count(*) AS statements FROM s GROUP BY 1""")
def statement_diff(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("description"), F.lit(None).cast("string").alias("directive"))
    return H.statement_diff(t.where("turn % 2 = 1"), t.where("turn % 2 = 0"), ["conv_id"]).groupBy("status").agg(F.count("*").alias("statements"))


@query("j17_issue_diff", f"WITH {TURNS}, a AS (SELECT DISTINCT role AS category, fp FROM turns WHERE conv_id % 2 = 0), b AS (SELECT DISTINCT role AS category, fp FROM turns WHERE conv_id % 2 = 1) SELECT coalesce(a.category, b.category) AS category, count(*) FILTER (a.fp IS NULL) AS added, count(*) FILTER (b.fp IS NULL) AS removed, count(*) FILTER (a.fp IS NOT NULL AND b.fp IS NOT NULL) AS unchanged FROM a FULL JOIN b ON a.category = b.category AND a.fp = b.fp GROUP BY 1")
def issue_diff(spark: SparkSession, sf: str) -> DataFrame:
    from inkwell.functions.text import fingerprint

    t = table(spark, sf, "conversations").select("conv_id", F.col("role").alias("category"), fingerprint(F.col("text")).alias("print"))
    return H.issue_diff(t.where("conv_id % 2 = 0"), t.where("conv_id % 2 = 1"))
