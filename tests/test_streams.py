import datetime

from inkwell.operators import history as H
from inkwell.streaming import streams as X

SCHEMA = "document_id long, scan_id long, scan_time timestamp, score double, issue_count double"


def test_changes_equal_the_batch_twin_and_late_scans_are_dead_letters(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda i: start + datetime.timedelta(minutes=i)
    rows = [(i % 7, i, at(i // 2), float(i * 37 % 101), float(i % 5)) for i in range(120)]
    late = [(3, 900, at(1), 50.0, 1.0), (4, 901, at(0), 51.0, 2.0)]
    fresh = [(3, 902, at(500), 60.0, 0.0), (99, 903, at(2), 10.0, 1.0)]
    for i, part in enumerate((rows[:50], rows[50:], late + fresh)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 0:
            stream = X.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
    changed = X.run_to_memory(X.changes(stream), "changes", "append")
    names = ["document_id", "scan_id", "scan_time", "score", "issue_count", "scan_number", "score_change", "issue_change", "is_rescan"]
    want = H.scan_changes(spark.createDataFrame(rows + fresh, SCHEMA)).select(*names)
    assert sorted(X.on_time(changed).select(*names).collect(), key=str) == sorted(want.collect(), key=str)
    assert sorted(map(tuple, X.dead_letters(changed).collect())) == sorted((d, i, t, s, n) for d, i, t, s, n in late)


def test_several_batches_share_state(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    for i in range(3):
        spark.createDataFrame([(1, i, start + datetime.timedelta(days=i), 10.0 * i, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = X.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
    got = X.run_to_memory(X.changes(stream), "shared", "append").orderBy("scan_id").collect()
    assert [(r.scan_number, r.score_change, r.is_rescan) for r in got] == [(1, None, False), (2, 10.0, True), (3, 10.0, True)]
