"""Operators on streams of scans, decisions, links and documents; each has a batch twin with the same aggregation.

Event time is the scan's time. Rows later than the watermark are dropped by the aggregating operators; state is kept
only as long as the watermark asks for. `changes` keeps the last scan of each document as keyed state with a time to live,
and hands late scans on instead of dropping them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def late_by(df: DataFrame, time_col: str, delay: str) -> DataFrame:
    """With a watermark if the frame is a stream; batch frames have no late rows."""
    return df.withWatermark(time_col, delay) if df.isStreaming else df


def _windowed(df: DataFrame, time_col: str, delay: str, window: Column, keys: list[str], aggs: list[Column]) -> DataFrame:
    out = late_by(df, time_col, delay).groupBy(window.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in out.columns if c not in ("w", *keys)])


def live_link_stats(results: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(start, end, status, links, fastest, mean, slowest) a minute; results: (ts, status, response_ms)."""
    r = F.col("response_ms")
    return _windowed(results, "ts", delay, F.window("ts", "1 minute"), ["status"], [F.count("*").alias("links"), F.min(r).alias("fastest"), F.avg(r).alias("mean"), F.max(r).alias("slowest")])


def activity(scans: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(start, end, scans, score) an hour; scans: (scan_time, score)."""
    return _windowed(scans, "scan_time", delay, F.window("scan_time", "1 hour"), [], [F.count("*").alias("scans"), F.avg("score").alias("score")])


def sliding_quality(scans: DataFrame, delay: str = "1 day") -> DataFrame:
    """(start, end, category, scans, score) over seven days, every day."""
    return _windowed(scans, "scan_time", delay, F.window("scan_time", "7 days", "1 day"), ["category"], [F.count("*").alias("scans"), F.avg("score").alias("score")])


def bursts(scans: DataFrame, keys: list[str], gap: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """(start, end, keys, scans, score): scans of one key no further apart than the gap from the one before.

    Sessions compare with the scan before; batches of the history operators compare with a batch's first scan.
    """
    return _windowed(scans, "scan_time", delay, F.session_window("scan_time", gap), keys, [F.count("*").alias("scans"), F.avg("score").alias("score")])


def learning(decisions: DataFrame) -> DataFrame:
    """Running counts of each pattern: (pattern_key, accepted, rejected, edited, total); one row of state a pattern."""
    return decisions.groupBy("pattern_key").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "rejected", "edited")], F.count("*").alias("total"))


def progress(results: DataFrame) -> DataFrame:
    """(batch, done, failed, first, last) of each running batch; results: (batch, ts, ok)."""
    return results.groupBy("batch").agg(F.count("*").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def rule_scan(docs: DataFrame, scan: Callable[[DataFrame], DataFrame], delay: str = "1 hour") -> DataFrame:
    """Issues of arriving documents, each delivery once: docs (doc_id, text, ts); the scan is any stateless operator."""
    fresh = docs.withColumn("file_hash", F.md5("text"))
    once = fresh.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id", "file_hash"]) if docs.isStreaming else fresh.dropDuplicates(["doc_id", "file_hash"])
    return scan(once.select("doc_id", "text"))


def scan_states(scans: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch's latest scan of every document to `write(frame, batch)`, which must be repeatable by batch number."""

    def each(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("document_id").agg(F.max_by(F.struct(*batch.columns), F.struct("scan_time", "scan_id")).alias("s"), F.count("*").alias("new_scans"))
        write(newest.select("s.*", "new_scans"), number)

    return scans.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGE = "document_id {id}, scan_id {scan}, scan_time timestamp, score double, issue_count double, scan_number long, score_change double, issue_change double, is_rescan boolean, late boolean"
LAST_SCAN = "scan_time timestamp, scan_id {scan}, score double, issue_count double, scans long"


def changes(scans: DataFrame, delay: str = "30 days", ttl_ms: int = 30 * 24 * 3_600_000) -> DataFrame:
    """Every arriving scan with what changed since the document's one before: the stream of history.scan_changes.

    Scans: (document_id, scan_id, scan_time, score, issue_count). The state of a document is its last scan and their
    number; it goes when the watermark, `delay` behind the latest scan, is `ttl_ms` past that last scan, and a document that
    comes again then begins anew. Scans behind the watermark are dropped by Spark; any other scan that is not after the last
    one that came before its micro-batch is late: it is returned with `late` and no change, and leaves the state as it is
    (`on_time` and `dead_letters` part both). Inside a micro-batch scans are put in order of (scan_time, scan_id). Null
    scores give null changes.
    """
    types = {f.name: f.dataType.simpleString() for f in scans.schema}
    names = ("scan_id", "scan_time", "score", "issue_count")

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["scan_time", "scan_id"])  # one document's scans of one micro-batch
        first = last = state.get if state.exists else None
        out = []
        for scan_id, time, score, issues in zip(*[rows[c] for c in names], strict=True):
            found = [key[0], scan_id, time, score, issues]
            if first is not None and (time, scan_id) <= (pd.Timestamp(first[0]), first[1]):
                out.append([*found, None, None, None, True, True])
                continue
            number = (last[4] if last is not None else 0) + 1
            change = [score - last[2], issues - last[3]] if last is not None else [None, None]
            out.append([*found, number, *change, last is not None, False])
            last = (time, scan_id, score, issues, number)
        if last is not None:
            state.update((pd.Timestamp(last[0]).to_pydatetime(), last[1], last[2], last[3], last[4]))
        ends = int(pd.Timestamp(last[0]).timestamp() * 1000) + ttl_ms
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        columns = ["document_id", *names, "scan_number", "score_change", "issue_change", "is_rescan", "late"]
        frame = pd.DataFrame(out, columns=columns)
        yield frame.astype({"scan_number": "Int64", "score_change": "float64", "issue_change": "float64"})

    slim = late_by(scans, "scan_time", delay).select("document_id", "scan_id", "scan_time", F.col("score").cast("double").alias("score"), F.col("issue_count").cast("double").alias("issue_count"))
    out, kept = CHANGE.format(id=types["document_id"], scan=types["scan_id"]), LAST_SCAN.format(scan=types["scan_id"])
    return slim.groupBy("document_id").applyInPandasWithState(each, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def on_time(changed: DataFrame) -> DataFrame:
    return changed.where("NOT late").drop("late")


def dead_letters(changed: DataFrame) -> DataFrame:
    """The scans that came after a later one of their document."""
    return changed.where("late").select("document_id", "scan_id", "scan_time", "score", "issue_count")


def run_to_memory(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns its result; for tests and small checks."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
