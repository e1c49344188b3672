"""Queries that run the streaming operators over the recorded feed, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.feed import invalid_reason
from auditlake.functions.rfc3339 import epoch_ms, iso_hour
from auditlake.functions.text import event_id
from auditlake.operators.feed import ObjectFeed
from auditlake.plans import log, problems
from auditlake.session import work_dir
from auditlake.sources.tables import table
from auditlake.streaming.ingest import CorrectedPeriods, LogSink, apply_changes, parquet_stream, run


#: Pieces in which the recorded tables arrive. Each is a micro-batch of a query started anew on the same checkpoint.
PIECES = 5


def _arriving(spark: SparkSession, rows: DataFrame, time: str, root: str) -> Iterator[DataFrame]:
    """The rows piece by piece, in ranges of ``time``: writes a piece and gives the stream to run over it."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    piece = F.least(F.lit(PIECES - 1), F.expr(f"({time} - {low or 0}) * {PIECES} div ({(high or 0) - (low or 0)} + 1)"))
    for i in range(PIECES):
        rows.filter(piece == i).write.mode("append").parquet(f"{root}/in")
        yield parquet_stream(spark, f"{root}/in", files_per_batch=100_000)


def ingest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The log that streaming ingestion builds: sound messages of the monitored bucket, again once their time to live is over.

    Five micro-batches, with a restart before each: query and sink are made anew and go on from their folders.
    """
    roles = table(spark, folder, "bucket_roles").filter("bucket_role = 'monitored'").select("bucket")
    key, etag, size = F.col("object.key"), F.col("object.etag"), F.col("object.size")
    sound = invalid_reason(F.col("action"), key, size, etag, F.col("event_time"), F.col("copy_source").isNotNull()).isNull()
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', received_at)")
    rows = table(spark, folder, "notifications").select("delivery", "bucket", "action", "object", "event_time", "copy_source", ms.alias("t"))
    root = work_dir(spark, "ingest")
    for stream in _arriving(spark, rows, "t", root):
        events = stream.join(roles, "bucket", "left_semi").filter(sound)
        events = events.select("delivery", "t", event_id(F.col("bucket"), key, F.col("action"), etag, F.col("event_time")).alias("event_id"))
        run(events, f"{root}/checkpoint", LogSink(spark, f"{root}/out", "event_id", "delivery", "t", log.TTL_MS)).awaitTermination()
    return LogSink(spark, f"{root}/out", "event_id", "delivery", "t", log.TTL_MS).log().select("seq", "delivery", "event_id")


def late_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected hours as a stream of five micro-batches leaves them, with a restart before each."""
    e = table(spark, folder, "object_events").select("seq", epoch_ms(F.col("event_time")).alias("event_ms"), epoch_ms(F.col("ingested_at")).alias("ingested_ms"), "size")
    root = work_dir(spark, "late")
    sink = lambda: CorrectedPeriods(spark, f"{root}/out", "seq", "event_ms", "ingested_ms", "size")
    for stream in _arriving(spark, e, "ingested_ms", root):
        run(stream, f"{root}/checkpoint", sink()).awaitTermination()
    return sink().read().select(iso_hour(F.col("period")).alias("event_hour"), "first_count", "first_size", F.col("count").alias("events"), F.col("size").alias("total_size"), "corrections", "cut_off")


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The bucket's state as a stream of changes leaves it: ``p4_state`` from five micro-batches with restarts."""
    rows, root = problems.deliveries(spark, folder), work_dir(spark, "changes")
    for stream in _arriving(spark, rows, "arrival", root):
        run(stream, f"{root}/checkpoint", apply_changes(ObjectFeed(spark, f"{root}/out"))).awaitTermination()
    return ObjectFeed(spark, f"{root}/out").read(tombstones=True).select(F.col("k").alias("key"), "deleted", "etag")


QUERIES = {"ingest_stream": ingest_stream, "late_stream": late_stream, "change_stream": change_stream}
_PIECES = f"piece AS (SELECT delivery, least({PIECES - 1}, (t - lo) * {PIECES} // (hi - lo + 1)) AS piece FROM (SELECT delivery, epoch_us(received_at) // 1000 AS t, min(epoch_us(received_at) // 1000) OVER () AS lo, max(epoch_us(received_at) // 1000) OVER () AS hi FROM notifications))"
SQL = {
    "ingest_stream": log.SQL["dedupe_window"].replace("SELECT delivery, accepted FROM f", f", {_PIECES} SELECT row_number() OVER (ORDER BY p.piece, f.delivery) - 1 AS seq, f.delivery, f.event_id FROM f JOIN piece p ON p.delivery = f.delivery WHERE f.accepted").replace(")\n  , piece", "),\n  piece"),
    "late_stream": problems.SQL["p2_hours"], "change_stream": problems.SQL["p4_state"],
}
