"""Base views over the tables: the change feed, the log, expected states and the bucket's listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.feed import invalid_reason, is_delete
from auditlake.functions.rfc3339 import epoch_ms
from auditlake.operators.dedupe import keep_first
from auditlake.operators.sequencing import number
from auditlake.sources.tables import table

#: Grace of the audit and clock of the scans, in milliseconds; the clock is the last observation's time.
GRACE_MS = 300_000


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries, one row each, with the message's fields at the top level and the bucket's role."""
    roles = table(spark, folder, "bucket_roles")
    n = table(spark, folder, "notifications").select(
        "delivery", "batch_id", "attempt", "queue", "received_at", "action", "bucket", F.col("object.key").alias("key"), F.col("object.size").alias("size"),
        F.col("object.etag").alias("etag"), "event_time", F.col("copy_source").isNotNull().alias("copied"),
    )
    return n.join(roles, "bucket", "left")


def classified(spark: SparkSession, folder: str) -> DataFrame:
    """The feed with ``class`` (event, loop, foreign, invalid) and ``reason``. The log's own bucket is recognised first."""
    reason = invalid_reason(F.col("action"), F.col("key"), F.col("size"), F.col("etag"), F.col("event_time"), F.col("copied"))
    bad = F.when(F.col("bucket").isNull(), "bucket").otherwise(F.when(F.col("bucket_role") == "monitored", reason))
    rows = feed(spark, folder).withColumn("reason", bad)
    kind = F.when(F.col("bucket").isNull(), "invalid").when(F.col("bucket_role") == "log", "loop").when(F.coalesce(F.col("bucket_role"), F.lit("other")) != "monitored", "foreign")
    return rows.withColumn("class", kind.when(F.col("reason").isNotNull(), "invalid").otherwise("event"))


def entry_log(spark: SparkSession, folder: str) -> DataFrame:
    """``seq``, ``item_pos``, ``event_id``, ``entry``: offered items, each event once, numbered in their order.

    Items without an event id cannot be told from copies and are refused.
    """
    items = table(spark, folder, "append_items").filter("event_id IS NOT NULL").select("item_pos", "event_id", "entry")
    first = keep_first(items.select("item_pos", "event_id"), [F.col("item_pos")], "event_id").select("item_pos")
    return number(first.join(items, "item_pos"), "item_pos")


def object_log(spark: SparkSession, folder: str) -> DataFrame:
    """``object.event`` entries with their instant and the name under which the log knows the object."""
    e = table(spark, folder, "object_events")
    return e.select(
        "seq", "action", F.coalesce("key_hmac", "key").alias("name"), "key", "key_hmac", "etag", "size", "event_time", "ingested_at",
        epoch_ms(F.col("event_time")).alias("event_ms"), epoch_ms(F.col("ingested_at")).alias("ingested_ms"), is_delete(F.col("action")).alias("deleted"),
    )


def expected_state(log: DataFrame) -> DataFrame:
    """Latest state per name by (event_ms, seq), whatever the order of the rows. Combines on the map side."""
    newest = F.max(F.struct("event_ms", "seq", "deleted", "etag", "size")).alias("s")
    return log.groupBy("name").agg(newest).select("name", "s.etag", "s.size", "s.event_ms", "s.seq", "s.deleted")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The bucket as last observed: one row per key."""
    newest = F.max(F.struct("observed_at", "scan_id", "uploaded", "etag", "size")).alias("s")
    return table(spark, folder, "scrub_observations").groupBy("key").agg(newest).select("key", "s.etag", "s.size", "s.uploaded", "s.observed_at", "s.scan_id")


def clock(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "scrub_observations").agg(F.max("observed_at")).first()[0] or 0


# The same views for DuckDB, as parts of a WITH clause. --------------------------------------------------------------


def ms(c: str) -> str:
    return (
        f"(CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]{{1,9}})?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])') THEN "
        f"epoch_us(try_cast(replace(substr({c}, 1, 19), 'T', ' ') AS timestamp)) // 1000 "
        f"+ cast(rpad(left(regexp_extract({c}, '[.]([0-9]+)', 1), 3), 3, '0') AS bigint) "
        f"- CASE WHEN {c} LIKE '%Z' THEN 0 ELSE (CASE WHEN substr({c}, -6, 1) = '-' THEN -1 ELSE 1 END) "
        f"* (cast(substr({c}, -5, 2) AS bigint) * 60 + cast(substr({c}, -2, 2) AS bigint)) * 60000 END END)"
    )


DELETES = "('DeleteObject', 'LifecycleDeletion')"
ACTIONS = "('PutObject', 'CopyObject', 'CompleteMultipartUpload', 'DeleteObject', 'LifecycleDeletion')"
FEED = """feed AS (SELECT n.delivery, n.batch_id, n.attempt, n.queue, n.received_at, n.action, n.bucket, n.object.key AS key, n.object.size AS size, n.object.etag AS etag, n.event_time,
  n.copy_source IS NOT NULL AS copied, r.bucket_role FROM notifications n LEFT JOIN bucket_roles r ON n.bucket = r.bucket)"""
CLASSIFIED = f"""{FEED}, judged AS (SELECT *, CASE WHEN bucket IS NULL THEN 'bucket' WHEN bucket_role = 'monitored' THEN CASE
    WHEN action IS NULL OR action NOT IN {ACTIONS} THEN 'action' WHEN key IS NULL OR NOT octet_length(encode(key)) BETWEEN 1 AND 1024 THEN 'object.key'
    WHEN size IS NOT NULL AND NOT size BETWEEN 0 AND 9007199254740991 THEN 'object.size' WHEN etag IS NOT NULL AND NOT regexp_full_match(etag, '[\\x21\\x23-\\x7e]{{1,256}}') THEN 'object.etag'
    WHEN {ms('event_time')} IS NULL THEN 'event_time' WHEN action IN {DELETES} AND size IS NOT NULL THEN 'object.size on a deletion'
    WHEN action IN {DELETES} AND etag IS NOT NULL THEN 'object.etag on a deletion' WHEN copied AND action <> 'CopyObject' THEN 'copy_source' END END AS reason FROM feed),
classified AS (SELECT *, CASE WHEN bucket IS NULL THEN 'invalid' WHEN bucket_role = 'log' THEN 'loop' WHEN coalesce(bucket_role, 'other') <> 'monitored' THEN 'foreign'
  WHEN reason IS NOT NULL THEN 'invalid' ELSE 'event' END AS class FROM judged)"""
ENTRY_LOG = """entry_log AS (SELECT row_number() OVER (ORDER BY item_pos) - 1 AS seq, item_pos, event_id, entry FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY item_pos) AS rn
  FROM append_items WHERE event_id IS NOT NULL) WHERE rn = 1)"""
OBJECT_LOG = f"""object_log AS (SELECT seq, action, coalesce(key_hmac, key) AS name, key, key_hmac, etag, size, event_time, ingested_at, {ms('event_time')} AS event_ms, {ms('ingested_at')} AS ingested_ms,
  action IN {DELETES} AS deleted FROM object_events)"""
STATE = f"""{OBJECT_LOG}, state AS (SELECT name, etag, size, event_ms, seq, deleted FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_ms DESC, seq DESC) AS rn FROM object_log) WHERE rn = 1)"""
LISTING = """listing AS (SELECT key, etag, size, uploaded, observed_at, scan_id FROM (SELECT *, row_number() OVER (PARTITION BY key
  ORDER BY observed_at DESC, scan_id DESC, uploaded DESC, etag DESC, size DESC) AS rn FROM scrub_observations) WHERE rn = 1),
clock AS (SELECT max(observed_at) AS now_ms FROM scrub_observations)"""
