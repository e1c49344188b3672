"""Queries of the data-pipeline problems 1 to 5 over the tables of the audit log, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.rfc3339 import epoch_ms, iso_hour
from auditlake.operators import late, seen
from auditlake.operators.dedupe import ID, copies, dedupe_batch, with_id
from auditlake.operators.diff import diff_copies
from auditlake.operators.feed import ObjectFeed
from auditlake.session import work_dir
from auditlake.sources.tables import table
from auditlake.sources.views import ms

#: Batches into which the recorded feed is cut when it is applied; a live feed has its own.
FEED_BATCHES = 4


# 1 ------------------------------------------------------------------------------------------------------------------


def _state_diff(spark: SparkSession, folder: str, values: bool) -> DataFrame:
    return diff_copies(
        table(spark, folder, "expected_objects"),
        table(spark, folder, "scrub_observations"),
        ["key"],
        ["etag", "size"],
        right_version=["observed_at", "scan_id", "uploaded"],
        left_deleted="deleted",
        names=("only_expected", "only_observed"),
        unknown_left=True,
        values=values,
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _state_diff(spark, folder, values=False)


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """The same differences with both values."""
    return _state_diff(spark, folder, values=True)


# 2 ------------------------------------------------------------------------------------------------------------------


def _object_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "object_events").select(
        "seq", epoch_ms(F.col("event_time")).alias("event_ms"), epoch_ms(F.col("ingested_at")).alias("ingested_ms"), "size"
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that change the stored aggregate of an hour that is over."""
    rows = late.outcomes(_object_events(spark, folder), F.col("seq"), F.col("event_ms"), F.col("ingested_ms"), keep=("correction",), size=F.col("size"))
    return rows.select(F.col("row").alias("seq"), iso_hour(F.col("period")).alias("event_hour"))


def p2_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Per hour: counts and sizes as known at its end and after six hours of corrections."""
    hours = late.corrected(_object_events(spark, folder), F.col("seq"), F.col("event_ms"), F.col("ingested_ms"), F.col("size"))
    return hours.select(
        iso_hour(F.col("period")).alias("event_hour"), "first_count", "first_size", F.col("count").alias("events"), F.col("size").alias("total_size"), "corrections", "cut_off"
    )


# 3 ------------------------------------------------------------------------------------------------------------------


def _message() -> tuple[list, list]:
    """The fields that identify a message, and those it must have."""
    must = [F.col("bucket"), F.col("object.key"), F.col("action"), F.col("event_time")]
    return [*must, F.col("object.etag")], must


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies(table(spark, folder, "notifications"), *_message(), "delivery")


def p3_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries kept when the feed comes in two batches, the second judged against the identifiers stored by the first."""
    rows = with_id(table(spark, folder, "notifications"), *_message()).select(ID, "delivery")
    middle = (rows.agg(F.max("delivery")).first()[0] or 0) // 2
    first, stored = dedupe_batch(rows.filter(F.col("delivery") <= middle), None, [F.col("delivery")])
    second, _ = dedupe_batch(rows.filter(F.col("delivery") > middle), stored, [F.col("delivery")])
    return first.select("delivery").unionByName(second.select("delivery"))


# 4 ------------------------------------------------------------------------------------------------------------------


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The monitored bucket's messages, as :class:`ObjectFeed` takes them."""
    roles = table(spark, folder, "bucket_roles").filter("bucket_role = 'monitored'").select("bucket")
    rows = table(spark, folder, "notifications").join(roles, "bucket", "left_semi")
    return rows.select(
        F.col("object.key").alias("key"), "action", F.col("object.etag").alias("etag"), "event_time", F.col("object.size").alias("size"), F.col("copy_source").isNotNull().alias("copied"), F.col("delivery").alias("arrival")
    )


def object_feed(spark: SparkSession, folder: str, batches: int = FEED_BATCHES) -> ObjectFeed:
    """The bucket's table, rebuilt by applying the feed in ``batches`` equal ranges of deliveries, as a live feed would bring it.

    Every batch is applied by an object of its own on the same folder, which finds there what the earlier ones left.
    """
    root, rows = work_dir(spark, "objects"), deliveries(spark, folder)
    last = table(spark, folder, "notifications").agg(F.max("delivery")).first()[0] or 0
    for i in range(batches):
        low, high = (last + 1) * i // batches, (last + 1) * (i + 1) // batches
        part = rows.filter(((F.col("arrival") >= low) | (i == 0)) & (F.col("arrival") < high))
        feed = ObjectFeed(spark, root)
        feed.apply(i, part)
        if i and i == batches // 2:
            feed.table.compact()
    return ObjectFeed(spark, root)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return object_feed(spark, folder).read().select(F.col("k").alias("key"), "etag")


def p4_state(spark: SparkSession, folder: str) -> DataFrame:
    """Every key ever changed, with its tombstones; the feed comes in twenty batches, compacted half way."""
    return object_feed(spark, folder, 20).read(tombstones=True).select(F.col("k").alias("key"), "deleted", "etag")


# 5 ------------------------------------------------------------------------------------------------------------------


def _answered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = seen.keyed(table(spark, folder, "append_items"), F.col("event_id"), F.col("item_pos"))
    path = work_dir(spark, "seen")
    seen.answers(rows, only_seen=True).write.parquet(path)
    return rows, spark.read.parquet(path)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, answered = _answered(spark, folder)
    return seen.repeats(rows, answered).select(F.col("pos").alias("item_pos"))


def p5_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The same repeats when the items come in three batches, between which the filter keeps its chains and no keys.

    The filter's answers need no earlier item. The exact check of its positive ones does, as in ``p5_found``: it looks
    up the first position of every candidate's key among the items of all batches.
    """
    items = table(spark, folder, "append_items")
    rows = seen.keyed(items, F.col("event_id"), F.col("item_pos"))
    root, last, found = work_dir(spark, "store"), items.agg(F.max("item_pos")).first()[0] or 0, None
    for i in range(3):
        low, high = (last + 1) * i // 3, (last + 1) * (i + 1) // 3
        store = seen.SeenStore(root, shards=16)  # made anew, as after a restart
        store.apply(i, rows.filter(((F.col("pos") >= low) | (i == 0)) & (F.col("pos") < high)))
        part = store.answers(spark, i).filter("seen")
        found = part if found is None else found.unionByName(part)
    return seen.repeats(rows, found).select(F.col("pos").alias("item_pos"))


def p5_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The filter's answer for every item; null where there is no key."""
    items = table(spark, folder, "append_items")
    rows = seen.answers(seen.keyed(items, F.col("event_id"), F.col("item_pos"))).select(F.col("pos").alias("item_pos"), "seen")
    return rows.unionByName(items.filter("event_id IS NULL").selectExpr("item_pos", "cast(null AS boolean) AS seen"))


def p5_rate(spark: SparkSession, folder: str) -> DataFrame:
    """One row: how often the filter was wrong. ``missed`` repeats are impossible and counted anyway."""
    rows, answered = _answered(spark, folder)
    none = F.lit(None).cast("long")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    parts = keys.agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("new"), none.alias("said"), none.alias("hit"))
    parts = parts.unionByName(answered.agg(none.alias("items"), none.alias("new"), F.count(F.lit(1)).alias("said"), none.alias("hit")))
    parts = parts.unionByName(seen.repeats(rows, answered).agg(none.alias("items"), none.alias("new"), none.alias("said"), F.count(F.lit(1)).alias("hit")))
    one = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items", "new", "said", "hit")])
    return one.selectExpr(
        "items", "items - new AS repeats", "said AS answered_seen", "said - hit AS wrong", "items - new - hit AS missed",
        "cast(said - hit AS double) / greatest(new, 1) AS wrong_rate", f"cast({seen.ERROR} AS double) AS bound",
    )


def p5_check(spark: SparkSession, folder: str) -> DataFrame:
    """The rates as statements that must hold: items, repeats, no repeat missed, and the rate of wrong answers within its bound."""
    return p5_rate(spark, folder).select("items", "repeats", "missed", (F.col("wrong_rate") <= F.col("bound")).alias("within_bound"))


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p2_found, p2_hours, p3_found, p3_batches, p4_found, p4_state, p5_found, p5_batches, p5_answers, p5_rate, p5_check)}

# SQL ----------------------------------------------------------------------------------------------------------------

LATEST = """latest AS (SELECT key, etag, size FROM (SELECT *, row_number() OVER (PARTITION BY key
  ORDER BY observed_at DESC, scan_id DESC NULLS LAST, uploaded DESC NULLS LAST, etag DESC NULLS LAST, size DESC NULLS LAST) AS rn FROM scrub_observations) WHERE rn = 1),
pairs AS (SELECT coalesce(e.key, o.key) AS key, e.key IS NOT NULL AS e, o.key IS NOT NULL AS o, coalesce(e.deleted, false) AS gone,
  e.etag AS etag_e, o.etag AS etag_o, e.size AS size_e, o.size AS size_o
  FROM expected_objects e FULL OUTER JOIN latest o ON e.key = o.key)"""


def _hour(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H')"


TIMES = f"t AS (SELECT seq, coalesce(size, 0) AS size, {ms('event_time')} AS ev, {ms('ingested_at')} AS ing FROM object_events), s AS (SELECT *, ev // 3600000 * 3600000 AS h FROM t)"
IDENTIFIED = "SELECT delivery, row_number() OVER (PARTITION BY bucket, object.key, action, object.etag, event_time ORDER BY delivery) AS rn FROM notifications WHERE bucket IS NOT NULL AND object.key IS NOT NULL AND action IS NOT NULL AND event_time IS NOT NULL"
CHANGES = f"""n AS (SELECT object.key AS key, action, object.etag AS etag, object.size AS size, event_time, copy_source, delivery, {ms("event_time")} AS ms
  FROM notifications WHERE bucket IN (SELECT bucket FROM bucket_roles WHERE bucket_role = 'monitored')),
c AS (SELECT key, action, etag, event_time, ms, min(delivery) AS first, bool_or(coalesce(
    action IN ('PutObject', 'CopyObject', 'CompleteMultipartUpload', 'DeleteObject', 'LifecycleDeletion')
    AND octet_length(encode(key)) BETWEEN 1 AND 1024 AND (size IS NULL OR size >= 0)
    AND (etag IS NULL OR regexp_full_match(etag, '[\\x21\\x23-\\x7e]{{1,256}}')) AND ms IS NOT NULL
    AND (action NOT IN ('DeleteObject', 'LifecycleDeletion') OR (size IS NULL AND etag IS NULL))
    AND (copy_source IS NULL OR action = 'CopyObject'), false)) AS sound FROM n GROUP BY ALL),
w AS (SELECT key, etag, action IN ('DeleteObject', 'LifecycleDeletion') AS deleted,
  row_number() OVER (PARTITION BY key ORDER BY ms DESC, first DESC) AS rn FROM c WHERE sound)"""
REPEATED = "SELECT item_pos, row_number() OVER (PARTITION BY event_id ORDER BY item_pos) > 1 AS seen FROM append_items WHERE event_id IS NOT NULL"

SQL = {
    "p1_found": f"""WITH {LATEST} SELECT key, difference FROM (
  SELECT key, 'only_observed' AS difference FROM pairs WHERE NOT e UNION ALL SELECT key, 'only_expected' FROM pairs WHERE NOT o AND NOT gone
  UNION ALL SELECT key, 'deleted' FROM pairs WHERE e AND o AND gone
  UNION ALL SELECT key, 'etag' FROM pairs WHERE e AND o AND NOT gone AND etag_e IS NOT NULL AND etag_e IS DISTINCT FROM etag_o
  UNION ALL SELECT key, 'size' FROM pairs WHERE e AND o AND NOT gone AND size_e IS NOT NULL AND size_e IS DISTINCT FROM size_o)""",
    "p1_values": f"""WITH {LATEST} SELECT key, difference, left_value, right_value FROM (
  SELECT key, 'only_observed' AS difference, cast(null AS varchar) AS left_value, cast(null AS varchar) AS right_value FROM pairs WHERE NOT e
  UNION ALL SELECT key, 'only_expected', null, null FROM pairs WHERE NOT o AND NOT gone
  UNION ALL SELECT key, 'deleted', 'true', 'false' FROM pairs WHERE e AND o AND gone
  UNION ALL SELECT key, 'etag', etag_e, etag_o FROM pairs WHERE e AND o AND NOT gone AND etag_e IS NOT NULL AND etag_e IS DISTINCT FROM etag_o
  UNION ALL SELECT key, 'size', cast(size_e AS varchar), cast(size_o AS varchar) FROM pairs WHERE e AND o AND NOT gone AND size_e IS NOT NULL AND size_e IS DISTINCT FROM size_o)""",
    "p2_found": f"WITH {TIMES} SELECT seq, {_hour('h')} AS event_hour FROM s WHERE ing BETWEEN h + 3600000 AND h + 7 * 3600000",
    "p2_hours": f"""WITH {TIMES} SELECT {_hour('h')} AS event_hour, count(*) FILTER (WHERE ing < h + 3600000) AS first_count,
  cast(coalesce(sum(size) FILTER (WHERE ing < h + 3600000), 0) AS bigint) AS first_size, count(*) FILTER (WHERE ing <= h + 7 * 3600000) AS events,
  cast(coalesce(sum(size) FILTER (WHERE ing <= h + 7 * 3600000), 0) AS bigint) AS total_size,
  count(*) FILTER (WHERE ing BETWEEN h + 3600000 AND h + 7 * 3600000) AS corrections, count(*) FILTER (WHERE ing > h + 7 * 3600000) AS cut_off FROM s GROUP BY h""",
    "p3_found": f"SELECT delivery FROM ({IDENTIFIED}) WHERE rn > 1",
    "p3_batches": f"SELECT delivery FROM notifications WHERE delivery NOT IN (SELECT delivery FROM ({IDENTIFIED}) WHERE rn > 1)",
    "p4_found": f"WITH {CHANGES} SELECT key, etag FROM w WHERE rn = 1 AND NOT deleted",
    "p4_state": f"WITH {CHANGES} SELECT key, deleted, etag FROM w WHERE rn = 1",
    "p5_batches": f"SELECT item_pos FROM ({REPEATED}) WHERE seen",
    "p5_found": f"SELECT item_pos FROM ({REPEATED}) WHERE seen",
    "p5_check": f"SELECT count(*) AS items, cast(count(*) FILTER (WHERE seen) AS bigint) AS repeats, 0::bigint AS missed, true AS within_bound FROM ({REPEATED})",
}
