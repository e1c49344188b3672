"""Queries over the feed, the log and the expected state, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.rfc3339 import epoch_ms, iso_ms
from auditlake.functions.text import base64, event_id, hmac_sha256_hex, json_string, strict_base64, strict_hex
from auditlake.operators.dedupe import keep_first
from auditlake.operators.entries import append_problems, observation_problem, parsed, validity
from auditlake.operators.sequencing import window_dedupe
from auditlake.sources import views as v
from auditlake.sources.tables import table

TTL_MS = 24 * 3_600_000
KEY = "ops/heartbeat/latest.json"
BLIND = bytes(range(32))


def classify_feed(spark: SparkSession, folder: str) -> DataFrame:
    return v.classified(spark, folder).select("delivery", "class", "reason")


def ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    return v.classified(spark, folder).groupBy("queue", "class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("attempt") > 1, 1).otherwise(0)).alias("redelivered"))


def _event_ids(spark: SparkSession, folder: str) -> DataFrame:
    events = v.classified(spark, folder).filter("class = 'event'")
    return events.select("delivery", event_id(*map(F.col, ("bucket", "key", "action", "etag", "event_time"))).alias("event_id"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', received_at)").alias("t"))


def event_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _event_ids(spark, folder).select("delivery", "event_id")


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    return keep_first(_event_ids(spark, folder).select("event_id", "delivery"), [F.col("delivery")], "event_id")


def dedupe_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_ids(spark, folder)
    return window_dedupe(rows, F.col("event_id"), F.col("t"), F.col("delivery"), TTL_MS).select(F.col("row").alias("delivery"), "accepted")


def sequence_log(spark: SparkSession, folder: str) -> DataFrame:
    return v.entry_log(spark, folder).select("seq", "item_pos", "event_id")


#: Numbers taken out of the log of object events, and how entries are altered by position before they are judged: what is replaced, by what,
#: and the rule that is then broken (none: the entry is of no known type or version).
TAKEN = "seq % 1000 BETWEEN 5 AND 7"
ALTERED = (
    ('"v":1', '"v":2', None), ('"type":"object.event"', '"type":"object.evens"', None), ('"bucket":"', '"bucket":"A', "bucket"), ('"eventTime":"', '"eventTime":"x', "eventTime"), ('"ingestedAt":"2', '"ingestedAt":"X', "ingestedAt"),
    ('"action":"', '"action":"x', "action"), ('"v":1', '"v": 1', "not canonical"), ('"v":1', '"v":1,"w":2', "not canonical"), ('"v":1', '"sha256":"","v":1', "not canonical"),
)


def seq_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers missing from a log of object events (some were taken out): the first and last of each gap.

    A gap inside a block of numbers is found by the rank within the block; one across blocks by the blocks' ends.
    """
    block = 65_536
    s = table(spark, folder, "object_events").filter(f"NOT ({TAKEN})").select("seq").distinct().withColumn("b", F.expr(f"seq div {block}"))
    inner = s.withColumn("p", F.lag("seq").over(Window.partitionBy("b").orderBy("seq"))).filter("seq - p > 1").selectExpr("p + 1 AS gap_from", "seq - 1 AS gap_to")
    ends = s.groupBy("b").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).withColumn("p", F.lag("hi", 1, -1).over(Window.orderBy("b")))
    return inner.unionByName(ends.filter("lo - p > 1").selectExpr("p + 1 AS gap_from", "lo - 1 AS gap_to"))


def retry_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds until a delivery of each attempt would be retried: doubling from 10, at most 300."""
    attempts = table(spark, folder, "notifications").groupBy("attempt").agg(F.count(F.lit(1)).alias("n"))
    delay = F.least(F.lit(300), 10 * F.pow(F.lit(2), F.least(F.greatest(F.col("attempt"), F.lit(1)) - 1, F.lit(5)))).cast("int")
    return attempts.select("attempt", "n", delay.alias("delay_s"))


def ts_validation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "notifications").select("delivery", epoch_ms(F.col("event_time")).isNotNull().alias("valid"))


def event_ms(spark: SparkSession, folder: str) -> DataFrame:
    e = v.object_log(spark, folder)
    return e.select("seq", "event_ms", iso_ms(F.col("event_ms")).alias("event_iso"))


def entry_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Every offered entry judged; most were altered in one place, by their position (``ALTERED``)."""
    items = table(spark, folder, "append_items").select("item_pos", "entry")
    text = F.col("entry").cast("string")
    for i, (old, new, _) in enumerate(ALTERED):
        text = F.when(F.col("item_pos") % (len(ALTERED) + 3) == i, F.replace(F.col("entry").cast("string"), F.lit(old), F.lit(new))).otherwise(text)
    return validity(items.withColumn("entry", F.encode(text, "UTF-8"))).select("item_pos", "known", "problem")


def entry_projection(spark: SparkSession, folder: str) -> DataFrame:
    e = parsed(table(spark, folder, "append_items")).select("item_pos", "e.*")
    return e.select(
        "item_pos", "type", F.coalesce("keyHmac", "key").alias("name"), "action", "etag", "size", "eventTime",
        F.coalesce(F.col("action").isin("DeleteObject", "LifecycleDeletion"), F.lit(False)).alias("is_delete"),
        F.coalesce(F.col("type").isin("object.event", "object.snapshot"), F.lit(False)).alias("is_object"),
    )


def entry_view(spark: SparkSession, folder: str) -> DataFrame:
    """One line of text per log entry."""
    e = parsed(v.entry_log(spark, folder)).select("seq", "e.*")
    return e.select("seq", F.concat_ws(" ", "type", "action", F.coalesce("keyHmac", "key"), F.concat(F.lit("at "), F.col("eventTime"))).alias("line"))


def canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    return v.object_log(spark, folder).filter("key IS NOT NULL").select("seq", json_string(F.col("key")).alias("json"))


def hex_base64(spark: SparkSession, folder: str) -> DataFrame:
    """Both codecs there and back, and whether capital hex and base64 without padding are taken: only where they make no difference."""
    e = v.object_log(spark, folder).filter("key IS NOT NULL")
    raw = F.encode("key", "UTF-8")
    hexed, based = F.lower(F.hex(raw)), base64(raw)
    return e.select(
        "seq", hexed.alias("hex"), based.alias("base64"), ((strict_hex(hexed) == raw) & (strict_base64(based) == raw)).alias("back"),
        strict_hex(F.upper(hexed)).isNotNull().alias("upper_back"), strict_base64(F.rtrim(based, F.lit("="))).isNotNull().alias("bare_back"),
    )


def blinded_names(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed hashes of object names, and whether an entry is named in exactly one way."""
    e = v.object_log(spark, folder)
    return e.select("seq", hmac_sha256_hex(BLIND, F.col("key")).alias("blinded"), (F.col("key").isNull() != F.col("key_hmac").isNull()).alias("named_once"))


def entries_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of one object in a log half of whose names are blinded: its key as it is, or its keyed hash."""
    e = v.object_log(spark, folder).filter("key IS NOT NULL")
    hidden = F.col("seq") % 2 == 1
    names = e.select("seq", F.when(~hidden, F.col("key")).alias("key"), F.when(hidden, hmac_sha256_hex(BLIND, F.col("key"))).alias("key_hmac"))
    return names.filter((F.col("key") == KEY) | (F.col("key_hmac") == hmac_sha256_hex(BLIND, F.lit(KEY)))).select("seq", F.col("key").isNull().alias("blinded"))


def append_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Items offered in batches of a hundred, each taken whole or not at all: one bad item refuses its batch."""
    return append_problems(table(spark, folder, "append_items").withColumn("batch", F.expr("item_pos div 100")), "batch")


def listing_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Observations judged before they are used, by the first rule they break; some were altered, by their time."""
    o, turn = table(spark, folder, "scrub_observations"), F.col("observed_at") % 13
    alter = lambda c, i, bad: F.when(turn == i, bad).otherwise(F.col(c)).alias(c)
    rows = o.select(
        alter("key", 1, F.lit("")), alter("etag", 2, F.concat("etag", F.lit(" "))), alter("size", 3, F.lit(-1).cast("long")), alter("uploaded", 4, F.lit(2**53).cast("long")), alter("sha256", 5, F.upper("sha256")), alter("stored_sha256", 6, F.lit("ab")),
    )
    return rows.select(observation_problem().alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# State --------------------------------------------------------------------------------------------------------------


def expected_state(spark: SparkSession, folder: str) -> DataFrame:
    return v.expected_state(v.object_log(spark, folder))


def state_with_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Latest state per name where snapshots of listed objects the log did not know count as writes at their time of upload."""
    log = v.object_log(spark, folder)
    known = log.filter("key IS NOT NULL").select("key").distinct()
    new = v.listing(spark, folder).join(known, "key", "left_anti")
    size = log.agg(F.max("seq")).first()[0] or 0
    snapshots = new.select(F.col("key").alias("name"), "etag", "size", F.col("uploaded").alias("event_ms"), F.lit(size + 1).cast("long").alias("seq"), F.lit(False).alias("deleted"))
    return v.expected_state(log.select("name", "etag", "size", "event_ms", "seq", "deleted").unionByName(snapshots))


def object_state(spark: SparkSession, folder: str) -> DataFrame:
    return v.expected_state(v.object_log(spark, folder).filter(F.col("name") == KEY))


def object_states_range(spark: SparkSession, folder: str, after: str = "d", through: str = "m", limit: int = 100) -> DataFrame:
    """Live states of names in (after, through], the first ``limit`` in byte order: a page."""
    page = table(spark, folder, "expected_objects").filter((F.col("key") > after) & (F.col("key") <= through) & ~F.col("deleted"))
    return page.orderBy("key").limit(limit).select("key", "etag", "size", "seq")


def live_objects(spark: SparkSession, folder: str) -> DataFrame:
    return expected_state(spark, folder).filter("NOT deleted").select("name", "etag", "size", "seq")


def key_history(spark: SparkSession, folder: str, after: int = -1, limit: int = 1000) -> DataFrame:
    """A page of one object's entries in log order, with ``next``: where the following page starts, null on the last."""
    rows = v.object_log(spark, folder).filter((F.col("name") == KEY) & (F.col("seq") > after))
    page = rows.orderBy("seq").limit(limit + 1).select("seq", "action", "etag", "event_time")  # looks one row ahead
    numbered = page.withColumn("n", F.row_number().over(Window.orderBy("seq"))).withColumn("more", F.max("n").over(Window.partitionBy()) > limit)
    last = F.max(F.when(F.col("n") <= limit, F.col("seq"))).over(Window.partitionBy())
    return numbered.withColumn("next", F.when(F.col("more"), last)).filter(F.col("n") <= limit).drop("n", "more")


def key_history_budget(spark: SparkSession, folder: str, bundles: int = 32) -> DataFrame:
    """One object's entries as far as ``bundles`` different bundles of 256 entries hold them."""
    rows = v.object_log(spark, folder).filter(F.col("name") == KEY).select("seq", "action", F.expr("seq div 256").alias("bundle"))
    first = rows.select("bundle").distinct().orderBy("bundle").limit(bundles)
    return rows.join(first, "bundle", "left_semi")


def entry_range(spark: SparkSession, folder: str, low: int = 100, high: int = 600) -> DataFrame:
    """Entries [low, high) of the log; ``complete`` tells whether every number is there."""
    rows = v.entry_log(spark, folder).filter((F.col("seq") >= low) & (F.col("seq") < high))
    return rows.select("seq", "event_id", (F.count(F.lit(1)).over(Window.partitionBy()) == high - low).alias("complete"))


def recent_entries(spark: SparkSession, folder: str, count: int = 50) -> DataFrame:
    return v.object_log(spark, folder).orderBy(F.desc("seq")).limit(count).select("seq", "name", "action")


def log_status(spark: SparkSession, folder: str) -> DataFrame:
    """Entries, next number, and what is published and pending if every minute of ingestion but the last, unfinished one is published."""
    e = v.object_log(spark, folder).select("seq", F.expr("ingested_ms div 60000").alias("minute"))
    per = e.groupBy("minute").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))  # a row per minute
    last = per.agg(F.sum("n").alias("entries"), (F.max("seq") + 1).alias("next_seq"), F.max_by("n", "minute").alias("pending"))
    return last.select("entries", "next_seq", (F.col("entries") - F.col("pending")).alias("published"), "pending")


QUERIES = {
    "classify_feed": classify_feed, "ingest_counters": ingest_counters, "event_id": event_ids, "dedupe_first": dedupe_first, "dedupe_window": dedupe_window, "sequence_log": sequence_log, "seq_gaps": seq_gaps,
    "retry_backoff": retry_backoff, "ts_validation": ts_validation, "event_ms": event_ms, "entry_validation": entry_validation, "entry_projection": entry_projection, "entry_view": entry_view,
    "canonical_json": canonical_keys, "hex_base64": hex_base64, "blinded_names": blinded_names, "expected_state": expected_state, "object_state": object_state, "object_states_range": object_states_range,
    "live_objects": live_objects, "entries_by_name": entries_by_name, "append_batches": append_batches, "listing_validation": listing_validation, "state_with_snapshots": state_with_snapshots, "key_history": key_history, "key_history_budget": key_history_budget, "entry_range": entry_range, "recent_entries": recent_entries, "log_status": log_status,
}

_ID = "sha256(to_json([bucket, key, action, etag, event_time]))"
_ISO = "strftime(make_timestamp(event_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_IPAD = bytes(b ^ 0x36 for b in BLIND.ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in BLIND.ljust(64, b"\0")).hex()
_JSON = "CAST(decode(entry) AS json)"
_PARSED = f"p AS (SELECT *, {_JSON} AS j FROM {{}})"

SQL = {
    "classify_feed": f"WITH {v.CLASSIFIED} SELECT delivery, class, reason FROM classified",
    "ingest_counters": f"WITH {v.CLASSIFIED} SELECT queue, class, count(*) AS n, count(*) FILTER (WHERE attempt > 1) AS redelivered FROM classified GROUP BY ALL",
    "event_id": f"WITH {v.CLASSIFIED} SELECT delivery, {_ID} AS event_id FROM classified WHERE class = 'event'",
    "dedupe_first": f"WITH {v.CLASSIFIED} SELECT event_id, min(delivery) AS delivery FROM (SELECT delivery, {_ID} AS event_id FROM classified WHERE class = 'event') GROUP BY event_id",
    "dedupe_window": f"""WITH RECURSIVE {v.CLASSIFIED}, r AS (SELECT delivery, event_id, t, row_number() OVER (PARTITION BY event_id ORDER BY t, delivery) AS rn FROM
  (SELECT delivery, {_ID} AS event_id, epoch_us(received_at) // 1000 AS t FROM classified WHERE class = 'event')),
  f AS (SELECT delivery, event_id, rn, t AS last, true AS accepted FROM r WHERE rn = 1 UNION ALL
  SELECT r.delivery, r.event_id, r.rn, CASE WHEN f.last + {TTL_MS} <= r.t THEN r.t ELSE f.last END, f.last + {TTL_MS} <= r.t FROM f JOIN r ON r.event_id = f.event_id AND r.rn = f.rn + 1)
  SELECT delivery, accepted FROM f""",
    "sequence_log": f"WITH {v.ENTRY_LOG} SELECT seq, item_pos, event_id FROM entry_log",
    "seq_gaps": "SELECT p + 1 AS gap_from, seq - 1 AS gap_to FROM (SELECT seq, lag(seq, 1, -1) OVER (ORDER BY seq) AS p FROM (SELECT DISTINCT seq FROM object_events WHERE NOT (" + TAKEN + "))) WHERE seq - p > 1",
    "retry_backoff": "SELECT attempt, count(*) AS n, cast(least(300, 10 * pow(2, least(greatest(attempt, 1) - 1, 5))) AS integer) AS delay_s FROM notifications GROUP BY attempt",
    "ts_validation": f"SELECT delivery, {v.ms('event_time')} IS NOT NULL AS valid FROM notifications",
    "event_ms": f"WITH {v.OBJECT_LOG} SELECT seq, event_ms, {_ISO} AS event_iso FROM object_log",
    "entry_validation": f"SELECT item_pos, coalesce(known, true) AS known, problem FROM append_items LEFT JOIN (VALUES {', '.join('(%d, %s, %s)' % (i, 'false' if x[2] is None else 'true', 'cast(null AS varchar)' if x[2] is None else repr(x[2])) for i, x in enumerate(ALTERED))}) a(i, known, problem) ON a.i = item_pos % {len(ALTERED) + 3}",
    "entry_projection": f"""WITH {_PARSED.format('append_items')} SELECT item_pos, j->>'type' AS type, coalesce(j->>'keyHmac', j->>'key') AS name, j->>'action' AS action, j->>'etag' AS etag, cast(j->>'size' AS bigint) AS size,
  j->>'eventTime' AS "eventTime", coalesce((j->>'action') IN {v.DELETES}, false) AS is_delete, coalesce((j->>'type') IN ('object.event', 'object.snapshot'), false) AS is_object FROM p""",
    "entry_view": f"WITH {v.ENTRY_LOG}, {_PARSED.format('entry_log')} SELECT seq, concat_ws(' ', j->>'type', j->>'action', coalesce(j->>'keyHmac', j->>'key'), 'at ' || (j->>'eventTime')) AS line FROM p",
    "canonical_json": f"WITH {v.OBJECT_LOG} SELECT seq, cast(to_json(key) AS varchar) AS json FROM object_log WHERE key IS NOT NULL",
    "hex_base64": f"WITH {v.OBJECT_LOG} SELECT seq, lower(hex(encode(key))) AS hex, base64(encode(key)) AS base64, true AS back, NOT regexp_matches(lower(hex(encode(key))), '[a-f]') AS upper_back, NOT ends_with(base64(encode(key)), '=') AS bare_back FROM object_log WHERE key IS NOT NULL",
    "blinded_names": f"WITH {v.OBJECT_LOG} SELECT seq, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(key)))) AS blinded, (key IS NULL) <> (key_hmac IS NULL) AS named_once FROM object_log",
    "expected_state": f"WITH {v.STATE} SELECT * FROM state",
    "object_state": f"WITH {v.STATE} SELECT * FROM state WHERE name = '{KEY}'",
    "object_states_range": "SELECT key, etag, size, seq FROM expected_objects WHERE key > 'd' AND key <= 'm' AND NOT deleted ORDER BY key LIMIT 100",
    "live_objects": f"WITH {v.STATE} SELECT name, etag, size, seq FROM state WHERE NOT deleted",
    "key_history": f"""WITH {v.OBJECT_LOG}, h AS (SELECT seq, action, etag, event_time, row_number() OVER (ORDER BY seq) AS n FROM object_log WHERE name = '{KEY}')
  SELECT seq, action, etag, event_time, CASE WHEN (SELECT count(*) FROM h) > 1000 THEN (SELECT seq FROM h WHERE n = 1000) END AS next FROM h WHERE n <= 1000""",
    "key_history_budget": f"WITH {v.OBJECT_LOG} SELECT bundle, seq, action FROM (SELECT seq, action, seq // 256 AS bundle, dense_rank() OVER (ORDER BY seq // 256) AS d FROM object_log WHERE name = '{KEY}') WHERE d <= 32",
    "entry_range": f"WITH {v.ENTRY_LOG} SELECT seq, event_id, count(*) OVER () = 500 AS complete FROM entry_log WHERE seq >= 100 AND seq < 600",
    "recent_entries": f"WITH {v.OBJECT_LOG} SELECT seq, name, action FROM object_log ORDER BY seq DESC LIMIT 50",
    "log_status": f"WITH {v.OBJECT_LOG}, last AS (SELECT max(ingested_ms // 60000) AS m FROM object_log) SELECT count(*) AS entries, max(seq) + 1 AS next_seq, count(*) FILTER (WHERE ingested_ms // 60000 < m) AS published, count(*) FILTER (WHERE ingested_ms // 60000 = m) AS pending FROM object_log, last",
    "entries_by_name": f"WITH {v.OBJECT_LOG} SELECT seq, seq % 2 = 1 AS blinded FROM object_log WHERE key = '{KEY}'",
    "append_batches": """SELECT item_pos // 100 AS batch, count(*) AS items, count(*) FILTER (WHERE event_id IS NULL OR NOT regexp_full_match(event_id, '[0-9a-f]{64}')) AS bad,
  count(*) FILTER (WHERE event_id IS NULL OR NOT regexp_full_match(event_id, '[0-9a-f]{64}')) = 0 AS accepted FROM append_items GROUP BY 1""",
    "listing_validation": """SELECT problem, count(*) AS n FROM (SELECT CASE observed_at % 13 WHEN 1 THEN 'key' WHEN 2 THEN 'etag' WHEN 3 THEN 'size' WHEN 4 THEN 'uploaded' WHEN 5 THEN CASE WHEN regexp_matches(sha256, '[a-f]') THEN 'sha256' END WHEN 6 THEN 'stored_sha256' END AS problem
  FROM scrub_observations) GROUP BY problem""",
    "state_with_snapshots": f"""WITH {v.OBJECT_LOG}, {v.LISTING}, every AS (SELECT name, etag, size, event_ms, seq, deleted FROM object_log UNION ALL
  SELECT key, etag, size, uploaded, (SELECT max(seq) + 1 FROM object_log), false FROM listing WHERE key NOT IN (SELECT key FROM object_log WHERE key IS NOT NULL))
  SELECT name, etag, size, event_ms, seq, deleted FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_ms DESC, seq DESC) AS rn FROM every) WHERE rn = 1""",
}
