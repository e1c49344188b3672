"""Queries of the audit and of monitoring, and their SQL."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.errors import NotVerifiable
from auditlake.functions.text import json_object, json_string, sampled
from auditlake.operators import audit as a
from auditlake.operators.ranges import interval_join, nearest_rank
from auditlake.operators.sequencing import number_by_text
from auditlake.sources import views as v
from auditlake.sources.tables import table

PREFIX, SCAN, RATE, PAGE, PER_PAGE = "legal/", "scan-2026-05-06", 0.2, 1000, 20
REPORT, BATCH, INTERVAL_MS = 10_000, 500, 5000
#: Scans that are kept, and the largest object that is scrubbed.
KEEP_SCANS, SCRUB_BYTES = 50, 104_857_600


def _state(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "expected_objects")
    return e.select("key", "etag", "size", v.epoch_ms(F.col("event_time")).alias("event_ms"), "seq", "deleted")


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    return a.reconcile(v.listing(spark, folder), _state(spark, folder), v.clock(spark, folder), v.GRACE_MS)


def reconcile_findings(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder)


def findings_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def reconcile_page(spark: SparkSession, folder: str) -> DataFrame:
    live = table(spark, folder, "expected_objects").filter("NOT deleted")
    return a.page_end(v.listing(spark, folder), live, "d", PAGE)


def listing_page(spark: SparkSession, folder: str) -> DataFrame:
    return v.listing(spark, folder).filter(F.col("key") > "m").orderBy("key").limit(PAGE).select("key", "etag", "size", "uploaded")


def order_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of the log at which event times go backwards."""
    return a.order_violations(v.object_log(spark, folder).select("seq", F.lpad(F.col("event_ms").cast("string"), 16, "0").alias("t")), "seq", "t").select(F.col("pos").alias("seq"), "prev", F.col("key").alias("t"))


def _half(spark: SparkSession, folder: str) -> int:
    return (table(spark, folder, "object_events").agg(F.max("seq")).first()[0] or 0) // 2


def _candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Findings against the state as of half the log, and the state of all of it."""
    log = v.object_log(spark, folder).filter("key_hmac IS NULL")
    early, late = (v.expected_state(x).withColumnRenamed("name", "key") for x in (log.filter(F.col("seq") <= _half(spark, folder)), log))
    return a.reconcile(v.listing(spark, folder), early, v.clock(spark, folder), v.GRACE_MS), late


def confirm_findings(spark: SparkSession, folder: str) -> DataFrame:
    found, state = _candidates(spark, folder)
    return a.confirm(found, state).select("key", "kind", "basis_seq")


def due_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates observed long enough ago to be judged again: the oldest observations first, a page of them."""
    found = _findings(spark, folder).join(v.listing(spark, folder).select("key", "observed_at"), "key")
    due = found.filter(F.col("observed_at") <= v.clock(spark, folder) - v.GRACE_MS)
    return due.orderBy("observed_at", "key").limit(PAGE).select("key", "kind", "observed_at")


def backfill_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Listed objects the log has no state of, live or deleted."""
    return v.listing(spark, folder).join(table(spark, folder, "expected_objects").select("key"), "key", "left_anti").select("key", "etag", "size", "uploaded")


def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return v.listing(spark, folder).filter(sampled(F.lit(SCAN), F.col("key"), RATE)).select("key")


def scrub_sample(spark: SparkSession, folder: str, max_bytes: int = SCRUB_BYTES) -> DataFrame:
    """Of each page of the listing, in key order, the first objects that are sampled and no larger than ``max_bytes``."""
    pages = number_by_text(v.listing(spark, folder).select("key", "size"), "key", "pos").withColumn("page", F.expr(f"pos div {PAGE}"))
    chosen = pages.filter((F.col("size") <= max_bytes) & sampled(F.lit(SCAN), F.col("key"), RATE))
    n = F.row_number().over(Window.partitionBy("page").orderBy("key"))
    return chosen.withColumn("n", n).filter(F.col("n") <= PER_PAGE).select("page", "key")


def scrub_sha256(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.octet_length("text").alias("bytes"))


def content_drift(spark: SparkSession, folder: str) -> DataFrame:
    return a.drift(table(spark, folder, "scrub_observations"), [F.col("observed_at"), F.col("scan_id"), F.col("sha256"), F.col("stored_sha256")])


def scan_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind: candidates that wait, the oldest observation, and how long until the grace of the oldest is over."""
    found = _findings(spark, folder).join(v.listing(spark, folder).select("key", "observed_at"), "key", "left")
    wait = F.greatest(F.lit(0), F.min("observed_at") + v.GRACE_MS - v.clock(spark, folder))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("waiting"), F.min("observed_at").alias("oldest"), F.coalesce(wait, F.lit(0)).cast("long").alias("wait_ms"))


def scan_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per scan: rows, objects, bytes, times, and the drift it found."""
    o = table(spark, folder, "scrub_observations")
    seen = o.groupBy("scan_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("objects"), F.sum("size").alias("bytes"), F.min("observed_at").alias("started_at"), F.max("observed_at").alias("ended_at"))
    found = content_drift(spark, folder).groupBy("scan_id").agg(F.count(F.lit(1)).alias("drift"))
    return seen.join(found, "scan_id", "left").withColumn("drift", F.coalesce("drift", F.lit(0)))


def scan_report(spark: SparkSession, folder: str) -> DataFrame:
    """The first findings by key, as a report lists them, and whether there are more."""
    found = _findings(spark, folder)
    total = found.count()
    return found.orderBy("key", "kind").limit(REPORT).select("key", "kind", F.lit(total > REPORT).alias("truncated"))


def findings_page(spark: SparkSession, folder: str, after: str = "d", limit: int = 100) -> DataFrame:
    """A page of findings behind a key, with ``next``: where the following page starts, null on the last."""
    page = _findings(spark, folder).filter(F.col("key") > after).orderBy("key", "kind").limit(limit + 1).select("key", "kind")
    n = page.withColumn("n", F.row_number().over(Window.orderBy("key", "kind"))).withColumn("more", F.max("n").over(Window.partitionBy()) > limit)
    last = F.max(F.when(F.col("n") <= limit, F.col("key"))).over(Window.partitionBy())
    return n.withColumn("next", F.when(F.col("more"), last)).filter(F.col("n") <= limit).drop("n", "more")


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scrub_observations").groupBy("scan_id").agg(F.min("observed_at").alias("started_at"))


def latest_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).orderBy(F.desc("started_at"), F.desc("scan_id")).limit(1)


def retained_scans(spark: SparkSession, folder: str, keep: int = KEEP_SCANS) -> DataFrame:
    """The newest scans. The observations tell no unfinished scan from a finished one: all count as finished."""
    return _scans(spark, folder).orderBy(F.desc("started_at"), F.desc("scan_id")).limit(keep)


def retained_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Drift findings of the latest scan; those of older scans are dropped."""
    return content_drift(spark, folder).join(latest_scan(spark, folder).select("scan_id"), "scan_id", "left_semi").select("key", "scan_id", "against")


#: What is wrong with the index of findings: every seventh finding of a scan is left out, and every third scan lists its end entry as one.
LEFT_OUT, MISLISTED = "local % 7 = 3", "scan % 3 = 1"


def audit_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans, an index of their findings, and the log's audit entries, made from the drift the scans found.

    A scan's start entry is followed by its findings in order of key and its end entry, which states their number.
    """
    found = content_drift(spark, folder).groupBy("scan_id", "key", "against").agg(F.count(F.lit(1)).alias("n"))
    found = found.withColumn("local", F.row_number().over(Window.partitionBy("scan_id").orderBy("key", "against")) - 1)
    counts = _scans(spark, folder).join(found.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")), "scan_id", "left").select("scan_id", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.orderBy("scan_id")  # a row per scan
    scans = counts.select("scan_id", "n", (F.row_number().over(w) - 1).alias("scan"), F.coalesce(F.sum(F.col("n") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_seq"))
    scans = scans.withColumn("end_seq", F.col("start_seq") + F.col("n") + 1)
    text = lambda **fields: F.encode(json_object({"v": F.lit("1"), **fields}), "UTF-8")
    mark = lambda phase, **more: text(type=json_string(F.lit("audit.scan")), scanId=json_string(F.col("scan_id")), phase=json_string(F.lit(phase)), **more)
    placed = found.join(scans.select("scan_id", "scan", "start_seq", "end_seq"), "scan_id")
    finding = text(type=json_string(F.lit("audit.finding")), scanId=json_string(F.col("scan_id")), kind=json_string(F.lit("CONTENT_DRIFT")), key=json_string(F.col("key")))
    log = scans.select(F.col("start_seq").alias("seq"), mark("start").alias("entry")).unionByName(scans.select(F.col("end_seq").alias("seq"), mark("end", findings=F.col("n").cast("string")).alias("entry")))
    log = log.unionByName(placed.select((F.col("start_seq") + 1 + F.col("local")).alias("seq"), finding.alias("entry")))
    index = placed.filter(f"NOT ({LEFT_OUT})").select("scan_id", (F.col("start_seq") + 1 + F.col("local")).alias("seq"))
    return scans.select("scan_id", "start_seq", "end_seq"), index.unionByName(scans.filter(MISLISTED).select("scan_id", F.col("end_seq").alias("seq"))), log


def verify_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Per scan: whether its index of findings agrees with the log's entries. Some indexes omit findings, or list what is none."""
    return a.verify_index(*audit_log(spark, folder))


# Monitoring ---------------------------------------------------------------------------------------------------------


def watch_blinded(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the entries whose key is blinded, which no prefix can be matched against, and all entries."""
    return v.object_log(spark, folder).agg(F.count("key_hmac").alias("blinded"), F.count(F.lit(1)).alias("entries"))


def _watched(spark: SparkSession, folder: str, strict: bool) -> DataFrame:
    """The entries under the prefix. Blinded ones may be under it too: they are reported in a warning, or refused if ``strict``."""
    seen = watch_blinded(spark, folder).first()
    if seen["blinded"]:
        message = f"{seen['blinded']} of {seen['entries']} entries have blinded keys and cannot be watched"
        if strict:
            raise NotVerifiable(message)
        warnings.warn(message, stacklevel=3)
    return v.object_log(spark, folder).filter(F.startswith("key", F.lit(PREFIX)))


def watch_alerts(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """Under a prefix, in log order: every deletion, and every write on a key that was live. Liveness follows from the entry before.

    Entries with blinded keys are not watched, so the answer is not whole where there are any: their number is in a warning
    and in ``watch_blinded``. The reference stops on the first; so does ``strict``, with NotVerifiable.
    """
    rows = _watched(spark, folder, strict)
    before = F.lag(~F.col("deleted"), 1, False).over(Window.partitionBy("key").orderBy("seq"))
    rows = rows.withColumn("live", before)
    return rows.withColumn("alert", F.when(F.col("deleted"), "delete").when(F.col("live"), "overwrite")).filter("alert IS NOT NULL").select("seq", "key", "alert")


def watch_live(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """The live keys under a prefix and their last entries; blinded keys as in ``watch_alerts``."""
    last = _watched(spark, folder, strict).groupBy("key").agg(F.max_by("deleted", "seq").alias("deleted"), F.max("seq").alias("seq"))
    return last.filter("NOT deleted").select("key", "seq")


def rollback_detect(spark: SparkSession, folder: str) -> DataFrame:
    """Observed checkpoints, per observer, that are smaller than the one before, or as large with another root."""
    e = table(spark, folder, "events")
    polls = e.select(F.col("user_id").alias("observer"), F.col("event_id").alias("poll"), F.expr("event_id div 10 - if(event_id % 97 = 0, 60, 0)").alias("size"), F.md5(F.expr("cast(event_id div 10 + if(event_id % 89 = 0, 1, 0) AS string)")).alias("root"))
    w = Window.partitionBy("observer").orderBy("poll")
    p = polls.withColumn("p_size", F.lag("size").over(w)).withColumn("p_root", F.lag("root").over(w))
    kind = F.when(F.col("size") < F.col("p_size"), "rollback").when((F.col("size") == F.col("p_size")) & (F.col("root") != F.col("p_root")), "split view")
    return p.withColumn("kind", kind).filter("kind IS NOT NULL").select("observer", "poll", "kind")


def _minutes(spark: SparkSession, folder: str) -> DataFrame:
    """Entries per minute of ingestion, one row per minute that has any: few, however large the log."""
    return v.object_log(spark, folder).groupBy(F.expr("ingested_ms div 60000").alias("minute")).agg(F.count(F.lit(1)).alias("n"), F.min("ingested_ms").alias("oldest"))


def publication_due(spark: SparkSession, folder: str) -> DataFrame:
    """When the entries of a minute are due: at once if they fill a batch, else an interval after the oldest, not before the minute is over."""
    m = _minutes(spark, folder).withColumn("now", (F.col("minute") + 1) * 60_000)
    return m.select("minute", F.when(F.col("n") >= BATCH, F.col("now")).otherwise(F.greatest("now", F.col("oldest") + INTERVAL_MS)).alias("due"))


def publication_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Per minute, with everything before published: the size to publish next, at most a batch further."""
    done = F.coalesce(F.sum("n").over(Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per minute
    return _minutes(spark, folder).withColumn("published", done).select("minute", "published", (F.col("published") + F.least("n", F.lit(BATCH))).alias("target"))


def growth_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Entries a minute over the samples of the last ten minutes, where these span ten seconds or more."""
    m = _minutes(spark, folder).withColumn("t", F.col("minute") * 60_000).withColumn("size", F.sum("n").over(Window.orderBy("minute")))
    w = Window.orderBy("t").rangeBetween(-600_000, 0)
    m = m.withColumn("t0", F.min("t").over(w)).withColumn("s0", F.min("size").over(w)).filter("t - t0 >= 10000")
    return m.select("minute", ((F.col("size") - F.col("s0")) / (F.col("t") - F.col("t0")) * 60_000).alias("per_minute"))


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Milliseconds from event to ingestion per action, by nearest rank; events ahead of their ingestion count as 0."""
    rows = v.object_log(spark, folder)
    return nearest_rank(rows, ["action"], F.greatest(F.col("ingested_ms") - F.col("event_ms"), F.lit(0)), {"median": 0.5, "p95": 0.95, "p99": 0.99})


def visibility_latency(spark: SparkSession, folder: str) -> DataFrame:
    """For each entry the first hourly poll that sees it: the log is longer than its number, and the poll is not before its ingestion.

    Polls partition the log's numbers into intervals, which are joined by cells; a poll before the ingestion (times run
    backwards in places) is replaced by the first poll at or after it.
    """
    log = v.object_log(spark, folder).select("seq", "ingested_ms")
    hours = log.groupBy(F.expr("ingested_ms div 3600000").alias("h")).agg(F.max("seq").alias("last"))
    polls = hours.select(((F.col("h") + 1) * 3_600_000).alias("poll_ms"), F.max(F.col("last") + 1).over(Window.orderBy("h")).alias("high"))
    polls = polls.withColumn("low", F.lag("high", 1, 0).over(Window.orderBy("poll_ms")))  # a row per hour
    seen = interval_join(log, "seq", polls, "low", "high", 4096)
    at = F.greatest(F.col("poll_ms"), F.ceil(F.col("ingested_ms") / 3_600_000).cast("long") * 3_600_000)
    return seen.select("seq", (at - F.col("ingested_ms")).alias("latency_ms"))


def amplification(spark: SparkSession, folder: str) -> DataFrame:
    """Per queue: deliveries, batches, different messages, and their ratios."""
    f = v.feed(spark, folder)
    ids = F.sha2(F.to_json(F.array("bucket", "key", "action", "etag", "event_time")), 256)
    g = f.withColumn("id", ids).groupBy("queue").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("batch_id").alias("batches"), F.countDistinct("id").alias("messages"))
    return g.withColumn("per_batch", F.col("deliveries") / F.col("batches")).withColumn("per_message", F.col("deliveries") / F.col("messages"))


QUERIES = {f.__name__: f for f in (
    reconcile_findings, findings_by_kind, reconcile_page, listing_page, order_violations, confirm_findings, due_candidates, backfill_snapshots, hash_sample, scrub_sample, scrub_sha256, content_drift,
    scan_progress, scan_summary, scan_report, findings_page, latest_scan, retained_scans, retained_findings, verify_findings, watch_alerts, watch_live, watch_blinded, rollback_detect, publication_due, publication_plan,
    growth_rate, latency_summary, visibility_latency, amplification,
)}


def _reconcile(state: str, name: str = "findings") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT coalesce(l.key, o.key) AS key, CASE WHEN o.key IS NULL THEN CASE WHEN l.uploaded <= now_ms - {v.GRACE_MS} THEN 'UNLOGGED_OBJECT' END
  WHEN l.key IS NULL THEN CASE WHEN NOT o.deleted AND o.event_ms <= now_ms - {v.GRACE_MS} THEN 'MISSING_OBJECT' END WHEN greatest(l.uploaded, o.event_ms) > now_ms - {v.GRACE_MS} THEN NULL
  WHEN o.deleted THEN 'PHANTOM_DELETE' WHEN o.etag <> l.etag THEN 'ETAG_MISMATCH' WHEN o.size <> l.size THEN 'SIZE_MISMATCH' END AS kind, o.seq AS basis_seq,
  l.etag AS o_etag, l.size AS o_size, o.etag AS e_etag, o.size AS e_size FROM listing l FULL OUTER JOIN ({state}) o ON l.key = o.key CROSS JOIN clock) WHERE kind IS NOT NULL)"""


_EXPECTED = f"SELECT key, etag, size, {v.ms('event_time')} AS event_ms, seq, deleted FROM expected_objects"
_FOUND = f"{v.LISTING}, {_reconcile(_EXPECTED)}"
_PICK = f"cast(('0x' || substr(sha256(to_json(['{SCAN}', key])), 1, 8)) AS bigint) / 4294967296.0 < {RATE}"
_DRIFT = """o AS (SELECT DISTINCT key, scan_id, etag, sha256, stored_sha256, observed_at FROM scrub_observations), w AS (SELECT *, lag(etag) OVER x AS p_etag, lag(sha256) OVER x AS p_sha FROM o
  WINDOW x AS (PARTITION BY key ORDER BY observed_at, scan_id, sha256, stored_sha256 NULLS FIRST)),
drift AS (SELECT key, scan_id, observed_at, 'previous' AS against, p_sha AS expected, sha256 FROM w WHERE p_etag = etag AND p_sha <> sha256 UNION ALL SELECT key, scan_id, observed_at, 'stored', stored_sha256, sha256 FROM w WHERE stored_sha256 <> sha256)"""
_SUMMARY = f"{_DRIFT}, summary AS (SELECT s.*, coalesce(d.drift, 0) AS drift FROM (SELECT scan_id, count(*) AS rows, count(DISTINCT key) AS objects, cast(sum(size) AS bigint) AS bytes, min(observed_at) AS started_at, max(observed_at) AS ended_at FROM scrub_observations GROUP BY scan_id) s LEFT JOIN (SELECT scan_id, count(*) AS drift FROM drift GROUP BY scan_id) d ON s.scan_id = d.scan_id)"
_SCANS = "scans AS (SELECT scan_id, min(observed_at) AS started_at FROM scrub_observations GROUP BY scan_id)"
_MINUTES = f"{v.OBJECT_LOG}, minutes AS (SELECT ingested_ms // 60000 AS minute, count(*) AS n, min(ingested_ms) AS oldest FROM object_log GROUP BY 1)"
_AS_OF = "SELECT name AS key, etag, size, event_ms, seq, deleted FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_ms DESC, seq DESC) AS rn FROM object_log WHERE key_hmac IS NULL AND {}) WHERE rn = 1"

SQL = {
    "reconcile_findings": f"WITH {_FOUND} SELECT * FROM findings",
    "findings_by_kind": f"WITH {_FOUND} SELECT kind, count(*) AS n FROM findings GROUP BY kind",
    "reconcile_page": f"""WITH {v.LISTING}, ends AS (SELECT (SELECT count(*) FROM listing WHERE key > 'd') AS ln, (SELECT max(key) FROM (SELECT key FROM listing WHERE key > 'd' ORDER BY key LIMIT {PAGE})) AS le,
  (SELECT count(*) FROM expected_objects WHERE NOT deleted AND key > 'd') AS en, (SELECT max(key) FROM (SELECT key FROM expected_objects WHERE NOT deleted AND key > 'd' ORDER BY key LIMIT {PAGE})) AS ee),
  e AS (SELECT least(CASE WHEN ln > {PAGE} THEN le END, CASE WHEN en > {PAGE} THEN ee END) AS page_end FROM ends)
  SELECT page_end, (SELECT count(*) FROM listing WHERE key > 'd' AND (page_end IS NULL OR key <= page_end)) AS listed, (SELECT count(*) FROM expected_objects WHERE NOT deleted AND key > 'd' AND (page_end IS NULL OR key <= page_end)) AS live FROM e""",
    "listing_page": f"WITH {v.LISTING} SELECT key, etag, size, uploaded FROM listing WHERE key > 'm' ORDER BY key LIMIT {PAGE}",
    "order_violations": f"WITH {v.OBJECT_LOG} SELECT seq, prev, t FROM (SELECT seq, lpad(cast(event_ms AS varchar), 16, '0') AS t, lag(lpad(cast(event_ms AS varchar), 16, '0')) OVER (ORDER BY seq) AS prev FROM object_log) WHERE prev >= t",
    "confirm_findings": f"""WITH {v.OBJECT_LOG}, {v.LISTING}, half AS (SELECT max(seq) // 2 AS h FROM object_events), {_reconcile(_AS_OF.format('seq <= (SELECT h FROM half)'))}, late AS ({_AS_OF.format('true')})
  SELECT f.key, f.kind, f.basis_seq FROM findings f LEFT JOIN late s ON f.key = s.key WHERE f.basis_seq IS NOT DISTINCT FROM s.seq""",
    "due_candidates": f"WITH {_FOUND} SELECT f.key, f.kind, l.observed_at FROM findings f JOIN listing l ON f.key = l.key, clock WHERE l.observed_at <= now_ms - {v.GRACE_MS} ORDER BY l.observed_at, f.key LIMIT {PAGE}",
    "backfill_snapshots": f"WITH {v.LISTING} SELECT key, etag, size, uploaded FROM listing WHERE key NOT IN (SELECT key FROM expected_objects)",
    "hash_sample": f"WITH {v.LISTING} SELECT key FROM listing WHERE {_PICK}",
    "scrub_sample": f"WITH {v.LISTING} SELECT page, key FROM (SELECT page, key, row_number() OVER (PARTITION BY page ORDER BY key) AS n FROM (SELECT key, size, (row_number() OVER (ORDER BY key) - 1) // {PAGE} AS page FROM listing) WHERE size <= {SCRUB_BYTES} AND {_PICK}) WHERE n <= {PER_PAGE}",
    "scrub_sha256": "SELECT doc_id, sha256(encode(text)) AS sha256, cast(octet_length(encode(text)) AS integer) AS bytes FROM documents",
    "content_drift": f"WITH {_DRIFT} SELECT * FROM drift",
    "scan_progress": f"WITH {_FOUND} SELECT kind, count(*) AS waiting, min(observed_at) AS oldest, coalesce(greatest(0, min(observed_at) + {v.GRACE_MS} - any_value(now_ms)), 0) AS wait_ms FROM findings f LEFT JOIN listing l ON f.key = l.key, clock GROUP BY kind",
    "scan_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
    "scan_report": f"WITH {_FOUND} SELECT key, kind, (SELECT count(*) FROM findings) > {REPORT} AS truncated FROM findings ORDER BY key, kind LIMIT {REPORT}",
    "findings_page": f"WITH {_FOUND}, p AS (SELECT key, kind, row_number() OVER (ORDER BY key, kind) AS n FROM findings WHERE key > 'd') SELECT key, kind, CASE WHEN (SELECT count(*) FROM p) > 100 THEN (SELECT key FROM p WHERE n = 100) END AS next FROM p WHERE n <= 100",
    "latest_scan": f"WITH {_SCANS} SELECT * FROM scans ORDER BY started_at DESC, scan_id DESC LIMIT 1",
    "retained_scans": f"WITH {_SCANS} SELECT * FROM scans ORDER BY started_at DESC, scan_id DESC LIMIT {KEEP_SCANS}",
    "retained_findings": f"WITH {_DRIFT}, {_SCANS} SELECT key, scan_id, against FROM drift WHERE scan_id = (SELECT scan_id FROM scans ORDER BY started_at DESC, scan_id DESC LIMIT 1)",
    "verify_findings": f"""WITH {_DRIFT}, {_SCANS}, per AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY key, against) - 1 AS local FROM (SELECT DISTINCT scan_id, key, against FROM drift)),
  n AS (SELECT s.scan_id, row_number() OVER (ORDER BY s.scan_id) - 1 AS scan, count(local) AS signed, count(local) FILTER (WHERE NOT ({LEFT_OUT})) AS proven FROM scans s LEFT JOIN per p ON p.scan_id = s.scan_id GROUP BY s.scan_id)
  SELECT scan_id, proven + wrong AS listed, proven, 0::bigint AS pending, wrong, signed, wrong = 0 AND proven = signed AS ok FROM (SELECT *, cast({MISLISTED} AS bigint) AS wrong FROM n)""",
    "watch_alerts": f"WITH {v.OBJECT_LOG} SELECT seq, key, alert FROM (SELECT seq, key, CASE WHEN deleted THEN 'delete' WHEN lag(NOT deleted, 1, false) OVER (PARTITION BY key ORDER BY seq) THEN 'overwrite' END AS alert FROM object_log WHERE starts_with(key, '{PREFIX}')) WHERE alert IS NOT NULL",
    "watch_live": f"WITH {v.OBJECT_LOG} SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM object_log WHERE starts_with(key, '{PREFIX}')) WHERE rn = 1 AND NOT deleted",
    "watch_blinded": f"WITH {v.OBJECT_LOG} SELECT count(key_hmac) AS blinded, count(*) AS entries FROM object_log",
    "rollback_detect": """WITH p AS (SELECT user_id AS observer, event_id AS poll, event_id // 10 - CASE WHEN event_id % 97 = 0 THEN 60 ELSE 0 END AS size, md5(cast(event_id // 10 + CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END AS varchar)) AS root FROM events),
  w AS (SELECT *, lag(size) OVER x AS p_size, lag(root) OVER x AS p_root FROM p WINDOW x AS (PARTITION BY observer ORDER BY poll))
  SELECT observer, poll, CASE WHEN size < p_size THEN 'rollback' ELSE 'split view' END AS kind FROM w WHERE size < p_size OR (size = p_size AND root <> p_root)""",
    "publication_due": f"WITH {_MINUTES} SELECT minute, CASE WHEN n >= {BATCH} THEN (minute + 1) * 60000 ELSE greatest((minute + 1) * 60000, oldest + {INTERVAL_MS}) END AS due FROM minutes",
    "publication_plan": f"WITH {_MINUTES} SELECT minute, published, published + least(n, {BATCH}) AS target FROM (SELECT minute, n, cast(sum(n) OVER (ORDER BY minute) - n AS bigint) AS published FROM minutes)",
    "growth_rate": f"WITH {_MINUTES}, s AS (SELECT minute, minute * 60000 AS t, sum(n) OVER (ORDER BY minute) AS size FROM minutes), w AS (SELECT *, min(t) OVER x AS t0, min(size) OVER x AS s0 FROM s WINDOW x AS (ORDER BY t RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW)) SELECT minute, cast(size - s0 AS double) / (t - t0) * 60000 AS per_minute FROM w WHERE t - t0 >= 10000",
    "latency_summary": f"WITH {v.OBJECT_LOG}, l AS (SELECT action, greatest(ingested_ms - event_ms, 0) AS x FROM object_log) SELECT action, count(*) AS n, min(x) AS min, max(x) AS max, cast(sum(x) AS double) / count(*) AS mean, quantile_disc(x, 0.5) AS median, quantile_disc(x, 0.95) AS p95, quantile_disc(x, 0.99) AS p99 FROM l GROUP BY action",
    "visibility_latency": f"""WITH {v.OBJECT_LOG}, polls AS (SELECT (h + 1) * 3600000 AS poll_ms, max(last + 1) OVER (ORDER BY h) AS size FROM (SELECT ingested_ms // 3600000 AS h, max(seq) AS last FROM object_log GROUP BY 1)),
  first AS (SELECT size, min(poll_ms) AS poll_ms FROM polls GROUP BY size)
  SELECT o.seq, greatest(f.poll_ms, (o.ingested_ms + 3599999) // 3600000 * 3600000) - o.ingested_ms AS latency_ms FROM object_log o ASOF JOIN (SELECT size - 1 AS top, poll_ms FROM first) f ON o.seq <= f.top""",
    "amplification": f"WITH {v.FEED}, g AS (SELECT queue, count(*) AS deliveries, count(DISTINCT batch_id) AS batches, count(DISTINCT to_json([bucket, key, action, etag, event_time])) AS messages FROM feed GROUP BY queue) SELECT *, cast(deliveries AS double) / batches AS per_batch, cast(deliveries AS double) / messages AS per_message FROM g",
}
