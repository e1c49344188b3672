"""Auditing a bucket: its listing against the log's expected state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("UNLOGGED_OBJECT", "MISSING_OBJECT", "PHANTOM_DELETE", "ETAG_MISMATCH", "SIZE_MISMATCH", "CONTENT_DRIFT")


def reconcile(listing: DataFrame, state: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """``key``, ``kind``, ``basis_seq`` and both sides' etag and size, one row per finding.

    ``listing``: key, etag, size, uploaded (ms). ``state``: key, etag, size, event_ms, seq, deleted, one row per key. What
    is younger than the grace is not judged. Nulls of the state are unknown and equal everything.
    """
    o = listing.select("key", F.col("etag").alias("o_etag"), F.col("size").alias("o_size"), "uploaded", F.lit(True).alias("listed"))
    e = state.select("key", F.col("etag").alias("e_etag"), F.col("size").alias("e_size"), "event_ms", F.col("seq").alias("basis_seq"), "deleted", F.lit(True).alias("logged"))
    both = o.join(e, "key", "full_outer")
    quiet = lambda c: c <= now_ms - grace_ms
    kind = (
        F.when(F.col("logged").isNull(), F.when(quiet(F.col("uploaded")), "UNLOGGED_OBJECT"))
        .when(F.col("listed").isNull(), F.when(~F.col("deleted") & quiet(F.col("event_ms")), "MISSING_OBJECT"))
        .when(~quiet(F.greatest("uploaded", "event_ms")), None)
        .when(F.col("deleted"), "PHANTOM_DELETE")
        .when(F.col("e_etag") != F.col("o_etag"), "ETAG_MISMATCH")
        .when(F.col("e_size") != F.col("o_size"), "SIZE_MISMATCH")
    )
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").select("key", "kind", "basis_seq", "o_etag", "o_size", "e_etag", "e_size")


def confirm(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """The candidates whose key has not changed since: its current entry is the one they were judged by (or still none)."""
    now = state.select("key", F.col("seq").alias("current_seq"))
    return candidates.join(now, "key", "left").filter(F.col("basis_seq").eqNullSafe(F.col("current_seq"))).drop("current_seq")


def page_end(listing: DataFrame, live: DataFrame, after: str, size: int) -> DataFrame:
    """Where a page of a merge of two sorted streams ends: the least of the last keys of the sides that were cut short.

    One row: ``page_end`` (null: neither was cut), ``listed`` and ``live`` keys up to it.
    """

    def cut(df: DataFrame) -> str | None:
        keys = [r["key"] for r in df.filter(F.col("key") > after).select("key").orderBy("key").limit(size + 1).collect()]  # a page, and one ahead
        return keys[size - 1] if len(keys) > size else None

    end = min((x.encode() for x in (cut(listing), cut(live)) if x is not None), default=None)
    end = end.decode() if end is not None else None
    inside = lambda df: df.filter((F.col("key") > after) & (F.lit(True) if end is None else F.col("key") <= end)).agg(F.count(F.lit(1))).first()[0]
    return listing.sparkSession.createDataFrame([(end, inside(listing), inside(live))], "page_end string, listed long, live long")


def drift(observations: DataFrame, order: list[Column]) -> DataFrame:
    """Objects whose body changed under the same etag: against the previous observation, and against the stored checksum.

    Repeated observations are one; two findings are possible for one observation.
    """
    rows = observations.dropDuplicates(["key", "scan_id", "etag", "sha256", "stored_sha256", "observed_at"])
    w = Window.partitionBy("key").orderBy(*order)
    rows = rows.withColumn("p_etag", F.lag("etag").over(w)).withColumn("p_sha", F.lag("sha256").over(w))
    previous = rows.filter((F.col("p_etag") == F.col("etag")) & (F.col("p_sha") != F.col("sha256"))).select("key", "scan_id", "observed_at", F.lit("previous").alias("against"), F.col("p_sha").alias("expected"), "sha256")
    stored = rows.filter("stored_sha256 <> sha256").select("key", "scan_id", "observed_at", F.lit("stored").alias("against"), F.col("stored_sha256").alias("expected"), "sha256")
    return previous.unionByName(stored)


def order_violations(rows: DataFrame, position: str, key: str, block: int = 65_536) -> DataFrame:
    """Rows whose key is not greater than that of the row before, by integer position; checked per block and across blocks."""
    b = rows.select(F.col(position).alias("pos"), F.col(key).alias("key")).withColumn("b", F.expr(f"pos div {block}"))
    inner = b.withColumn("prev", F.lag("key").over(Window.partitionBy("b").orderBy("pos")))
    edge = b.groupBy("b").agg(F.min(F.struct("pos", "key")).alias("lo"), F.max(F.struct("pos", "key")).alias("hi"))
    edge = edge.withColumn("prev", F.lag("hi.key").over(Window.orderBy("b"))).select(F.col("lo.pos").alias("pos"), F.col("lo.key").alias("key"), "prev")
    bad = F.col("prev") >= F.col("key")
    return inner.filter(bad).select("pos", "prev", "key").unionByName(edge.filter(bad).select("pos", "prev", "key"))


def verify_index(scans: DataFrame, index: DataFrame, log: DataFrame) -> DataFrame:
    """Per scan, whether an index of findings agrees with the log: right scan, right type, as many as the end entry says.

    ``scans``: scan_id, start_seq, end_seq (null: none yet), one row per scan. ``index``: scan_id, seq. ``log``: seq, entry
    (JSON), without gaps. What lies behind the log's end is pending and fails nothing. A null, negative or repeated seq
    fails, so no copy stands in for an omitted finding, and so does an index of a scan that is not in ``scans``.
    ``signed`` is null while the end entry is not in the log: then findings could still be omitted.
    """
    entry = F.from_json(F.col("entry").cast("string"), "v long, type string, scanId string, phase string, findings long")
    signed = log.select("seq", entry.alias("e")).filter("e.v = 1 AND e.type IN ('audit.finding', 'audit.scan')")
    size = log.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("size"))
    listed = index.groupBy("scan_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    ends = lambda c: scans.filter(F.col(c).isNotNull()).select("scan_id", F.col(c).alias("seq"), F.lit(1).cast("long").alias("n"), F.lit(c).alias("role"))
    cited = listed.withColumn("role", F.lit("finding")).unionByName(ends("start_seq")).unionByName(ends("end_seq"))
    cited = cited.join(signed, "seq", "left").crossJoin(F.broadcast(size))
    is_scan = lambda phase: (F.col("e.type") == "audit.scan") & (F.col("e.phase") == phase)
    kind = F.when(F.col("role") == "finding", F.col("e.type") == "audit.finding").when(F.col("role") == "start_seq", is_scan("start")).otherwise(is_scan("end") & F.col("e.findings").isNotNull())
    cited = cited.withColumn("pending", F.coalesce(F.col("seq") >= F.col("size"), F.lit(False))).withColumn("right", F.coalesce((F.col("e.scanId") == F.col("scan_id")) & kind & (F.col("n") == 1), F.lit(False)))
    finding = F.col("role") == "finding"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g = cited.groupBy("scan_id").agg(
        total(finding).alias("listed"), total(finding & F.col("right")).alias("proven"), total(finding & F.col("pending")).alias("pending"),
        total(~F.col("right") & (~F.col("pending") | (F.col("n") > 1))).alias("wrong"), F.max(F.when((F.col("role") == "end_seq") & F.col("right"), F.col("e.findings"))).alias("signed"),
    )
    both = scans.select("scan_id", F.lit(True).alias("known")).join(g, "scan_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ok = F.coalesce(F.col("known"), F.lit(False)) & (F.coalesce("wrong", F.lit(0)) == 0) & F.coalesce(F.col("signed") == F.coalesce("listed", F.lit(0)), F.lit(True))
    return both.select("scan_id", zero("listed"), zero("proven"), zero("pending"), zero("wrong"), "signed", ok.alias("ok"))
