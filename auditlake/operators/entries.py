"""Log entries: strict validation of canonical JSON entries, and tolerant projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.feed import ACTIONS, BUCKET, DELETES, ETAG, MAX_SAFE, good_key
from auditlake.functions.rfc3339 import epoch_ms
from auditlake.functions.text import json_object, json_string

MAX_ENTRY_BYTES = 65_535
HEX64 = r"\A[0-9a-f]{64}\z"
IDENTIFIER = r"\A[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}\z"

#: Union of the fields of all entry types.
SCHEMA = (
    "v bigint, type string, bucket string, key string, keyHmac string, action string, eventTime string, ingestedAt string, size bigint, etag string, "
    "copySource struct<bucket string, key string, keyHmac string>, uploaded string, snapshotId string, kind string, scanId string, observedAt string, graceSeconds bigint, "
    "observed struct<etag string, size bigint, uploaded string, sha256 string>, expected struct<eventTime string, etag string, size bigint, seq bigint, sha256 string>, "
    "phase string, objectsScanned bigint, findings bigint, logSizeAtStart bigint, sha256 string"
)
KNOWN = ("object.event", "object.snapshot", "audit.finding", "audit.scan", "audit.observation")


def utf8(c: Column) -> Column:
    """The text of bytes, null where they are no UTF-8."""
    return F.try_validate_utf8(c.cast("string"))


def parsed(df: DataFrame, entry: str = "entry") -> DataFrame:
    """Adds ``e``: the entry's fields, null where they are absent or of another type. Never fails; ``raw`` stays the truth."""
    return df.withColumn("e", F.from_json(utf8(F.col(entry)), SCHEMA, {"mode": "PERMISSIVE"}))


#: The fields of each type, and of the objects inside entries (fixed by the log's format).
FIELDS = {
    "object.event": ("v", "type", "bucket", "key", "keyHmac", "action", "eventTime", "ingestedAt", "size", "etag", "copySource"),
    "object.snapshot": ("v", "type", "bucket", "key", "keyHmac", "size", "etag", "uploaded", "snapshotId"),
    "audit.finding": ("v", "type", "kind", "bucket", "key", "keyHmac", "observed", "expected", "scanId", "observedAt", "graceSeconds"),
    "audit.scan": ("v", "type", "scanId", "phase", "objectsScanned", "findings", "logSizeAtStart"),
    "audit.observation": ("v", "type", "bucket", "key", "keyHmac", "etag", "size", "sha256", "scanId", "observedAt"),
}
INSIDE = {"copySource": ("bucket", "key", "keyHmac"), "observed": ("etag", "size", "uploaded", "sha256"), "expected": ("eventTime", "etag", "size", "seq", "sha256")}
NUMBERS = ("v", "size", "graceSeconds", "seq", "objectsScanned", "findings", "logSizeAtStart")
FINDING_KINDS = ("UNLOGGED_OBJECT", "MISSING_OBJECT", "ETAG_MISMATCH", "SIZE_MISMATCH", "PHANTOM_DELETE", "CONTENT_DRIFT")


def canonical(kind: str, e: str = "e") -> Column:
    """The canonical text of an entry of a type with exactly its known fields: an entry with any other field differs from it."""

    def encoded(at: str, names: tuple[str, ...]) -> Column:
        out = {}
        for n in names:
            c = F.col(f"{at}.{n}")
            out[n] = F.when(c.isNotNull(), encoded(f"{at}.{n}", INSIDE[n])) if n in INSIDE else c.cast("string") if n in NUMBERS else json_string(c)
        return json_object(out)

    return encoded(e, FIELDS[kind])


def event_problem(entry: Column, e: str = "e") -> Column:
    """The first rule an ``object.event`` entry breaks, null if it is sound."""
    f = lambda n: F.col(f"{e}.{n}")
    deletion = F.coalesce(f("action").isin(*DELETES), F.lit(False))
    source = f("copySource")
    return (
        F.when(F.length(entry) > MAX_ENTRY_BYTES, "too long")
        .when(f("v").isNull() | (f("v") != 1), "v")
        .when(f("bucket").isNull() | ~f("bucket").rlike(BUCKET), "bucket")
        .when(f("key").isNull() == f("keyHmac").isNull(), "key")
        .when(f("key").isNotNull() & ~good_key(f("key")), "key")
        .when(f("keyHmac").isNotNull() & ~f("keyHmac").rlike(HEX64), "keyHmac")
        .when(f("action").isNull() | ~f("action").isin(*ACTIONS), "action")
        .when(epoch_ms(f("eventTime")).isNull(), "eventTime")
        .when(epoch_ms(f("ingestedAt")).isNull(), "ingestedAt")
        .when(f("size").isNotNull() & ~f("size").between(0, MAX_SAFE), "size")
        .when(f("etag").isNotNull() & ~f("etag").rlike(ETAG), "etag")
        .when(deletion & (f("size").isNotNull() | f("etag").isNotNull()), "deletion")
        .when(source.isNotNull() & (f("action") != "CopyObject"), "copySource")
        .when(source.isNotNull() & (f("copySource.bucket").isNull() | (f("copySource.key").isNull() == f("copySource.keyHmac").isNull())), "copySource")
        .when(~canonical("object.event", e).eqNullSafe(utf8(entry)), "not canonical")
    )


def validity(df: DataFrame, entry: str = "entry") -> DataFrame:
    """Adds ``known`` (type and version) and ``problem``; entries of unknown type are reported, not judged. All known types are judged in full."""
    rows = parsed(df, entry)
    f = lambda n: F.col(f"e.{n}")
    known = F.coalesce(f("type").isin(*KNOWN) & (f("v") == 1), F.lit(False))
    whole = lambda c: F.col(c).isNull() | ~F.col(c).between(0, MAX_SAFE)
    text = lambda c, form: F.col(c).isNull() | ~F.col(c).rlike(form)
    observed, expected = f("observed").isNotNull(), f("expected").isNotNull()
    drift = f("kind") == "CONTENT_DRIFT"
    long = F.length(entry) > MAX_ENTRY_BYTES
    bucket = text("e.bucket", BUCKET)
    named = (f("key").isNull() == f("keyHmac").isNull()) | (f("key").isNotNull() & ~good_key(f("key"))) | (f("keyHmac").isNotNull() & ~f("keyHmac").rlike(HEX64))
    rest = lambda problem, kind: problem.when(~canonical(kind).eqNullSafe(utf8(F.col(entry))), "not canonical")
    finding = (
        F.when(long, "too long").when(bucket, "bucket").when(named, "key").when(text("e.scanId", IDENTIFIER), "scanId").when(epoch_ms(f("observedAt")).isNull(), "observedAt")
        .when(~F.coalesce(f("kind").isin(*FINDING_KINDS), F.lit(False)), "kind").when(whole("e.graceSeconds"), "graceSeconds")
        .when(observed != (f("kind") != "MISSING_OBJECT"), "kind").when(expected != (f("kind") != "UNLOGGED_OBJECT"), "kind")
        .when(observed & text("e.observed.etag", ETAG), "observed.etag").when(observed & whole("e.observed.size"), "observed.size").when(observed & epoch_ms(f("observed.uploaded")).isNull(), "observed.uploaded")
        .when(expected & epoch_ms(f("expected.eventTime")).isNull(), "expected.eventTime").when(f("expected.etag").isNotNull() & ~f("expected.etag").rlike(ETAG), "expected.etag")
        .when(f("expected.size").isNotNull() & whole("e.expected.size"), "expected.size").when(f("expected.seq").isNotNull() & whole("e.expected.seq"), "expected.seq")
        .when((observed & (drift != f("observed.sha256").isNotNull())) | (expected & (drift != f("expected.sha256").isNotNull())), "sha256")
        .when((f("observed.sha256").isNotNull() & ~f("observed.sha256").rlike(HEX64)) | (f("expected.sha256").isNotNull() & ~f("expected.sha256").rlike(HEX64)), "sha256")
        .when(~drift & expected & f("expected.seq").isNull(), "expected.seq")
    )
    scan = (
        F.when(long, "too long").when(text("e.scanId", IDENTIFIER), "scanId").when(~F.coalesce(f("phase").isin("start", "end"), F.lit(False)), "phase")
        .when((f("phase") == "end") & (f("objectsScanned").isNull() | f("findings").isNull()), "counts").when((f("phase") == "start") & (f("objectsScanned").isNotNull() | f("findings").isNotNull()), "counts")
        .when((f("phase") == "end") & f("logSizeAtStart").isNotNull(), "logSizeAtStart")
    )
    for n in ("objectsScanned", "findings", "logSizeAtStart"):
        scan = scan.when(f(n).isNotNull() & whole(f"e.{n}"), n)
    snapshot = F.when(long, "too long").when(bucket, "bucket").when(named, "key").when(whole("e.size") | text("e.etag", ETAG), "observed").when(epoch_ms(f("uploaded")).isNull(), "uploaded").when(text("e.snapshotId", IDENTIFIER), "snapshotId")
    observation = (
        F.when(long, "too long").when(bucket, "bucket").when(named, "key").when(text("e.etag", ETAG), "etag").when(whole("e.size"), "size").when(text("e.sha256", HEX64), "sha256").when(text("e.scanId", IDENTIFIER), "scanId")
        .when(epoch_ms(f("observedAt")).isNull(), "observedAt")
    )
    problem = (
        F.when(f("type") == "object.event", event_problem(F.col(entry))).when(f("type") == "audit.finding", rest(finding, "audit.finding")).when(f("type") == "audit.scan", rest(scan, "audit.scan"))
        .when(f("type") == "object.snapshot", rest(snapshot, "object.snapshot")).when(f("type") == "audit.observation", rest(observation, "audit.observation"))
    )
    return rows.withColumn("known", known).withColumn("problem", F.when(known, problem))


#: Most items of one append (fixed by the log).
MAX_ITEMS = 1000


def append_problems(items: DataFrame, batch: str) -> DataFrame:
    """Per batch: ``items``, ``bad`` and whether the batch is ``accepted``: all of its items are sound and there are 1 to 1,000.

    An item is sound if its ``event_id`` is a hash and its ``entry`` is of known type and breaks no rule. A null batch is one batch.
    Counts combine on the map side, so a batch of any size is no burden.
    """
    sound = F.coalesce(F.col("event_id").rlike(HEX64), F.lit(False)) & F.col("known") & F.col("problem").isNull()
    g = validity(items).groupBy(batch).agg(F.count(F.lit(1)).alias("items"), F.count_if(~sound).alias("bad"))
    return g.withColumn("accepted", (F.col("bad") == 0) & F.col("items").between(1, MAX_ITEMS))


def observation_problem() -> Column:
    """The first rule an observation (``key``, ``etag``, ``size``, ``uploaded``, ``sha256``, ``stored_sha256``) breaks, null if it is sound."""
    count = lambda c: F.col(c).isNull() | ~F.col(c).between(0, MAX_SAFE)
    text = lambda c, form: F.col(c).isNull() | ~F.col(c).rlike(form)
    return (
        F.when(~good_key(F.col("key")), "key").when(text("etag", ETAG), "etag").when(count("size"), "size").when(count("uploaded"), "uploaded").when(text("sha256", HEX64), "sha256")
        .when(F.col("stored_sha256").isNotNull() & ~F.col("stored_sha256").rlike(HEX64), "stored_sha256")
    )
