import json

import pytest
from pyspark.sql import functions as F

from auditlake.operators.entries import append_problems, observation_problem, validity

GOOD = {"v": 1, "type": "object.event", "bucket": "vault-1", "key": "a/b", "action": "PutObject", "eventTime": "2026-03-01T00:00:00Z", "ingestedAt": "2026-03-01T00:00:01Z", "size": 5, "etag": "e"}
SEEN, WANTED = {"etag": "e", "size": 1, "uploaded": "2026-03-01T00:00:00Z"}, {"eventTime": "2026-03-01T00:00:00Z", "seq": 4}
FINDING = {"v": 1, "type": "audit.finding", "kind": "UNLOGGED_OBJECT", "bucket": "vault-1", "key": "k", "scanId": "s1", "observedAt": "2026-03-01T00:00:00Z", "graceSeconds": 5, "observed": SEEN}


def text(o):
    return json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def change(base=GOOD, **more):
    return {k: v for k, v in (base | more).items() if v is not None}


CASES = [
    (text(GOOD), True, None),
    (text(change(key="tab\t\"é\\\x01")), True, None),
    (text(change(key=None, keyHmac="0" * 64)), True, None),
    (text(change(action="CopyObject", copySource={"bucket": "b", "key": "k"})), True, None),
    (text(change(action="DeleteObject", size=None, etag=None)), True, None),
    (text(change(keyHmac="0" * 64)), True, "key"),
    (text(change(key=None)), True, "key"),
    (text(change(key="")), True, "key"),
    (text(change(key="x" * 1025)), True, "key"),
    (text(change(key=None, keyHmac="0" * 63)), True, "keyHmac"),
    (text(change(bucket="-bad")), True, "bucket"),
    (text(change(action="Put")), True, "action"),
    (text(change(eventTime="2026-02-30T00:00:00Z")), True, "eventTime"),
    (text(change(size=-1)), True, "size"),
    (text(change(etag="a b")), True, "etag"),
    (text(change(action="DeleteObject")), True, "deletion"),
    (text(change(copySource={"bucket": "b", "key": "k"})), True, "copySource"),
    (json.dumps(GOOD), True, "not canonical"),  # blanks and order
    (text(change(extra=1)), True, "not canonical"),
    (text(GOOD).replace('"size":5', '"size":5.0'), True, "not canonical"),
    (text(change(type="object.other")), False, None),
    (text(change(v=2)), False, None),
    ("not json", False, None),
    ("", False, None),
    (text(FINDING), True, None),
    (text(change(FINDING, expected=WANTED)), True, "kind"),
    (text(change(FINDING, kind="MISSING_OBJECT", observed=None, expected=WANTED)), True, None),
    (text(change(FINDING, kind="MISSING_OBJECT", observed=None, expected={"eventTime": "2026-03-01T00:00:00Z"})), True, "expected.seq"),
    (text(change(FINDING, kind="CONTENT_DRIFT", expected=WANTED)), True, "sha256"),
    (text({"v": 1, "type": "audit.scan", "scanId": "s", "phase": "start", "logSizeAtStart": 3}), True, None),
    (text({"v": 1, "type": "audit.scan", "scanId": "s", "phase": "end"}), True, "counts"),
    (text({"v": 1, "type": "audit.scan", "scanId": "-/", "phase": "start"}), True, "scanId"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t.encode(), "x") for i, (t, _, _) in enumerate(CASES)] + [(len(CASES), None, None)], "i int, entry binary, problem0 string")
    got = validity(df).orderBy("i").select("known", "problem").collect()
    for (t, known, problem), r in zip(CASES, got, strict=False):
        assert (r["known"], r["problem"]) == (known, problem), t
    assert (got[-1]["known"], got[-1]["problem"]) == (False, None)


def test_unknown_and_broken_entries_never_fail(spark):
    df = spark.createDataFrame([(b"\xff\xfe",), (b"[1,2]",), (b'{"v":"x"}',), (b"{" * 50,)], "entry binary")
    assert [r["known"] for r in validity(df).select("known").collect()] == [False] * 4


@pytest.mark.parametrize("n", [0, 1])
def test_empty(spark, n):
    df = spark.createDataFrame([(b"{}",)], "entry binary").limit(n)
    assert validity(df).filter(F.col("known")).count() == 0


def test_batches_are_taken_whole_or_not_at_all(spark):
    import json

    good = {"v": 1, "type": "object.event", "bucket": "b-1", "key": "k", "action": "PutObject", "eventTime": "2026-01-01T00:00:00Z", "ingestedAt": "2026-01-01T00:00:01Z"}
    text = lambda **more: json.dumps(dict(sorted((good | more).items())), separators=(",", ":")).encode()
    rows = [(1, "a" * 64, text()), (1, "b" * 64, text(key="l")), (2, "a" * 64, text()), (2, None, text()), (3, "a" * 64, text(bucket="B")), (4, "a" * 64, text(v=2)), (5, "A" * 64, text()), (6, "a" * 64, b"\xff"), (None, "a" * 64, text())]
    rows += [(7, "c" * 64, text())] * 1000 + [(8, "c" * 64, text())] * 1001
    got = {r["batch"]: (r["items"], r["bad"], r["accepted"]) for r in append_problems(spark.createDataFrame(rows, "batch int, event_id string, entry binary"), "batch").collect()}
    assert got == {1: (2, 0, True), 2: (2, 1, False), 3: (1, 1, False), 4: (1, 1, False), 5: (1, 1, False), 6: (1, 1, False), None: (1, 0, True), 7: (1000, 0, True), 8: (1001, 0, False)}


def test_observations(spark):
    rows = [("k", "e", 1, 1, "a" * 64, None), ("", "e", 1, 1, "a" * 64, None), (None, "e", 1, 1, "a" * 64, None), ("k" * 1025, "e", 1, 1, "a" * 64, None), ("k", "e f", 1, 1, "a" * 64, None), ("k", None, 1, 1, "a" * 64, None), ("k", "e", -1, 1, "a" * 64, None), ("k", "e", 1, 2**53, "a" * 64, None), ("k", "e", 1, 1, "A" * 64, None), ("k", "e", 1, 1, "a" * 64, "b")]
    df = spark.createDataFrame(rows, "key string, etag string, size long, uploaded long, sha256 string, stored_sha256 string")
    assert [r[0] for r in df.select(observation_problem()).collect()] == [None, "key", "key", "key", "etag", "etag", "size", "uploaded", "sha256", "stored_sha256"]


SNAPSHOT = {"v": 1, "type": "object.snapshot", "bucket": "b-1", "key": "k", "size": 3, "etag": "e", "uploaded": "2026-01-01T00:00:00Z", "snapshotId": "s.1"}
OBSERVATION = {"v": 1, "type": "audit.observation", "bucket": "b-1", "key": "k", "size": 3, "etag": "e", "sha256": "0" * 64, "scanId": "s", "observedAt": "2026-01-01T00:00:00Z"}
SCAN = {"v": 1, "type": "audit.scan", "scanId": "s", "phase": "end", "objectsScanned": 1, "findings": 0}
MORE = [
    (SNAPSHOT, None), (change(SNAPSHOT, snapshotId=".x"), "snapshotId"), (change(SNAPSHOT, bucket="B"), "bucket"), (change(SNAPSHOT, etag=None), "observed"), (change(SNAPSHOT, size=2**53), "observed"), (change(SNAPSHOT, action="PutObject"), "not canonical"), (change(SNAPSHOT, uploaded="now"), "uploaded"),
    (OBSERVATION, None), (change(OBSERVATION, sha256="0" * 63), "sha256"), (change(OBSERVATION, etag="a b"), "etag"), (change(OBSERVATION, keyHmac="0" * 64), "key"), (change(OBSERVATION, phase="end"), "not canonical"), (change(OBSERVATION, observedAt=None), "observedAt"),
    (SCAN, None), (change(SCAN, logSizeAtStart=1), "logSizeAtStart"), (change(SCAN, findings=-1), "findings"), (change(SCAN, phase="start"), "counts"), (change(SCAN, bucket="b-1"), "not canonical"),
    (change(FINDING, graceSeconds=-1), "graceSeconds"), (change(FINDING, kind="OTHER"), "kind"), (change(FINDING, note="x"), "not canonical"), (change(FINDING, bucket="B"), "bucket"),
]


def test_every_type_in_full(spark):
    df = spark.createDataFrame([(i, text(o).encode()) for i, (o, _) in enumerate(MORE)], "i int, entry binary")
    got = [r["problem"] for r in validity(df).orderBy("i").select("problem").collect()]
    assert got == [p for _, p in MORE]
