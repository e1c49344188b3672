import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from auditlake.errors import NotVerifiable
from auditlake.operators import audit as a
from auditlake.operators.ranges import interval_join, nearest_rank
from auditlake.plans import audit as plans

NOW, GRACE = 1000, 100
L, S = "key string, etag string, size long, uploaded long, kind string", "key string, etag string, size long, event_ms long, seq long, deleted boolean, kind string"


def kinds(spark, listing, state):
    got = a.reconcile(spark.createDataFrame([(*x, "q") for x in listing], L), spark.createDataFrame([(*x, "q") for x in state], S), NOW, GRACE)
    return sorted((r["key"], r["kind"]) for r in got.collect())


def test_kinds_and_grace(spark):
    listing = [("a", "x", 1, 0), ("new", "x", 1, 950), ("etag", "y", 1, 0), ("size", "x", 2, 0), ("both", "y", 2, 0), ("fresh", "y", 2, 950), ("gone", "x", 1, 0), ("null", "y", 9, 0), ("ok", "x", 1, 0)]
    state = [("etag", "x", 1, 0, 1, False), ("size", "x", 1, 0, 2, False), ("both", "x", 1, 0, 3, False), ("fresh", "x", 1, 0, 4, False), ("gone", None, None, 0, 5, True), ("null", None, None, 0, 6, False), ("ok", "x", 1, 0, 7, False),
             ("missing", "x", 1, 0, 8, False), ("young", "x", 1, 901, 9, False), ("edge", "x", 1, 900, 10, False), ("dead", None, None, 0, 11, True)]
    assert kinds(spark, listing, state) == sorted([("a", "UNLOGGED_OBJECT"), ("etag", "ETAG_MISMATCH"), ("size", "SIZE_MISMATCH"), ("both", "ETAG_MISMATCH"), ("gone", "PHANTOM_DELETE"), ("missing", "MISSING_OBJECT"), ("edge", "MISSING_OBJECT")])
    assert kinds(spark, [], []) == []


def test_confirm(spark):
    c = spark.createDataFrame([("same", "K", 5), ("moved", "K", 5), ("none", "K", None), ("appeared", "K", None)], "key string, kind string, basis_seq long")
    s = spark.createDataFrame([("same", 5), ("moved", 6), ("appeared", 1)], "key string, seq long")
    assert sorted(r["key"] for r in a.confirm(c, s).collect()) == ["none", "same"]


def test_page_end(spark):
    keys = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    assert tuple(a.page_end(keys("abcdef"), keys("abxyz"), "", 3).first()) == ("c", 3, 2)
    assert tuple(a.page_end(keys("ab"), keys("a"), "", 3).first()) == (None, 2, 1)
    assert tuple(a.page_end(keys("abcdef"), keys("abcdef"), "c", 2).first()) == ("e", 2, 2)


def test_drift(spark):
    rows = [("k", "s1", "e", "1", None, 1), ("k", "s2", "e", "2", "2", 2), ("k", "s2", "e", "2", "2", 2), ("k", "s3", "f", "3", "9", 3), ("n", "s1", None, None, None, 1)]
    df = spark.createDataFrame(rows, "key string, scan_id string, etag string, sha256 string, stored_sha256 string, observed_at long")
    got = sorted((r["scan_id"], r["against"]) for r in a.drift(df, [F.col("observed_at")]).collect())
    assert got == [("s2", "previous"), ("s3", "stored")]


def test_order_violations(spark):
    df = spark.createDataFrame([(0, "a"), (1, "c"), (2, "c"), (3, "b"), (4, "d"), (7, "a")], "p long, k string")
    assert sorted(r["pos"] for r in a.order_violations(df, "p", "k", block=2).collect()) == [2, 3, 7]


def test_interval_join(spark):
    p = spark.createDataFrame([(i,) for i in range(0, 100)], "x long")
    i = spark.createDataFrame([(0, 10, "a"), (10, 10, "none"), (10, 95, "b")], "lo long, hi long, n string")
    got = {r["x"]: r["n"] for r in interval_join(p, "x", i, "lo", "hi", 8).collect()}
    assert got == {k: "a" if k < 10 else "b" for k in range(95)}


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", x) for x in [5, 1, 1, 9, None]] + [("h", 7), ("n", None)], "g string, x long")
    got = {r["g"]: (r["n"], r["min"], r["max"], r["mean"], r["median"], r["p95"]) for r in nearest_rank(df, ["g"], F.col("x"), {"median": 0.5, "p95": 0.95}).collect()}
    assert got == {"g": (4, 1, 9, 4.0, 1, 9), "h": (1, 7, 7, 7.0, 7, 7)}


def test_nearest_rank_by_bins(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), "x", r.randrange(-50, 400)) for _ in range(900)] + [("b", "y", 3)]
    got = nearest_rank(spark.createDataFrame(rows, "g string, h string, x long").repartition(3), ["g", "h"], F.col("x"), {"q1": 0.01, "q50": 0.5, "q99": 0.99, "top": 1.0}, width=7).collect()
    assert len(got) == len({(g, h) for g, h, _ in rows})
    for x in got:
        own = sorted(v for g, h, v in rows if (g, h) == (x["g"], x["h"]))
        rank = lambda q, own=own: own[max(1, math.ceil(len(own) * q)) - 1]
        assert (x["n"], x["min"], x["max"], x["q1"], x["q50"], x["q99"], x["top"]) == (len(own), own[0], own[-1], rank(0.01), rank(0.5), rank(0.99), own[-1]) and abs(x["mean"] - sum(own) / len(own)) < 1e-9


def test_fifty_scans_are_retained(spark, tmp_path):
    rows = [(f"s{i:02}", 1000 + i + late) for i in range(60) for late in (0, 500)] + [("tie", 1010)]
    spark.createDataFrame(rows, "scan_id string, observed_at long").write.parquet(f"{tmp_path}/scrub_observations.parquet")
    got = sorted((r["scan_id"], r["started_at"]) for r in plans.retained_scans(spark, str(tmp_path)).collect())
    assert got == sorted([(f"s{i:02}", 1000 + i) for i in range(11, 60)] + [("tie", 1010)])


G12 = [*((i, '{"type":"object.event","v":1}') for i in range(20)), (20, '{"logSizeAtStart":20,"phase":"start","scanId":"s1","type":"audit.scan","v":1}'),
       *((i, '{"key":"%s","kind":"MISSING_OBJECT","scanId":"s1","type":"audit.finding","v":1}' % k) for i, k in ((21, "a"), (22, "b"))), (23, '{"key":"c","type":"object.event","v":1}'),
       (24, '{"findings":2,"objectsScanned":9,"phase":"end","scanId":"s1","type":"audit.scan","v":1}')]


def test_index_of_findings_against_the_log(spark):
    cases = {  # scan cited, start, end, index; proven, pending, signed, ok
        "right": ("s1", 20, 24, [21, 22], 2, 0, 2, True), "omitted": ("s1", 20, 24, [21], 1, 0, 2, False), "all omitted": ("s1", 20, 24, [], 0, 0, 2, False),
        "added": ("s1", 20, 24, [21, 22, 23], 2, 0, 2, False), "another scan": ("s2", 20, 24, [21, 22], 0, 0, None, False), "misplaced start": ("s1", 21, 24, [21, 22], 2, 0, 2, False),
        "misplaced end": ("s1", 20, 23, [21, 22], 2, 0, None, False), "misplaced": ("s1", 20, 24, [21, 23], 1, 0, 2, False), "repeated": ("s1", 20, 24, [21, 21], 0, 0, 2, False),
        "null": ("s1", 20, 24, [21, None], 1, 0, 2, False), "negative": ("s1", 20, 24, [21, -1], 1, 0, 2, False), "not ended": ("s1", 20, None, [21], 1, 0, None, True),
        "pending": ("s1", 20, 99, [21, 30], 1, 1, None, True),
    }
    log = spark.createDataFrame(G12, "seq long, entry string")
    for name, (scan, start, end, cited, *want) in cases.items():
        scans = spark.createDataFrame([(scan, start, end)], "scan_id string, start_seq long, end_seq long")
        r = a.verify_index(scans, spark.createDataFrame([(scan, x) for x in cited], "scan_id string, seq long"), log).collect()
        assert [(x["proven"], x["pending"], x["signed"], x["ok"]) for x in r] == [tuple(want)], name
    unknown = a.verify_index(scans.limit(0), spark.createDataFrame([("s1", 21)], "scan_id string, seq long"), log).collect()
    assert [x["ok"] for x in unknown] == [False]


def test_scrub_sample_takes_a_size_bound(spark, tmp_path):
    less = 1_000_000
    sizes = [10, less, less + 1, plans.SCRUB_BYTES, plans.SCRUB_BYTES + 1]
    rows = [(f"k{i:03}", "s", 1, 1, "e", sizes[i % 5]) for i in range(200)]
    spark.createDataFrame(rows, "key string, scan_id string, observed_at long, uploaded long, etag string, size long").write.parquet(f"{tmp_path}/scrub_observations.parquet")
    chosen = lambda **x: {sizes[int(r["key"][1:]) % 5] for r in plans.scrub_sample(spark, str(tmp_path), **x).collect()}
    assert chosen() - chosen(max_bytes=less) and max(chosen()) == plans.SCRUB_BYTES and max(chosen(max_bytes=less)) <= less


@pytest.mark.parametrize("query", [plans.watch_alerts, plans.watch_live])
def test_blinded_entries_are_reported(spark, tmp_path, query):
    row = lambda seq, key, hmac: (seq, "PutObject", key, hmac, "e", 1, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z")
    schema = "seq long, action string, key string, key_hmac string, etag string, size long, event_time string, ingested_at string"
    for name, rows in (("plain", [row(0, "legal/a", None), row(1, "legal/a", None)]), ("blinded", [row(0, "legal/a", None), row(1, None, "ab"), row(2, "legal/a", None)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/object_events.parquet")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert query(spark, f"{tmp_path}/plain", strict=True).count() == 1
    with pytest.warns(UserWarning, match="1 of 3 entries have blinded keys"):
        assert query(spark, f"{tmp_path}/blinded").count() == 1
    with pytest.raises(NotVerifiable, match="1 of 3"):
        query(spark, f"{tmp_path}/blinded", strict=True)
    assert tuple(plans.watch_blinded(spark, f"{tmp_path}/blinded").first()) == (1, 3)
