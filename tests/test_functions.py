import base64 as b64
import hashlib
import hmac
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.functions.feed import invalid_reason
from auditlake.functions.rfc3339 import epoch_ms, iso_hour, iso_ms

TIMES = {
    "2026-03-01T00:00:00Z": 1772323200000, "2026-03-01T00:00:00.1Z": 1772323200100, "2026-03-01T00:00:00.0019999Z": 1772323200001, "2026-03-01T00:00:00.123456789+05:45": 1772323200123 - (5 * 60 + 45) * 60_000,
    "1969-12-31T23:59:59.999Z": -1, "2026-03-01T00:00:00-00:30": 1772323200000 + 30 * 60_000, "2026-03-01T00:00:00+23:59": 1772323200000 - (23 * 60 + 59) * 60_000, "0050-01-01T00:00:00Z": -60589296000000,
    "2024-02-29T00:00:00Z": 1709164800000,
}
BAD = [None, "", "2026-02-30T00:00:00Z", "2025-02-29T00:00:00Z", "2026-03-01 00:00:00Z", "2026-03-01T00:00:00", "2026-03-01T24:00:00Z", "2026-03-01T00:00:60Z", "2026-03-01T00:00:00.Z", "2026-03-01T00:00:00.1234567890Z",
       "2026-03-01T00:00:00+24:00", "2026-03-01T00:00:00z", "01 Mar 2026 08:30", "2026-03-01T00:00:00Z\n", "２０２６-03-01T00:00:00Z"]


def test_times(spark):
    df = spark.createDataFrame([(x,) for x in [*TIMES, *BAD]], "t string")
    got = {r["t"]: r["ms"] for r in df.select("t", epoch_ms(F.col("t")).alias("ms")).collect()}
    assert got == TIMES | dict.fromkeys(BAD)


def test_iso(spark):
    ms = [0, -1, 1772323200123, 86_399_999]
    got = spark.createDataFrame([(x,) for x in ms], "m long").select("m", iso_ms(F.col("m")).alias("t"), iso_hour(F.col("m")).alias("h")).collect()
    for r in got:
        at = datetime.fromtimestamp(r["m"] // 1000, UTC)
        assert r["t"] == f"{at:%Y-%m-%dT%H:%M:%S}.{r['m'] % 1000:03}Z" and r["h"] == f"{at:%Y-%m-%dT%H}"


def test_json_text(spark):
    values = ["", "a", 'q"\\/', "\x00\x01\x0b\x1f", "tab\tnl\n\r\b\f", "\x7f é😀", "\\u0001", None]
    df = spark.createDataFrame([(x,) for x in values], "s string")
    got = {r["s"]: r["j"] for r in df.select("s", text.json_string(F.col("s")).alias("j")).collect()}
    assert got == {s: None if s is None else json.dumps(s, ensure_ascii=False) for s in values}
    both = df.select(text.json_array(text.json_string(F.col("s")), text.json_string(F.lit("x"))).alias("a"), text.json_object({"b": text.json_string(F.col("s")), "a": F.lit("1")}).alias("o")).collect()
    assert both[1]["a"] == '["a","x"]' and both[7]["a"] == '[null,"x"]' and both[1]["o"] == '{"a":1,"b":"a"}' and both[7]["o"] == '{"a":1}'


@pytest.mark.parametrize("key", [b"k", bytes(range(32)), b"\xaa" * 131])
def test_hmac(spark, key):
    df = spark.createDataFrame([("",), ("Test Using Larger Than Block-Size Key - Hash Key First",)], "s string")
    for r in df.select("s", text.hmac_sha256_hex(key, F.col("s")).alias("h")).collect():
        assert r["h"] == hmac.new(key, r["s"].encode(), hashlib.sha256).hexdigest()


def test_strict_decoding(spark):
    df = spark.createDataFrame([("YQ==",), ("YQ",), ("YR==",), ("",), (None,), ("a b",), (b64.b64encode(bytes(200)).decode(),)], "s string")
    got = [r[0] for r in df.select(text.strict_base64(F.col("s"))).collect()]
    assert [None if x is None else bytes(x) for x in got] == [b"a", None, None, b"", None, None, bytes(200)]
    df = spark.createDataFrame([("00ff",), ("00FF",), ("0",), ("",), (None,)], "s string")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(text.strict_hex(F.col("s"))).collect()] == [b"\0\xff", None, None, b"", None]


def test_sampling_is_a_fraction(spark):
    n = spark.range(20_000).select(text.sampled(F.lit("s"), F.col("id").cast("string"), 0.25).alias("x")).filter("x").count()
    assert 4700 < n < 5300


def test_invalid_reasons(spark):
    ok = ("PutObject", "k", 1, "e", "2026-03-01T00:00:00Z", False)
    cases = {
        ok: None, ("putobject", *ok[1:]): "action", (None, *ok[1:]): "action", ("PutObject", None, *ok[2:]): "object.key", ("PutObject", "", *ok[2:]): "object.key", ("PutObject", "é" * 513, *ok[2:]): "object.key",
        ("PutObject", "é" * 512, *ok[2:]): None, ("PutObject", "k", -1, *ok[3:]): "object.size", ("PutObject", "k", 1, "a b", *ok[4:]): "object.etag", ("PutObject", "k", 1, "", *ok[4:]): "object.etag", ("PutObject", "k", None, None, *ok[4:]): None,
        ("PutObject", "k", 1, "e", None, False): "event_time", ("DeleteObject", *ok[1:]): "object.size on a deletion", ("DeleteObject", "k", None, "e", *ok[4:]): "object.etag on a deletion", ("DeleteObject", "k", None, None, *ok[4:]): None,
        ("PutObject", "k", 1, "e", ok[4], True): "copy_source", ("CopyObject", "k", 1, "e", ok[4], True): None,
    }
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, k string, s long, e string, t string, c boolean")
    got = df.select("i", invalid_reason(*map(F.col, "aksetc")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == list(cases.values())
