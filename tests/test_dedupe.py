from pyspark.sql import functions as F

from auditlake.operators.dedupe import ID, copies, dedupe_batch, keep_first, message_id, with_id
from auditlake.operators.sequencing import number, number_by_text, window_dedupe

S = "a string, b string, n long, __rank string"


def ids(spark, rows):
    df = spark.createDataFrame(rows, S)
    return with_id(df, [F.col("a"), F.col("b")], [F.col("a")])


def test_keep_and_copies(spark):
    rows = [("x", "1", 5, None), ("x", "1", 3, "q"), ("x", None, 4, None), ("x", None, 9, None), (None, "1", 1, None), (None, "1", 2, None), ("", "x1", 6, None), ("x1", "", 7, None)]
    df = ids(spark, rows)
    assert sorted(r["n"] for r in keep_first(df, [F.col("n")]).drop("x").collect()) == [1, 2, 3, 4, 6, 7]
    assert sorted(r["n"] for r in copies(df, [F.col("a"), F.col("b")], [F.col("a")], "n").collect()) == [5, 9]


def test_identifier_is_injective(spark):
    df = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), ("ab", ":c"), (None, "~"), ("~", None), (None, None), ("", "")], "a string, b string")
    assert df.select(message_id([F.col("a"), F.col("b")])).distinct().count() == 7


def test_batches(spark):
    df = ids(spark, [("x", "1", 1, None), ("y", "1", 2, None), ("x", "1", 3, None), ("z" * 100_000, "1", 4, None), ("z" * 100_000, "1", 5, None), (None, "1", 6, None)])
    first, stored = dedupe_batch(df.filter("n < 3"), None, [F.col("n")])
    second, new = dedupe_batch(df.filter("n >= 3"), stored, [F.col("n")])
    assert sorted(r["n"] for r in first.collect()) == [1, 2] and sorted(r["n"] for r in second.collect()) == [4, 6]
    assert new.count() == 1


def test_empty(spark):
    df = ids(spark, [])
    assert keep_first(df, [F.col("n")]).count() == 0 and copies(df, [F.col("a")], [], "n").count() == 0
    assert dedupe_batch(df, df.select(ID), [F.col("n")])[0].count() == 0


def test_numbering(spark):
    df = spark.createDataFrame([(i * 37 % 1009, f"k{i * 37 % 1009:05}") for i in range(1009)], "pos long, key string")
    assert all(r["seq"] == r["pos"] for r in number(df, "pos", block=64).collect())
    assert all(r["seq"] == r["pos"] for r in number_by_text(df, "key", ranges=7).collect())
    assert number(df.limit(0), "pos").count() == 0 and number_by_text(df.limit(0), "key").count() == 0


def test_window_dedupe(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 60, 1), ("a", 120, 2), ("b", 5, 3), (None, 5, 4), ("c", 10, 5), ("c", 10, 6), ("a", 219, 7), ("a", 220, 8)], "id string, t long, row long")
    got = {r["row"]: r["accepted"] for r in window_dedupe(df, F.col("id"), F.col("t"), F.col("row"), 100).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 5: True, 6: False, 7: False, 8: True}
