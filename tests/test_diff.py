from pyspark.sql import functions as F

from auditlake.operators.diff import diff_copies

S = "key string, etag string, size long, deleted boolean, v long"


def run(spark, left, right, **more):
    a, b = spark.createDataFrame(left, S), spark.createDataFrame(right, S)
    got = diff_copies(a, b, ["key"], ["etag", "size"], left_version=["v"], right_version=["v"], left_deleted="deleted", **more)
    return sorted(((r["key"], r["difference"]) for r in got.collect()), key=repr)


def test_kinds(spark):
    left = [("same", "a", 1, False, 1), ("etag", "a", 1, False, 1), ("both", "a", 1, False, 1), ("gone", None, None, True, 1), ("gone2", None, None, True, 1), ("left", "a", 1, False, 1), ("unknown", "a", None, False, 1)]
    right = [("same", "a", 1, None, 1), ("etag", "b", 1, None, 1), ("both", "b", 2, None, 1), ("gone", "a", 1, None, 1), ("right", "a", 1, None, 1), ("unknown", "a", 5, None, 1)]
    want = [("both", "etag"), ("both", "size"), ("etag", "etag"), ("gone", "deleted"), ("left", "only_left"), ("right", "only_right")]
    assert run(spark, left, right, unknown_left=True) == want
    assert run(spark, left, right) == sorted([*want, ("unknown", "size")])


def test_versions_ties_and_repeats(spark):
    left = [("k", "new", 1, False, 2)]
    right = [("k", "old", 1, None, 1), ("k", "new", 1, None, 2), ("k", "new", 1, None, 2)]
    assert run(spark, left, right) == []
    tie = [("k", "a", 1, None, 5), ("k", "b", 1, None, 5)]  # the greatest by the fields counts, in any order
    assert run(spark, [("k", "b", 1, False, 1)], tie) == run(spark, [("k", "b", 1, False, 1)], tie[::-1]) == []


def test_nulls_in_every_column(spark):
    left = [(None, "a", 1, None, None), ("x", None, None, None, None)]
    right = [(None, "b", 1, None, None), ("x", None, None, None, None)]
    assert run(spark, left, right) == [(None, "etag")]


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("k", "a", 1, False, 1)], []) == [("k", "only_left")]
    assert run(spark, [], [("k", "a", 1, None, 1)]) == [("k", "only_right")]


def test_clashing_names_and_long_text(spark):
    long = "x" * 200_000
    names = "`difference` string, `l` string, `r` string, k0 long, f0 long"
    a = spark.createDataFrame([("id", long, "q", 1, 1)], names)
    b = spark.createDataFrame([("id", long + "y", "q", 2, 2)], names)
    got = diff_copies(a, b, ["r"], ["l", "difference"]).withColumn("n", F.length("left_value")).collect()
    assert [(r["r"], r["difference"], r["n"]) for r in got] == [("q", "l", 200_000)]
    assert diff_copies(a, b, ["l", "r"], ["k0"], values=False).count() == 2
