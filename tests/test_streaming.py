from pyspark.sql import functions as F

from auditlake.operators import late
from auditlake.operators.cdc import VectorTable
from auditlake.session import folders, work_dir
from auditlake.streaming import ttl
from auditlake.streaming.ingest import CorrectedPeriods, LogSink, apply_changes, parquet_stream, run


def files(spark, root, schema, parts):
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return parquet_stream(spark, f"{root}/in", files_per_batch=1)


def test_log_without_gaps_or_copies(spark):
    root = work_dir(spark, "s")
    stream = files(spark, root, "id string, n long", [[("a", 0), ("b", 1), ("a", 2)], [("b", 3), ("c", 4), (None, 5)], [("c", 6)], [("d", 7)]])
    sink = LogSink(spark, f"{root}/out", "id", "n")
    run(stream, f"{root}/c", sink).awaitTermination()
    rows = sink.log().collect()
    assert sorted(r["seq"] for r in rows) == [0, 1, 2, 3] and sorted(r["id"] for r in rows) == ["a", "b", "c", "d"]
    sink(spark.createDataFrame([("d", 7)], "id string, n long"), 3)  # the last batch again
    assert sorted(r["seq"] for r in sink.log().collect()) == [0, 1, 2, 3]


def test_late_events_over_batches(spark):
    root = work_dir(spark, "l")
    H = late.HOUR
    rows = [(i, (i * 7919) % (30 * H), (i * 104_729) % (40 * H), i % 5) for i in range(500)]
    stream = files(spark, root, "seq long, e long, a long, z long", [rows[:100], rows[100:350], rows[350:]])
    sink = CorrectedPeriods(spark, f"{root}/out", "seq", "e", "a", "z")
    run(stream, f"{root}/c", sink).awaitTermination()
    whole = late.corrected(spark.createDataFrame(rows, "seq long, e long, a long, z long"), *map(F.col, "seq e a z".split()))
    key = ["period", "first_count", "first_size", "count", "size", "cut_off", "corrections"]
    assert sorted(map(tuple, sink.read().select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))


def test_changes_over_batches(spark):
    root = work_dir(spark, "t")
    stream = files(spark, root, "key string, ms long, deleted boolean, etag string", [[("a", 5, False, "1")], [("a", 9, True, None), ("b", 1, False, "b")], [("a", 7, False, "late"), ("b", 2, False, "b2")]])
    table = VectorTable(spark, f"{root}/table", "key", ["ms"], ["etag"])
    run(stream, f"{root}/c", apply_changes(table)).awaitTermination()
    assert [(r["k"], r["etag"]) for r in table.read().collect()] == [("b", "b2")]


def test_time_to_live(spark):
    root = work_dir(spark, "ttl")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # state with a time to live would ask for batches for ever
    for i, part in enumerate([[("a", 0, 0), ("a", 60, 1), ("b", 5, 3), ("a", 99, 4)], [("a", 120, 2), ("a", 130, 5), ("b", 104, 6), ("b", 105, 7)]]):
        spark.createDataFrame(part, "id string, t long, row long").coalesce(1).write.mode("append").parquet(f"{root}/in")
        q = ttl.accepted(parquet_stream(spark, f"{root}/in"), 100, idle=3_600_000).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").outputMode("append")
        q.trigger(availableNow=True).start().awaitTermination()  # a new query on the same checkpoint
        got = sorted((r["row"], r["t"]) for r in spark.read.parquet(f"{root}/out").collect())
        assert got == ([(0, 0), (3, 5)] if not i else [(0, 0), (2, 120), (3, 5), (7, 105)])


def test_log_with_a_time_to_live(spark):
    root = work_dir(spark, "s")
    batches = [[("a", 0, 0), ("b", 1, 10), ("a", 2, 50)], [("a", 3, 99), ("b", 4, 110), ("c", 5, 111), (None, 6, 111)], [("a", 7, 120), ("c", 8, 130)], [("c", 9, 400), ("d", 10, 401)]]
    for i, rows in enumerate(batches):
        LogSink(spark, f"{root}/out", "id", "n", "t", 100)(spark.createDataFrame(rows, "id string, n long, t long"), i)
    rows = {r["seq"]: r["n"] for r in LogSink(spark, f"{root}/out", "id", "n", "t", 100).log().collect()}
    assert rows == {0: 0, 1: 1, 2: 4, 3: 5, 4: 7, 5: 9, 6: 10}
    assert "batch=0" not in folders(spark, f"{root}/out/ids")  # all of its identifiers have expired
