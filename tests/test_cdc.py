import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import cdc
from auditlake.operators.feed import ObjectFeed
from auditlake.session import work_dir

S = "key string, ms long, n long, deleted boolean, etag string, k string, image string, old string"


def table(spark):
    return cdc.VectorTable(spark, work_dir(spark, "t"), "key", ["ms", "n"], ["etag"])


def rows(spark, changes):
    return spark.createDataFrame([(*c, "x", "y", "z") for c in changes], S)


def expected(changes):
    best = {}
    for key, ms, n, deleted, etag in changes:
        v = (ms, n)
        if key not in best or v > best[key][0]:
            best[key] = (v, bool(deleted), etag)
    return {k: x[2] for k, x in best.items() if not x[1]}


def live(t):
    got = [(r["k"], r["etag"]) for r in t.read().collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches(spark, seed):
    r = random.Random(seed)
    changes = [(r.choice([None, "", "hot", "hot", *(f"k{i}" for i in range(30))]), r.randrange(40), i, r.random() < 0.3, r.choice([None, f"e{i}"])) for i in range(400)]
    changes += changes[:50]  # repeated
    r.shuffle(changes)
    t = table(spark)
    for i in range(4):
        t.apply(i, rows(spark, changes[i::4]))
    assert live(t) == expected(changes)
    assert {x["k"] for x in t.read(tombstones=True).collect()} == {c[0] for c in changes}


def test_late_write_does_not_revive(spark):
    t = table(spark)
    t.apply(0, rows(spark, [("a", 10, 1, True, None)]))
    t.apply(1, rows(spark, [("a", 5, 2, False, "old")]))
    assert live(t) == {}
    t.apply(2, rows(spark, [("a", 10, 3, None, "new")]))  # tie in time, later number; null is not deleted
    assert live(t) == {"a": "new"}


def test_batch_again_and_empty(spark):
    t = table(spark)
    t.apply(0, rows(spark, []))
    assert live(t) == {}
    t.apply(1, rows(spark, [("a", 1, 1, False, "x" * 100_000)]))
    t.apply(2, rows(spark, [("a", 2, 2, False, "2"), ("b", 1, 1, False, "b")]))
    t.apply(2, rows(spark, [("a", 2, 2, False, "2"), ("b", 1, 1, False, "b")]))
    assert live(t) == {"a": "2", "b": "b"}


def test_old_files_keep_their_rows(spark):
    t = table(spark)
    t.apply(0, rows(spark, [(f"k{i}", 1, i, False, "1") for i in range(100)]))
    before = t._read("data").count()
    t.apply(1, rows(spark, [(f"k{i}", 2, i, False, "2") for i in range(0, 100, 2)]))
    assert t.spark.read.parquet(f"{t.root}/data/batch=0").count() == before == 100
    assert t.vectors().select(F.sum(F.expr("bitmap_count(bitmap)"))).first()[0] == 50
    assert sorted(live(t).values()) == ["1"] * 50 + ["2"] * 50


def test_positions_beyond_one_block(spark):
    n = 3 * cdc.BLOCK + 5
    t = table(spark)
    t.apply(0, spark.range(n).selectExpr("cast(id AS string) AS key", "1L AS ms", "id AS n", "false AS deleted", "'a' AS etag").coalesce(1))
    hit = [0, 1, 7, 8, cdc.BLOCK - 1, cdc.BLOCK, 2 * cdc.BLOCK + 9, n - 1]
    t.apply(1, rows(spark, [(str(i), 2, i, True, None) for i in hit]))
    got = {int(r["k"]) for r in t.read().select("k").collect()}
    assert set(range(n)) - got == set(hit)


def test_another_object_on_the_same_folder_goes_on(spark):
    changes = [[("a", 10, 1, False, "new"), ("b", 1, 2, False, "b")], [("a", 5, 3, False, "old")], [("b", 2, 4, True, None), ("c", 1, 5, False, "c")]]
    root = work_dir(spark, "t")
    again = lambda: cdc.VectorTable(spark, root, "key", ["ms", "n"], ["etag"])
    for i, part in enumerate(changes):
        again().apply(i, rows(spark, part))
        again().apply(i, rows(spark, [("z", 99, 99, False, "never")]))  # finished before: left as it is
    assert live(again()) == {"a": "new", "c": "c"}
    with pytest.raises(ValueError):
        cut = cdc.VectorTable(spark, root, "key", ["ms", "n"], ["etag"])
        cut.finished.add(7)
        again().apply(6, rows(spark, changes[0]))


def test_a_batch_cut_short_is_applied_again(spark, monkeypatch):
    t = table(spark)
    t.apply(0, rows(spark, [("a", 1, 1, False, "1"), ("b", 1, 1, False, "b")]))
    with monkeypatch.context() as patch:
        patch.setattr(t.finished, "add", lambda *a: 1 / 0)  # everything is written but the ledger
        with pytest.raises(ZeroDivisionError):
            t.apply(1, rows(spark, [("a", 2, 2, False, "half")]))
    assert live(t) == {"a": "1", "b": "b"}
    t.apply(1, rows(spark, [("a", 2, 2, False, "2")]))
    assert live(t) == {"a": "2", "b": "b"}


def test_compaction(spark):
    t = table(spark)
    for i in range(3):
        t.apply(i, rows(spark, [(f"k{j}", i, j, j % 7 == i, f"{i}") for j in range(i * 20, 60)]))
    want, n = live(t), t._read("data").count()
    t.compact()
    assert live(t) == want and t._read("data").count() == 60 < n
    t.vacuum()
    t.apply(3, rows(spark, [("k5", 9, 9, False, "9"), ("k6", -1, 9, False, "late")]))
    assert live(t) == want | {"k5": "9"}


F_ = "key string, action string, etag string, event_time string, size long, copied boolean, arrival long"
T1, T2 = "2026-01-01T00:00:00Z", "2026-01-01T00:00:00.000+00:00"


def feed(spark, root, batches):
    for i, b in enumerate(batches):
        ObjectFeed(spark, root).apply(i, spark.createDataFrame(b, F_))
    return {r["k"]: r["etag"] for r in ObjectFeed(spark, root).read().collect()}


@pytest.mark.parametrize("cut", [1, 2, 3, 6])
def test_feed_with_copies_ties_and_unsound_firsts(spark, cut):
    deliveries = [
        ("a", "PutObject", "A", T1, 1, False, 1), ("a", "PutObject", "B", T2, 1, False, 2), ("a", "PutObject", "A", T1, 1, False, 3),  # a copy of A does not win the tie
        ("b", "PutObject", "X", T1, -1, False, 4), ("b", "PutObject", "Y", T1, 1, False, 5), ("b", "PutObject", "X", T1, 1, False, 6),  # X is sound late, its place is its first copy's
        ("c", "DeleteObject", None, T1, None, False, 7), ("c", "PutObject", "C", "2025-12-31T23:59:59.999Z", 1, False, 8),
        ("d", "Unknown", "D", T1, 1, False, 9), (None, "PutObject", "E", T1, 1, False, 10), ("f", "PutObject", "F", "no time", 1, False, 11), ("g", "PutObject", None, T1, None, False, 12),
    ]
    per = len(deliveries) // cut
    got = feed(spark, work_dir(spark, "f"), [deliveries[i : i + per] for i in range(0, len(deliveries), per)])
    assert got == {"a": "B", "b": "Y", "g": None}
