import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions.fingertree import FingerTree
from auditlake.operators import late

H = late.HOUR


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("iiiiiiq e".replace(" ", "")), st.integers(-500, 500), st.integers(0, 60)), max_size=400))
def test_tree_against_a_list(steps):
    tree, rows, floor = FingerTree(), [], None
    for what, t, n in steps:
        if what == "i":
            ok = floor is None or t >= floor
            assert tree.insert(t, 1, n) == ok
            if ok:
                rows.append((t, n))
        elif what == "q":
            inside = [x for x in rows if t <= x[0] < t + 5 * n]
            assert tree.total(t, t + 5 * n) == (len(inside), sum(x[1] for x in inside))
        else:
            floor = t if floor is None else max(floor, t)
            tree.evict(t)
            rows = [x for x in rows if x[0] >= floor]
        assert len(tree) == len(rows)
    assert tree.check() == sorted({x[0] for x in rows})


def test_tree_large_and_mostly_in_order():
    r, tree, rows = random.Random(1), FingerTree(), []
    for i in range(20_000):
        t = i * 10 - (r.randrange(5000) if r.random() < 0.1 else 0)
        tree.insert(t, 1, 1)
        rows.append(t)
        if i % 2500 == 2499:
            tree.evict(t - 50_000)
            rows = [x for x in rows if x >= t - 50_000]
            assert tree.check() == sorted(set(rows))
    assert tree.total(100_000, 180_000)[0] == sum(100_000 <= x < 180_000 for x in rows)


def outcome(event, arrival):
    end = event // H * H + H
    return "on_time" if arrival < end else "correction" if arrival <= end + 6 * H else "cut_off"


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, event long, arrival long, size long, row string, period string").repartition(3)


def cols():
    return F.col("seq"), F.col("event"), F.col("arrival")


def test_edges_and_random(spark):
    rows = [(0, 0, H - 1, 1), (1, 0, H, 1), (2, 0, 7 * H, 1), (3, 0, 7 * H + 1, 1), (4, 5 * H, 0, 1), (5, H - 1, H, None), (6, -1, 0, 2)]
    r = random.Random(3)
    rows += [(i, r.randrange(50 * H), r.randrange(60 * H), r.choice([None, 1, 10])) for i in range(10, 1500)]
    df = frame(spark, [(*x, "x", "y") for x in rows])
    got = {x["row"]: (x["period"], x["outcome"]) for x in late.outcomes(df, *cols()).collect()}
    assert got == {s: (e // H * H, outcome(e, a)) for s, e, a, _ in rows}
    totals = {x["period"]: x for x in late.corrected(df, *cols(), F.col("size")).collect()}
    for p in {e // H * H for _, e, _, _ in rows}:
        own = [(outcome(e, a), z or 0) for _, e, a, z in rows if e // H * H == p]
        t = totals[p]
        assert t["first_count"] == sum(k == "on_time" for k, _ in own) and t["first_size"] == sum(z for k, z in own if k == "on_time")
        assert t["count"] == sum(k != "cut_off" for k, _ in own) and t["size"] == sum(z for k, z in own if k != "cut_off")
        assert t["cut_off"] == sum(k == "cut_off" for k, _ in own) and t["corrections"] == sum(k == "correction" for k, _ in own)


def test_nulls_repeats_and_empty(spark):
    df = frame(spark, [(1, None, 5, 1, "a", "b"), (2, 5, None, 1, "a", "b"), (3, 5, 6, None, None, None), (3, 5, 6, None, None, None), (None, 7, 8, 2, "", "")])
    assert sorted((x["row"] or 0, x["outcome"]) for x in late.outcomes(df, *cols()).collect()) == [(0, "on_time"), (3, "on_time"), (3, "on_time")]
    assert {(x["period"], x["count"], x["size"], x["cut_off"]) for x in late.corrected(df, *cols(), F.col("size")).collect()} == {(0, 3, 2, 0), (None, 0, 0, 2)}
    empty = frame(spark, [])
    assert late.outcomes(empty, *cols()).count() == 0 and late.corrected(empty, *cols(), F.col("size")).count() == 0
