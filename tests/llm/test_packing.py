import random
from collections import defaultdict
from functools import cache

import pytest

from auditlake.llm import packing, queries


def padding(counts, uppers):
    return sum(n * (min(u for u in uppers if u >= x) - x) for x, n in counts.items())


def least_padding(counts, buckets):
    lengths = sorted(counts)

    @cache
    def best(k, j):
        if j == 0:
            return 0 if k >= 0 else float("inf")
        if k == 0:
            return float("inf")
        return min(best(k - 1, i) + sum(counts[x] * (lengths[j - 1] - x) for x in lengths[i:j]) for i in range(j))

    return best(min(buckets, len(lengths)), len(lengths))


def test_boundaries_are_optimal():
    r = random.Random(1)
    for _ in range(200):
        counts = {r.randint(1, 60): r.randint(1, 9) for _ in range(r.randint(1, 16))}
        buckets = r.randint(1, 9)
        uppers = packing.boundaries(counts, buckets)
        assert len(uppers) <= buckets and uppers == sorted(uppers) and uppers[-1] == max(counts)
        assert padding(counts, uppers) == least_padding(counts, buckets)
    assert packing.boundaries({}, 4) == []


def test_plan_places_every_item_within_the_capacity():
    r = random.Random(2)
    for _ in range(200):
        capacity = r.randint(10, 100)
        uppers = sorted(r.sample(range(1, capacity + 1), r.randint(1, min(8, capacity))))
        sizes = [r.randint(1, 60) for _ in uppers]
        segments, made = packing.plan(uppers, sizes, capacity)
        used = defaultdict(int)
        for b, n in enumerate(sizes):
            own = sorted((s for s in segments if s.bucket == b), key=lambda s: s.start)
            for rank in range(n):
                s = [x for x in own if x.start <= rank][-1]
                used[s.base + (rank - s.start) // s.slots] += uppers[b]
        assert max(used.values()) <= capacity and set(used) == set(range(made))


S = "row long, length long, tokens string, piece string, bucket string"


def packed(spark, lengths, **more):
    df = packing.written(spark.createDataFrame([(*x, "a", "b", "c") for x in lengths], S), "t")
    return packing.pack(df, **more).collect()


@pytest.mark.parametrize("capacity,buckets", [(100, 5), (100, 64), (7, 3)])
def test_every_item_once_and_whole(spark, capacity, buckets):
    r = random.Random(3)
    lengths = [(i, r.choice([0, 1, 2, r.randint(1, 30), r.randint(50, 130), r.randint(1, 900)])) for i in range(1500)]
    rows = packed(spark, lengths, capacity=capacity, buckets=buckets)
    held, pieces = defaultdict(int), defaultdict(list)
    for x in rows:
        held[x["container"]] += x["tokens"]
        pieces[x["row"]].append((x["first"], x["tokens"]))
    assert max(held.values()) <= capacity
    for i, n in lengths:
        p = sorted(pieces[i])
        assert sum(t for _, t in p) == n and [a for a, _ in p] == [k * capacity for k in range(len(p))]
        assert len(p) == max(1, -(-n // capacity))
    if buckets == 64:
        used = [c for c in held if held[c]]
        assert sum(held.values()) / (len(used) * capacity) > 0.95


def test_ranks_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    rows = packed(spark, [(i, 33 if i % 3 else i % 90 + 1) for i in range(2000)], capacity=100)
    held = defaultdict(int)
    for x in rows:
        held[x["container"]] += x["tokens"]
    assert len(rows) == 2000 and max(held.values()) <= 100 and sum(held.values()) / (100 * len(held)) > 0.97


def test_nulls_empty_items_repeats_and_none(spark):
    rows = packed(spark, [(1, None), (2, 0), (3, 5), (3, 5), (None, 5)], capacity=10)
    got = sorted(((x["row"], x["tokens"], x["container"]) for x in rows), key=repr)
    assert (1, None, None) in got and (2, 0, 0) in got and len(got) == 5
    assert len({c for _, t, c in got if t}) == 2
    assert packed(spark, []) == []
    assert [(x["tokens"], x["container"]) for x in packed(spark, [(1, 0)])] == [(0, 0)]


def test_hot_length(spark):
    rows = packed(spark, [(i, 33) for i in range(3000)] + [(i, i % 90 + 1) for i in range(3000, 4000)], capacity=100)
    held = defaultdict(int)
    for x in rows:
        held[x["container"]] += x["tokens"]
    assert max(held.values()) <= 100 and len(held) <= 1.03 * sum(held.values()) / 99


def test_on_the_corpus(spark, folder):
    r = queries.p7_fill(spark, folder).first()
    assert r["fullest"] <= packing.CAPACITY and r["used"] > 0.8
