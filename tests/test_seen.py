import random

import numpy as np
from pyspark.sql import functions as F

from auditlake.functions.bloom import BloomChain
from auditlake.operators import seen
from auditlake.session import work_dir


def hashes(n, seed):
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, n, dtype=np.uint64), r.integers(0, 2**64, n, dtype=np.uint64)


def test_chain_never_misses_and_keeps_its_bound():
    chain = BloomChain(0.01, 256)
    h1, h2 = hashes(60_000, 1)
    wrong = 0
    for i in range(0, len(h1), 1000):
        wrong += int(chain.test_and_add(h1[i : i + 1000], h2[i : i + 1000]).sum())
    assert chain.has(h1, h2).all() and len(chain.layers) > 5
    assert wrong / len(h1) < 0.01 and chain.bound < 0.011
    assert all(x.fill < 0.52 for x in chain.layers)
    new1, new2 = hashes(50_000, 2)
    assert chain.has(new1, new2).mean() < 0.01
    assert [x.capacity for x in chain.layers[:3]] == [256, 512, 1024] and chain.layers[1].error < chain.layers[0].error


def test_repeats_within_one_call():
    chain = BloomChain(0.001, 16)
    h1, h2 = hashes(50, 3)
    twice1, twice2 = np.concatenate([h1, h1[::-1]]), np.concatenate([h2, h2[::-1]])
    assert chain.test_and_add(twice1, twice2).tolist() == [False] * 50 + [True] * 50
    assert chain.test_and_add(h1[:0], h2[:0]).tolist() == []


def found(spark, rows):
    df = spark.createDataFrame(rows, "pos long, id string, key string, seen boolean").repartition(3)
    keyed = seen.keyed(df, F.col("id"), F.col("pos"))
    path = work_dir(spark, "s")
    seen.answers(keyed).write.parquet(path)
    answered = spark.read.parquet(path)
    return {r["pos"]: r["seen"] for r in answered.collect()}, sorted(r["pos"] for r in seen.repeats(keyed, answered).collect())


def test_exact(spark):
    r = random.Random(5)
    ids = [r.choice(["hot", "A" * 64, "a" * 64, "a" * 63, "", None, "z" * 100_000, *(f"{i:064x}" for i in range(300))]) for _ in range(3000)]
    ids = [x if r.random() < 0.7 else "hot" for x in ids]
    order = list(range(len(ids)))
    r.shuffle(order)
    answers, repeats = found(spark, [(p, ids[p], "k", None) for p in order])
    before, want = set(), []
    for p, x in enumerate(ids):
        if x is not None and x in before:
            want.append(p)
        before.add(x)
    assert repeats == want
    assert all(answers[p] for p in want) and set(answers) == {p for p, x in enumerate(ids) if x is not None}


def test_empty_and_all_null(spark):
    assert found(spark, []) == ({}, [])
    assert found(spark, [(1, None, None, None), (2, None, None, None)]) == ({}, [])


def test_store_over_batches(spark):
    r = random.Random(6)
    ids = [r.choice(["hot", *(f"k{i}" for i in range(400))]) if r.random() < 0.8 else f"once{p}" for p in range(4000)]
    df = spark.createDataFrame(list(enumerate(ids)), "pos long, id string").repartition(3)
    keyed = seen.keyed(df, F.col("id"), F.col("pos"))
    store = seen.SeenStore(work_dir(spark, "store"), shards=5, capacity=16)
    cuts = [0, 1, 1500, 1500, 4000]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        store.apply(i, keyed.filter((F.col("pos") >= low) & (F.col("pos") < high)))
    store.apply(3, keyed.filter(F.col("pos") >= 1500))  # again
    got = {x["pos"]: x["seen"] for i in range(4) for x in store.answers(spark, i).collect()}
    before, wrong = set(), 0
    for p, x in enumerate(ids):
        assert got[p] or x not in before
        wrong += got[p] and x not in before
        before.add(x)
    assert len(got) == len(ids) and wrong <= 5


def test_layer_round_trip():
    h1, h2 = hashes(300, 9)
    chain = BloomChain(0.01, 64)
    chain.test_and_add(h1, h2)
    from auditlake.functions.bloom import Layer

    again = BloomChain(0.01, 64)
    again.layers = [Layer.from_bytes(x.to_bytes()) for x in chain.layers]
    assert again.has(h1, h2).all() and [x.count for x in again.layers] == [x.count for x in chain.layers]
