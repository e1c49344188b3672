import random

import pytest
from pyspark.sql import functions as F

from auditlake import notes
from auditlake.operators import merkle as m

#: Published roots of the first n of eight well-known leaves (RFC 6962 test vectors).
LEAVES = ["", "00", "10", "2021", "3031", "40414243", "5051525354555657", "606162636465666768696a6b6c6d6e6f"]
ROOTS = [
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "6e340b9cffb37a989ca544e6bb780a2c78901d3fb33738768511a30617afa01d", "fac54203e7cc696cf0dfcb42c92a1d9dbaf70ad9e621f4bd8d98662f00e3c125",
    "aeb6bcfe274b70a14fb067a5e5578264db0fa9b51af5e0ba159158f329e06e77", "d37ee418976dd95753c1c73862b9398fa2a2cf9b4ff0fdfe8b30cd95209614b7", "4e3bbb1f7b478dcfe71fb631631519a3bca12c9aefca1612bfce4c13a86264d4",
    "76e67dadbcdf1e10e1b74ddc608abd2f98dfb16fbce75277b5232a127f2087ef", "ddb89be403809e325750d3d263cd78929c2942b7942a34b77e122c9594a74c8c", "5dc9da79a70659a9ad559cb701ded9a2ab9d823aad2f4960cfe370eff4604328",
]


def naive(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << ((len(leaves) - 1).bit_length() - 1)
    return notes.pair(naive(leaves[:k]), naive(leaves[k:]))


def path(i, leaves):
    if len(leaves) == 1:
        return []
    k = 1 << ((len(leaves) - 1).bit_length() - 1)
    return [*path(i, leaves[:k]), naive(leaves[k:])] if i < k else [*path(i - k, leaves[k:]), naive(leaves[:k])]


def hashes(spark, n):
    return spark.range(n).select(F.col("id").alias("index"), m.leaf_hash(F.encode(F.col("id").cast("string"), "UTF-8")).alias("hash"))


def leaf_list(n):
    return [notes.leaf(str(i).encode()) for i in range(n)]


def test_published_roots(spark):
    for n in (0, 1, 3, 6, 8):
        df = spark.createDataFrame([(i, bytes.fromhex(x)) for i, x in enumerate(LEAVES[:n])], "seq long, entry binary")
        assert m.root(m.leaves(df)).first()["root"] == ROOTS[n]


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 700])
def test_roots_and_proofs(spark, n):
    want = leaf_list(n)
    df = hashes(spark, n)
    assert m.root(df).first()["root"] == naive(want).hex()
    groups = m.levels(df)
    pick = sorted({0, n - 1, n // 2, min(n - 1, 255)})
    proofs = m.inclusion_proofs(groups, df.filter(F.col("index").isin(pick))).join(df, "index")
    assert m.inclusion_proofs(groups).count() == n
    got = proofs.select("index", "proof", m.proof_root(F.col("index"), F.lit(n), F.col("hash"), F.col("proof")).alias("r")).collect()
    assert len(got) == (len(pick) if n > 1 else 1)
    for r in got:
        assert [bytes(x) for x in r["proof"]] == path(r["index"], want) and bytes(r["r"]) == naive(want)


def test_consistency(spark):
    n = 300
    want, tree = leaf_list(n), m.nodes(hashes(spark, n)).cache()
    for old in (1, 2, 3, 128, 255, 256, 257, 299, 300):
        proof = [bytes(r["hash"]) for r in m.consistency_proof(tree, old, n).orderBy("pos").collect()] if old < n else []
        assert notes.roots_of_proof(old, n, naive(want[:old]), proof) == (naive(want[:old]), naive(want))
        if proof:
            bad = [bytes([proof[0][0] ^ 1]) + proof[0][1:], *proof[1:]]
            assert notes.roots_of_proof(old, n, naive(want[:old]), bad) != (naive(want[:old]), naive(want))
            assert notes.roots_of_proof(old, n, naive(want[:old]), proof[:-1]) != (naive(want[:old]), naive(want))
    with pytest.raises(ValueError):
        m.consistency_ranges(0, 5)


def ranges_by_recursion(m_, low, high, whole=True):
    """RFC 6962, 2.1.2, word for word."""
    n = high - low
    if m_ == n:
        return [] if whole else [(low, high)]
    k = 1 << ((n - 1).bit_length() - 1)
    if m_ <= k:
        return [*ranges_by_recursion(m_, low, low + k, whole), (low + k, high)]
    return [*ranges_by_recursion(m_ - k, low + k, high, False), (low, low + k)]


def test_consistency_ranges_of_all_sizes():
    for n in range(1, 70):
        for old in range(1, n + 1):
            assert m.consistency_ranges(old, n) == ranges_by_recursion(old, 0, n)


def test_growth_step_by_step(spark):
    want, edges, old = leaf_list(700), {}, 0
    tiles = {}
    for size in (1, 2, 255, 256, 257, 300, 512, 700):
        new, edges = m.grown(hashes(spark, size).filter(F.col("index") >= old), old, size, edges)
        tiles |= {(r["level"], r["index"], r["width"]): [bytes(x) for x in r["hashes"]] for r in new.collect()}
        assert m.edge_root(size, edges) == naive(want[:size])
        for r in m.tiles(hashes(spark, size)).collect():
            assert tiles[r["level"], r["index"], r["width"]] == [bytes(x) for x in r["hashes"]]
        old = size
    assert m.edge_root(0, {}).hex() == m.EMPTY_ROOT


def test_proofs_of_wrong_length_or_place_fail(spark):
    n, want = 11, leaf_list(11)
    rows = [(i, want[i], path(i, want)) for i in range(n)]
    cases = [(i, leaf, p[:-1]) for i, leaf, p in rows] + [(i, leaf, [*p, leaf]) for i, leaf, p in rows] + [(i ^ 1, leaf, p) for i, leaf, p in rows if i ^ 1 < n]
    df = spark.createDataFrame(cases, "i long, leaf binary, proof array<binary>")
    got = [r[0] for r in df.select(m.proof_root(F.col("i"), F.lit(n), F.col("leaf"), F.col("proof"))).collect()]
    assert all(x is None or bytes(x) != naive(want) for x in got)


def test_tiles(spark):
    t = spark.range(1).select(F.inline(m.tile_coordinates(F.lit(70_000)))).groupBy("level").agg(F.count_if(F.col("width") == 256).alias("full"), F.max(F.when(F.col("width") < 256, F.col("width"))).alias("part")).orderBy("level").collect()
    assert [(r["level"], r["full"], r["part"]) for r in t] == [(0, 273, 112), (1, 1, 17), (2, 0, 1)]
    got = {(r["level"], r["index"]): r["width"] for r in m.tiles(hashes(spark, 600)).collect()}
    assert got == {(0, 0): 256, (0, 1): 256, (0, 2): 88, (1, 0): 2}
    assert m.tiles(hashes(spark, 0)).count() == 0


def test_paths(spark):
    df = spark.createDataFrame([(0,), (999,), (1000,), (1234067,)], "i long")
    assert [r[0] for r in df.select(m.index_path(F.col("i"))).collect()] == ["000", "999", "x001/000", "x001/x234/067"]
    df = spark.createDataFrame([(1, 5, 256), (1, 5, 3), (None, 0, 1)], "l int, i long, w int")
    assert [r[0] for r in df.select(m.tile_path(*map(F.col, "liw"))).collect()] == ["tile/1/005", "tile/1/005.p/3", "tile/entries/000.p/1"]


def test_bundles_round_trip(spark):
    r = random.Random(2)
    rows = [(i, bytes(r.randrange(256) for _ in range(r.choice([0, 1, 300, 65_535 if i == 7 else 5])))) for i in range(600)]
    df = spark.createDataFrame(rows, "seq long, entry binary")
    back = {x["seq"]: bytes(x["entry"]) for x in m.bundle_entries(m.bundles(df)).collect()}
    assert back == dict(rows)
    with pytest.raises(Exception, match="lengths"):
        m.bundle_entries(m.bundles(df.limit(1)).withColumn("data", F.concat("data", F.unhex(F.lit("00"))))).collect()


def test_powers(spark):
    df = spark.createDataFrame([(1,), (70_000,), (2**40 + 1,)], "n long")
    assert [r[0] for r in df.select(m.powers(F.col("n"))).collect()] == [[1], [65536, 4096, 256, 64, 32, 16], [2**40, 1]]


def test_paths_read_back(spark):
    good = {"tile/0/000": (0, 0, 256), "tile/entries/x001/x234/067.p/9": (None, 1234067, 9), "tile/5/x001/000": (5, 1000, 256), "tile/63/000.p/255": (63, 0, 255)}
    bad = ["", "tile/0", "tile/0/", "tile/0/00", "tile/0/0000", "tile/00/000", "tile/64/000", "tile/0/x000/001", "tile/0/001/000", "tile/0/000.p/0", "tile/0/000.p/256", "tile/0/000.p/01", "tile/x/000", "tile/0/000\n", " tile/0/000", None]
    df = spark.createDataFrame([(p,) for p in [*good, *bad]], "path string")
    got = {r["path"]: r["p"] and tuple(r["p"]) for r in df.select("path", m.parse_path(F.col("path")).alias("p")).collect()}
    assert got == good | dict.fromkeys(bad)


def test_entries_at(spark):
    log = spark.createDataFrame([(i, f"e{i}".encode()) for i in range(600)], "seq long, entry binary")
    wanted = spark.createDataFrame([(3,), (3,), (255,), (256,), (599,), (600,), (9_999,)], "seq long")
    assert sorted((r["seq"], bytes(r["entry"])) for r in m.entries_at(m.bundles(log), wanted).collect()) == [(i, f"e{i}".encode()) for i in (3, 255, 256, 599)]
    assert m.entries_at(m.bundles(log), wanted.limit(0)).count() == 0
