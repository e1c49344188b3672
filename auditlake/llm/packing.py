"""Filling containers of one capacity with items of varying length.

Only the histogram of lengths (at most one count per length up to the capacity) reaches the driver. Dynamic programming over
it chooses the boundaries of length buckets such that padding items to their bucket's bound wastes the least; batches of
up to ``capacity`` tokens form inside each bucket, the longest first, and room left over in a batch is filled with slots of
shorter buckets. The plan is a table of a few hundred rows; every item finds its container by its rank within its bucket,
which is counted per shard and offset, never by one sort.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.session import work_dir

CAPACITY, BUCKETS = 4096, 256
#: Items per shard in which ranks are counted.
SHARD_ROWS = 200_000


def boundaries(counts: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding. ``counts``: number by length >= 1.

    An item is padded to the upper bound of its bucket. What the slots leave of a container is not counted here: it is
    filled from shorter buckets.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    number = np.array([counts[int(x)] for x in lengths], dtype=np.float64)
    n = np.concatenate([[0], np.cumsum(number)])
    s = np.concatenate([[0], np.cumsum(number * lengths)])
    m, b = len(lengths), min(buckets, len(lengths))
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = np.zeros((b + 1, m + 1), np.int32)
    for k in range(1, b + 1):
        # The k-th bucket is lengths i..j-1. The least i never falls as j grows, so each j is sought only between the
        # answers of the nearest j on either side, level by level of a bisection.
        now = np.full(m + 1, np.inf)
        js, low, high = np.array([m]), np.array([k - 1]), np.array([m - 1])
        left, right = np.array([k - 1]), np.array([m])  # the answered j (or the end) on either side of each j
        at = np.full(m + 2, k - 1)
        while len(js):
            width = high - low + 1
            begin = np.cumsum(width) - width
            owner = np.repeat(np.arange(len(js)), width)
            i = np.arange(width.sum()) - begin[owner] + low[owner]
            j = js[owner]
            cost = best[i] + (n[j] - n[i]) * lengths[j - 1] - (s[j] - s[i])
            least = np.minimum.reduceat(cost, begin)
            hits = np.flatnonzero(cost == least[owner])
            hits = hits[np.unique(owner[hits], return_index=True)[1]]
            now[js], back[k, js], at[js] = least, i[hits], i[hits]
            ends = [(x, y) for x, j_, y in zip(left, js, right, strict=True) for x, y in ((x, j_), (j_, y)) if y - x > 1]
            left, right = (np.array(c, dtype=np.int64) for c in (zip(*ends, strict=True) if ends else ((), ())))
            js = (left + right) // 2
            low = np.maximum(at[left], k - 1)
            high = np.minimum(at[right], js - 1)
        best = now
    out, j = [], m
    for k in range(b, 0, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[k, j])
    return out[::-1]


@dataclass(frozen=True)
class Segment:
    """Items of rank ``start`` and above of a bucket go to containers from ``base`` on, ``slots`` in each."""

    bucket: int
    start: int
    base: int
    slots: int


def plan(uppers: list[int], sizes: list[int], capacity: int) -> tuple[list[Segment], int]:
    """Segments for buckets with upper bounds ``uppers`` and ``sizes`` items, and the number of containers."""
    left, taken, made = list(sizes), [0] * len(sizes), 0
    out: list[Segment] = []
    for b in reversed(range(len(uppers))):
        while left[b]:
            room, recipe = capacity, []
            for c in range(b, -1, -1):
                k = min(room // uppers[c], left[c])
                if k:
                    recipe.append((c, k))
                    room -= k * uppers[c]
            times = max(1, min(left[c] // k for c, k in recipe))
            for c, k in recipe:
                out.append(Segment(c, taken[c], made, k))
                used = min(left[c], k * times)
                taken[c] += used
                left[c] -= used
            made += times
    return out, made


def pack(lengths: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Container of every item. ``lengths``: ``row`` (sortable) and ``length`` (long; null: no item).

    Columns: ``row``, ``piece``, ``first`` (offset of the piece in the item), ``tokens``, ``container``. An item within
    the capacity is one piece. A longer one is cut into full pieces and a rest, each of which has its container. An
    item of length 0 takes no space and rides in container 0; a null length gives one row with null ``container``.
    Repeated rows are items of their own. The items should be a written table: they are read more than once.
    """
    if capacity < 1 or buckets < 1:
        raise ValueError("capacity and buckets are at least 1")
    spark = lengths.sparkSession
    last = F.greatest(F.ceil(F.col("length") / capacity) - 1, F.lit(0)).cast("long")
    items = lengths.select("row", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(0).cast("long")))).alias("piece"))
    items = items.select("row", "piece", (F.col("piece") * capacity).alias("first"), F.when(F.col("length").isNotNull(), F.least(F.col("length") - F.col("piece") * capacity, F.lit(capacity))).cast("long").alias("tokens"))
    counts = {r["tokens"]: r["n"] for r in items.filter("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    uppers = boundaries(counts, buckets)
    edges = np.array(uppers, dtype=np.int64)
    sizes = [0] * len(uppers)
    for length, n in counts.items():
        sizes[int(np.searchsorted(edges, length))] += n
    segments, _ = plan(uppers, sizes, capacity)
    shards = [-(-n // SHARD_ROWS) for n in sizes]  # a large bucket's items are ranked side by side

    bucket = F.size(F.filter(F.array(*[F.lit(u).cast("long") for u in uppers]) if uppers else F.array().cast("array<bigint>"), lambda u: u < F.col("tokens")))
    placed = items.filter("tokens > 0").withColumn("bucket", bucket)
    of = F.element_at(F.array(*map(F.lit, shards or [1])), F.col("bucket") + 1)
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), of))
    per = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("bucket", "shard", offset.alias("offset"))
    local = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row", "piece")) - 1
    ranked = placed.withColumn("local", local).join(per, ["bucket", "shard"]).withColumn("rank", F.col("local") + F.col("offset"))
    table = spark.createDataFrame([(s.bucket, s.start, s.base, s.slots) for s in segments], "bucket int, start long, base long, slots long")
    table = table.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("start", "base", "slots"))).alias("segments"))  # one row per bucket
    # The last segment that starts at or before the rank, by halving.
    steps = max([1, *Counter(s.bucket for s in segments).values()]).bit_length()
    ends = F.struct(F.lit(1).alias("low"), (F.size("segments") + 1).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        here = (middle > at["low"]) & (F.element_at("segments", middle)["start"] <= F.col("rank"))
        return F.struct(F.when(here, middle).otherwise(at["low"]).alias("low"), F.when(here | (middle == at["low"]), at["high"]).otherwise(middle).alias("high"))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, halve, lambda x: x["low"])
    found = ranked.join(F.broadcast(table), "bucket").withColumn("s", F.element_at("segments", at))
    container = (F.col("s.base") + F.floor((F.col("rank") - F.col("s.start")) / F.col("s.slots"))).cast("long")
    rest = items.filter("tokens IS NULL OR tokens <= 0").withColumn("container", F.when(F.col("tokens").isNotNull(), F.lit(0).cast("long")))
    return found.select("row", "piece", "first", "tokens", container.alias("container")).unionByName(rest)


def written(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
