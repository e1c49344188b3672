"""Has this key been seen before? Scalable Bloom chains over hash shards, in the order of arrival.

Rows are split by a hash of the key, each shard is sorted by arrival and passed through one chain
(:mod:`auditlake.functions.bloom`), which holds some ten to twenty bits per different key and never the keys themselves.
A key that holds a large share of all rows is thinned out before the shuffle: of equal keys within one Arrow batch all but
the earliest are certainly repeats; they skip the filter and are spread over all shards by position.
The number of shards is a parameter: raise it with the number of different keys, so that a shard's chain stays in the tens of
megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.bloom import BloomChain, Layer
from auditlake.session import ship
from auditlake.sources.ledger import Ledger

#: The bound on the chance that a new key is called old, and the keys of a chain's first layer.
ERROR, CAPACITY = 0.001, 1024
#: Hash shards, a chain each: a fixed number, so that the answers are the same on every cluster.
SHARDS = 256


def exact_bytes(key: Column) -> Column:
    """Bytes that are equal just where the texts are: 64 lower-case hex digits at half their length, others as they are."""
    return F.when(key.rlike(r"\A[0-9a-f]{64}\z"), F.concat(F.unhex(F.lit("00")), F.unhex(key))).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(key, "UTF-8")))


def keyed(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """``pos`` and ``key`` (bytes) of the rows that have a key."""
    return df.filter(key.isNotNull()).select(order.cast("long").alias("pos"), exact_bytes(key.cast("string")).alias("key"))


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = b.column("key").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        pos = b.column("pos").to_numpy(zero_copy_only=False)
        by = np.lexsort((pos, codes))
        repeat = np.zeros(len(by), bool)
        repeat[by[1:]] = (codes[by][1:] == codes[by][:-1]) & (pos[by][1:] > pos[by][:-1])
        flag = pa.array(repeat)
        yield pa.RecordBatch.from_arrays([b.column("pos"), pc.if_else(flag, pa.scalar(None, b.column("key").type), b.column("key")), flag], ["pos", "key", "certain"])


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """Items with their shard and the two hashes for its chain. Shards are fixed in number, so answers do not depend on the cluster."""
    ship(rows.sparkSession)
    thin = rows.mapInArrow(_thin, "pos long, key binary, certain boolean")
    shard = F.pmod(F.when(F.col("certain"), F.xxhash64("pos")).otherwise(F.xxhash64("key")), F.lit(shards)).cast("int")
    # The hashes in the chain differ from the one that places the rows: all keys of a shard share bits of that.
    return thin.select(shard.alias("shard"), "pos", "key", "certain", F.xxhash64(F.lit(3), F.col("key")).alias("h1"), F.xxhash64(F.lit(7), F.col("key"), F.lit(11)).alias("h2"))


def _runs(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The parts of a batch that belong to one shard."""
    shards = b.column("shard").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if low < high:
            yield int(shards[low]), b.slice(low, high - low)


def _ask(chain: BloomChain, part: pa.RecordBatch) -> np.ndarray:
    certain = part.column("certain").to_numpy(zero_copy_only=False).astype(bool)
    ask, seen = np.flatnonzero(~certain), certain.copy()
    h1, h2 = (part.column(c).to_numpy(zero_copy_only=False).view(np.uint64)[ask] for c in ("h1", "h2"))
    seen[ask] = chain.test_and_add(h1, h2)
    return seen


def answers(rows: DataFrame, error: float = ERROR, capacity: int = CAPACITY, only_seen: bool = False, shards: int = SHARDS) -> DataFrame:
    """Of :func:`keyed` rows: ``pos``, ``key``, ``seen`` (the filter's answer) and ``certain`` (``seen`` by comparison).

    ``seen`` is never false for a repeat, and true for a new key with a chance below ``error``. Ties in ``pos`` are
    ordered arbitrarily. ``key`` is null where ``certain``. Rows with a null key are no cases and do not come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chain = None, None
        for b in batches:
            seen = []
            for s, part in _runs(b):
                if s != shard:
                    shard, chain = s, BloomChain(error, capacity)
                seen.append(_ask(chain, part))
            flags = pa.array(np.concatenate(seen) if seen else np.zeros(0, bool))
            out = pa.RecordBatch.from_arrays([b.column("pos"), b.column("key"), flags, b.column("certain")], ["pos", "key", "seen", "certain"])
            yield out.filter(flags) if only_seen else out

    placed = _placed(rows, shards).repartition("shard").sortWithinPartitions("shard", "pos")
    return placed.mapInArrow(run, "pos long, key binary, seen boolean, certain boolean")


class SeenStore:
    """Chains that outlive a run: each batch is answered against all earlier ones, whose keys are not kept.

    ``root/batch=N`` holds the answers of batch N, the layers that became full in it (written once, here) and the layer each
    shard was filling when it ended. A batch reads all full layers and the last unfinished ones, and writes only its own
    folder, so it can be run again until it stands in the ledger ``finished``. The number of shards is fixed for the life of the
    store: choose it so that a shard's share of all keys ever, at some 15 to 25 bits each, stays in the tens of megabytes.
    """

    SCHEMA = "kind string, shard int, layer int, pos long, key binary, seen boolean, certain boolean, chain binary"

    def __init__(self, root: str, shards: int = 64, error: float = ERROR, capacity: int = CAPACITY) -> None:
        self.root, self.shards, self.error, self.capacity = root, shards, error, capacity

    def _layers(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        """``shard``, ``layer``, ``chain`` and whether the layer is full, as the last of the batches left them."""
        rows = spark.read.schema(f"batch int, {self.SCHEMA}").option("basePath", self.root).parquet(*[f"{self.root}/batch={n}" for n in batches])
        return rows.filter((F.col("kind") == "full") | ((F.col("kind") == "active") & (F.col("batch") == batches[-1]))).select("shard", "layer", "chain", (F.col("kind") == "full").alias("full"))

    def apply(self, number: int, rows: DataFrame) -> None:
        """Answer batch ``number`` of :func:`keyed` rows and add its keys; rising numbers, a finished batch is left as it is."""
        spark, error, capacity = rows.sparkSession, self.error, self.capacity
        finished = Ledger(spark, f"{self.root}/finished")
        done = finished.numbers()
        if number in done:
            return
        if done and number < done[-1]:
            raise ValueError(f"batch {done[-1]} is finished; {number} comes too late")
        names = ["kind", "shard", "layer", "pos", "key", "seen", "certain", "chain"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, chain, old = None, None, 0

            def stored() -> pa.RecordBatch:
                last = len(chain.layers) - 1
                made = [("active" if i == last else "full", shard, i, None, None, None, None, x.to_bytes()) for i, x in enumerate(chain.layers) if i >= old or i == last]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)

            for b in batches:
                for s, part in _runs(b):
                    if s != shard:
                        if chain is not None and chain.layers:
                            yield stored()
                        shard, chain, old = s, BloomChain(error, capacity), 0
                    held = part.filter(pc.is_valid(part.column("chain")))
                    chain.layers += [Layer.from_bytes(x) for x in held.column("chain").to_pylist()]
                    old += sum(held.column("certain").to_pylist())  # of stored layers: full, and so written before
                    new = part.filter(pc.is_null(part.column("chain")))
                    n = len(new)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(["answer"] * n, pa.string()), new.column("shard"), pa.nulls(n, pa.int32()), new.column("pos"), new.column("key"), pa.array(_ask(chain, new)), new.column("certain"), pa.nulls(n, pa.binary())], names
                    )
            if chain is not None and chain.layers:
                yield stored()

        items = _placed(rows, self.shards).select("shard", F.lit(1).alias("ord"), "pos", "key", "certain", "h1", "h2", F.lit(None).cast("binary").alias("chain"))
        if done:
            none = lambda t: F.lit(None).cast(t)
            before = self._layers(spark, done)
            items = items.unionByName(before.select("shard", F.lit(0).alias("ord"), F.col("layer").cast("long").alias("pos"), none("binary").alias("key"), F.col("full").alias("certain"), none("long").alias("h1"), none("long").alias("h2"), "chain"))
        placed = items.repartition(self.shards, "shard").sortWithinPartitions("shard", "ord", "pos")
        placed.mapInArrow(run, self.SCHEMA).write.mode("overwrite").partitionBy("kind").parquet(f"{self.root}/batch={number}")
        finished.add(number)

    def answers(self, spark: SparkSession, number: int) -> DataFrame:
        """``pos``, ``key``, ``seen``, ``certain`` of a batch's rows, as :func:`answers` gives them for one batch."""
        return spark.read.schema(self.SCHEMA).parquet(f"{self.root}/batch={number}").filter("kind = 'answer'").select("pos", "key", "seen", "certain")


def repeats(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """The exact check of the filter's positive answers: ``pos`` of those whose key really occurs at a smaller ``pos``.

    ``candidates`` should be a written table (it is read twice). First positions are combined on the map side.
    """
    first = rows.groupBy("key").agg(F.min("pos").alias("first"))
    asked = candidates.filter("seen AND NOT certain").select("pos", "key").join(first, "key").filter("pos > first").select("pos")
    return candidates.filter("certain").select("pos").unionByName(asked)
