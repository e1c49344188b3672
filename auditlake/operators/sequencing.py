"""Gapless numbering and time-windowed deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.operators.dedupe import free
from auditlake.session import ship

#: Order numbers per block: blocks are numbered side by side.
BLOCK = 65_536


def _numbered(rows: DataFrame, part: str, order: str, name: str) -> DataFrame:
    """Rows ranked within their part, plus the running total of the parts before; drops ``part``."""
    n, offset, local = (free(rows, x) for x in ("__n", "__offset", "__local"))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    before = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1)
    joined = ranked.join(counts.select(part, before.alias(offset)), part)
    return joined.withColumn(name, F.col(offset) + F.col(local)).drop(part, local, offset)


def number(df: DataFrame, order: str, name: str = "seq", block: int = BLOCK) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... by the unique, non-negative integer ``order``, without one task that sees all rows.

    Rows are counted per block of order numbers; the running total of the (few) blocks is each block's offset, and rows
    are ranked within their block. The blocks are fixed by the order numbers, so a repeated run gives the same numbers.
    Rows with a null ``order`` have no place and are left out.
    """
    part = free(df, "__block")
    return _numbered(df.filter(F.col(order).isNotNull()).withColumn(part, F.expr(f"`{order}` div {block}")), part, order, name)


#: About so many texts are looked at to cut the order into ranges.
BOUND_SAMPLE = 20_000


def number_by_text(df: DataFrame, order: str, name: str = "seq", ranges: int = 256) -> DataFrame:
    """As :func:`number`, by a unique text in the order of its UTF-8 bytes. Null texts are left out.

    A sample of bounded size, chosen by hash and so the same in every run, says where to cut the order into ranges; all
    rows are then counted per range and ranked in theirs. Uneven ranges cost balance, not correctness.
    """
    df = df.filter(F.col(order).isNotNull())
    every = max(1, df.count() // BOUND_SAMPLE)
    sample = sorted((r[0] for r in df.filter(F.pmod(F.xxhash64(order), F.lit(every)) == 0).select(order).collect()), key=str.encode)
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)} if sample else set(), key=str.encode)

    def search(low: int, high: int) -> Column:
        """How many cuts lie at or below the text, known to be in [low, high]."""
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(F.col(order) >= cuts[middle - 1], search(middle, high)).otherwise(search(low, middle - 1))

    part = free(df, "__range")
    return _numbered(df.withColumn(part, search(0, len(cuts))), part, order, name)


def window_dedupe(df: DataFrame, ident: Column, time: Column, row: Column, ttl: int, stored: DataFrame | None = None) -> DataFrame:
    """``row`` and ``accepted``: whether the last accepted copy of the identifier had expired when this one came.

    A copy is accepted at or after ``ttl`` behind the last *accepted* one; a refused copy extends nothing. Copies are
    ordered by (time, row). One value per task is kept: rows are sorted by identifier and passed through in that order.
    Rows with a null identifier or time do not come out. ``stored`` (``id``, ``t``): copies accepted earlier; they come first
    whatever their time.
    """
    ship(df.sparkSession)
    rows = df.select(ident.alias("id"), time.cast("long").alias("t"), row.cast("long").alias("row"), F.lit(True).alias("new")).filter("id IS NOT NULL AND t IS NOT NULL")
    if stored is not None:
        rows = rows.unionByName(stored.groupBy("id").agg(F.max("t").alias("t")).select("id", "t", F.lit(None).cast("long").alias("row"), F.lit(False).alias("new")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, expires = None, 0
        for b in batches:
            out, at = [], []
            for i, (ident_, t, new) in enumerate(zip(b.column("id").to_pylist(), b.column("t").to_pylist(), b.column("new").to_pylist(), strict=True)):
                fresh = ident_ != current or expires <= t
                if fresh or not new:
                    current, expires = ident_, t + ttl
                if new:
                    out.append(fresh)
                    at.append(i)
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(at, pa.int64())), pa.array(out, pa.bool_())], ["row", "accepted"])

    return rows.repartition("id").sortWithinPartitions("id", "new", "t", "row").mapInArrow(run, "row long, accepted boolean")
