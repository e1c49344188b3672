"""Per-period aggregates by event time over late, out-of-order events.

Rows are dealt out evenly; each task sorts its share by arrival and feeds it to a finger B-tree of partial aggregates
(:mod:`auditlake.functions.fingertree`). Arrival moves the clock; when a period is over its aggregate is stored; it stays open
until ``lateness`` after its end and is then evicted in bulk. Rows that change a stored aggregate are its corrections, later
ones are cut off. A row is judged by its own arrival time, so shares need not see each other: besides the dealing out only the
partial results are shuffled (one row per share and period), and neither a hot period nor a hot key can skew it. A tree holds
only the open times of its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.fingertree import FingerTree
from auditlake.session import ship, spread

HOUR = 3_600_000


def _prepared(df: DataFrame, row: Column, event: Column, arrival: Column, size: Column, partitions: int | None) -> DataFrame:
    ship(df.sparkSession)
    cols = df.select(row.alias("row"), event.cast("long").alias("event"), arrival.cast("long").alias("arrival"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    return spread(cols.filter("event IS NOT NULL AND arrival IS NOT NULL"), partitions).sortWithinPartitions("arrival", "row")


class Replay:
    """The aggregates of one stream of rows in order of arrival, kept in a finger B-tree.

    When a period is over, its partial aggregate is read from the tree and stored. A later row that the tree still takes is
    a correction just if the tree's aggregate of its period then differs from the stored one, which it replaces.
    """

    def __init__(self, period: int, lateness: int) -> None:
        self.period, self.lateness, self.tree = period, lateness, FingerTree()
        self.floor: int | None = None
        self.edge: int | None = None
        self.first: dict[int, tuple[int, int]] = {}  # periods that are over and open to corrections: as of their end
        self.stored: dict[int, tuple[int, int]] = {}  # the same, as corrected so far
        self.started: set[int] = set()  # periods that are not over
        self.late: dict[int, int] = {}
        self.done: list[tuple] = []

    def _end(self, now: int | None) -> None:
        for s in [p for p in self.started if now is None or p + self.period <= now]:
            self.started.discard(s)
            self.first[s] = self.stored[s] = self.tree.total(s, s + self.period)

    def _close(self, upto: int | None) -> None:
        for s in sorted(p for p in self.first if upto is None or p < upto):
            self.done.append((s, *self.first.pop(s), *self.stored.pop(s), self.late.pop(s, 0)))

    def add(self, event: int, now: int, size: int) -> str:
        """``on_time``, ``correction`` or ``cut_off``. Arrivals never go backwards."""
        period = self.period
        if self.edge is None or now // period * period > self.edge:
            self.edge = now // period * period
            self._end(now)
        low = -((self.lateness + period - now) // period) * period
        if self.floor is None or low > self.floor:
            self._close(low)
            self.tree.evict(low)
            self.floor = low
        start = event // period * period
        if not self.tree.insert(event, 1, size):
            self.late[start] = self.late.get(start, 0) + 1
            return "cut_off"
        if start >= self.edge:
            self.started.add(start)
            return "on_time"
        before, after = self.stored.get(start, (0, 0)), self.tree.total(start, start + period)
        self.first.setdefault(start, before)
        self.stored[start] = after
        return "correction" if after != before else "on_time"

    def taken(self, least: int = 1) -> list[tuple]:
        """Finished periods, once there are ``least`` of them."""
        if len(self.late) > 4096:  # periods long gone: their counts are handed on, not kept
            for s in [p for p in self.late if p not in self.first and p not in self.started]:
                self.done.append((s, 0, 0, 0, 0, self.late.pop(s)))
        out = self.done if len(self.done) >= least else []
        if out:
            self.done = []
        return out

    def finish(self) -> None:
        self._end(None)
        self._close(None)
        self.done.extend((s, 0, 0, 0, 0, n) for s, n in self.late.items())
        self.late = {}


def _replayed(prepared: DataFrame, period: int, lateness: int, keep: tuple[str, ...], periods: bool) -> DataFrame:
    """One pass over each split: its rows of the outcomes in ``keep``, and with ``periods`` its partial results."""
    names = ["row", "period", "outcome", "first_count", "first_size", "count", "size", "cut_off"]
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = Replay(period, lateness)

        def partial(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * 6
            n = len(done)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(cols[0], pa.int64()), pa.nulls(n, pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names)

        for b in batches:
            rows, starts, outcomes_ = [], [], []
            for row_, event_, now, size_ in zip(*(b.column(c).to_pylist() for c in ("row", "event", "arrival", "size")), strict=True):
                outcome = replay.add(event_, now, size_)
                if outcome in keep:
                    rows.append(row_)
                    starts.append(event_ // period * period)
                    outcomes_.append(outcome)
            if rows:
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(outcomes_, pa.string()), *[pa.nulls(n, pa.int64())] * 5], names)
            done = replay.taken(4096)
            if periods and done:
                yield partial(done)
        replay.finish()
        if periods:
            yield partial(replay.taken())

    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True))
    return prepared.mapInArrow(run, schema)


def outcomes(
    df: DataFrame, row: Column, event: Column, arrival: Column, period: int = HOUR, lateness: int = 6 * HOUR, keep: tuple[str, ...] = ("on_time", "correction", "cut_off"),
    size: Column | None = None, partitions: int | None = None,
) -> DataFrame:
    """``row`` (long), ``period`` (its start in ms) and ``outcome`` of each row, of the outcomes asked for.

    ``row`` must not repeat if the order of rows that arrive together matters to you; ties in arrival have no effect on
    the outcome. Rows with a null event or arrival time belong to no period and do not come out (:func:`corrected`
    counts them). A correction changes the stored aggregate of a period that is over: it arrives at or after the period's end and
    at most ``lateness`` after it, both ends included. ``partitions``: as for :func:`auditlake.session.spread`.
    """
    prepared = _prepared(df, row, event, arrival, F.lit(0) if size is None else size, partitions)
    return _replayed(prepared, period, lateness, keep, False).select("row", "period", "outcome")


def corrected(df: DataFrame, row: Column, event: Column, arrival: Column, size: Column, period: int = HOUR, lateness: int = 6 * HOUR, partitions: int | None = None) -> DataFrame:
    """One row per period: what was known at its end, and what it became when the lateness was over.

    Columns: ``period`` (start, ms), ``first_count``, ``first_size`` (on time), ``count``, ``size`` (with corrections),
    ``corrections``, ``cut_off`` (rows too late, in no total). A null size adds nothing. Rows without a usable event or
    arrival time are reported as one row with a null period, counted in ``cut_off``.
    """
    parts = _replayed(_prepared(df, row, event, arrival, size, partitions), period, lateness, (), True).drop("row", "outcome")
    lost = df.filter(event.isNull() | arrival.isNull()).groupBy().agg(F.count(F.lit(1)).alias("cut_off")).filter("cut_off > 0")
    lost = lost.selectExpr("cast(null AS long) period", "0L first_count", "0L first_size", "0L count", "0L size", "cut_off")
    total = parts.unionByName(lost).groupBy("period").agg(*[F.sum(c).alias(c) for c in ("first_count", "first_size", "count", "size", "cut_off")])
    return total.withColumn("corrections", F.col("count") - F.col("first_count"))
