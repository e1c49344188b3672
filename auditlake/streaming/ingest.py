"""Structured Streaming: the same operators, batch by batch, with effects that happen once.

Every sink writes folders named after the batch, so a batch that is run again after a failure overwrites its own output and
nothing else; numbers and identifiers of earlier batches are read from what those batches left behind.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.operators import late
from auditlake.operators.cdc import VectorTable
from auditlake.operators.dedupe import dedupe_batch
from auditlake.operators.feed import ObjectFeed
from auditlake.operators.sequencing import number, window_dedupe
from auditlake.session import remove
from auditlake.sources.ledger import Ledger


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    one = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0]) if one else reader.parquet(path)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process all there is and stop; a later call with the same checkpoint goes on behind it."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LogSink:
    """Appends the new events of each batch to a log, numbered without gaps over all batches.

    Without ``ttl`` an identifier is logged once ever: a batch is anti-joined with all that are stored. With ``ttl`` (in the units
    of the long column ``time``) it is logged again once its last logged copy has expired, and only the identifiers that may
    still be alive are read; batches whose identifiers have all expired are pruned, so a batch costs the same however long the
    log is. Batches then come in order of time; a row that comes later than that is judged as of its batch.

    ``root``: ``ids/batch=N`` (identifiers and times), ``log/batch=N`` (numbered rows), ``finished`` (the ledger, with the next
    number and the newest time). The rows need ``ident`` and a unique non-negative integer ``order``; rows without identifier
    (or, with ``ttl``, time) are left out. A finished batch is left as it is; one that was cut short overwrites its own folders.
    """

    def __init__(self, spark: SparkSession, root: str, ident: str, order: str, time: str | None = None, ttl: int | None = None) -> None:
        if (time is None) != (ttl is None):
            raise ValueError("a time to live needs a time, and the other way round")
        self.spark, self.root, self.ident, self.order, self.time, self.ttl = spark, root, ident, order, time, ttl
        self.finished = Ledger(spark, f"{root}/finished")

    def _ids(self, batches: list[int], kind: str) -> DataFrame | None:
        t = self.time or "t"
        paths = [f"{self.root}/ids/batch={n}" for n in batches]
        return self.spark.read.schema(f"`{self.ident}` {kind}, `{t}` long").parquet(*paths) if paths else None

    def __call__(self, rows: DataFrame, batch: int) -> None:
        done = self.finished.numbers()
        if batch in done:
            return
        notes = {n: json.loads(self.finished.note(n)) for n in (done if self.ttl else done[-1:])}
        start = notes[done[-1]]["next"] if done else 0
        kind = rows.schema[self.ident].dataType.simpleString()
        rows = rows.filter(F.col(self.ident).isNotNull())
        if self.ttl is None:
            kept, _ = dedupe_batch(rows, self._ids(done, kind), [F.col(self.order)], self.ident)
            when, alive = F.lit(None).cast("long"), done
        else:
            low = rows.agg(F.min(self.time)).first()[0]
            alive = [n for n in done if low is None or notes[n]["newest"] is None or notes[n]["newest"] > low - self.ttl]
            for n in set(done) - set(alive):
                remove(self.spark, f"{self.root}/ids/batch={n}")  # expired, all of them
            stored = self._ids(alive, kind)
            fresh = window_dedupe(rows, F.col(self.ident), F.col(self.time), F.col(self.order), self.ttl, stored=stored if stored is None else stored.select(F.col(self.ident).alias("id"), F.col(self.time).alias("t")))
            kept = rows.join(fresh.filter("accepted").select(F.col("row").alias(self.order)), self.order, "left_semi")
            when = F.col(self.time)
        write = lambda df, what: df.write.mode("overwrite").parquet(f"{self.root}/{what}/batch={batch}")
        write(number(kept, self.order).withColumn("seq", F.col("seq") + F.lit(start)), "log")
        written = self.spark.read.parquet(f"{self.root}/log/batch={batch}")
        write(written.select(self.ident, when.alias(self.time or "t")), "ids")
        n, newest = self._ids([batch], kind).agg(F.count(F.lit(1)), F.max(self.time or "t")).first()
        self.finished.add(batch, json.dumps({"next": start + n, "newest": newest}))

    def log(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/log/batch={n}" for n in self.finished.numbers()])


class CorrectedPeriods:
    """Per-period aggregates over a stream of late events: every batch adds its partial results, a read sums them up.

    Rows are judged by their own arrival time, so it does not matter into which batch they fall.
    """

    def __init__(self, spark: SparkSession, root: str, row: str, event: str, arrival: str, size: str, period: int = late.HOUR, lateness: int = 6 * late.HOUR) -> None:
        self.spark, self.root, self.columns, self.period, self.lateness = spark, root, (row, event, arrival, size), period, lateness

    def __call__(self, rows: DataFrame, batch: int) -> None:
        part = late.corrected(rows, *map(F.col, self.columns), period=self.period, lateness=self.lateness)
        part.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def read(self) -> DataFrame:
        names = ("first_count", "first_size", "count", "size", "cut_off", "corrections")
        return self.spark.read.parquet(f"{self.root}/*").groupBy("period").agg(*[F.sum(n).alias(n) for n in names])


def apply_changes(table: VectorTable | ObjectFeed) -> Callable[[DataFrame, int], None]:
    """Applies each batch to a table kept with delete vectors, or to a feed of object changes in front of one."""
    return lambda rows, batch: table.apply(batch, rows)
