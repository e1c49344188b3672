"""A feed of object changes, applied batch by batch: identifiers are remembered, states kept in a table with delete vectors.

A change is known by its identifier (key, action, etag and time as written); its copies may differ elsewhere. It counts once one
of its copies is sound, and its place among changes of the same millisecond is that of its first copy, sound or not. Each
batch is combined by identifier and joined with the stored identifiers of the same weeks of event time (a copy has its
change's time, so no other week can hold it); what is new or has just become sound is stored and applied. So the cost of a batch
follows the weeks it touches and not the length of the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.feed import invalid_reason, is_delete
from auditlake.functions.rfc3339 import epoch_ms
from auditlake.operators.cdc import VectorTable
from auditlake.operators.dedupe import message_id
from auditlake.session import folders

#: Identifiers are stored by spans of event time.
SPAN_MS = 7 * 24 * 3_600_000


class ObjectFeed:
    """``table`` is the state below ``root/table``; identifiers lie in ``root/ids/batch=N/part=P``. Batches come in order of arrival.

    Rows of a batch: ``key``, ``action``, ``etag``, ``event_time``, ``size``, ``copied`` (boolean) and ``arrival`` (unique long, lower
    in earlier batches). An unsound row is no change, but may be the first copy of one. A batch finished before is left as it is.
    """

    SCHEMA = "ident binary, first long, sound boolean, key string, etag string, deleted boolean, event_ms long, part long"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.table = VectorTable(spark, f"{root}/table", "key", ["event_ms", "first"], ["etag"])

    def apply(self, number: int, rows: DataFrame) -> None:
        done = self.table.finished.numbers()
        if number in done:
            return
        action, key, etag, time = (F.col(c) for c in ("action", "key", "etag", "event_time"))
        no = lambda t: F.lit(None).cast(t)
        # What copies have in common is judged first: without it no copy can be sound.
        rows = rows.filter(invalid_reason(action, key, no("long"), etag, time, F.lit(False)).isNull())
        sound = invalid_reason(action, key, F.col("size"), etag, time, F.col("copied")).isNull()
        new = rows.groupBy("key", "action", "etag", "event_time").agg(F.min("arrival").alias("first"), F.max(sound).alias("sound"))
        new = new.select(
            message_id([key, action, etag, time]).alias("ident"), "first", "sound", "key", "etag", is_delete(action).alias("deleted"), epoch_ms(time).alias("event_ms"),
        ).withColumn("part", F.floor(F.col("event_ms") / SPAN_MS).cast("long"))
        place = lambda df, to: df.write.mode("overwrite").partitionBy("part").parquet(to)
        if done:
            place(new, f"{self.root}/new")  # written, so that the messages are judged once and the weeks are known from the folders
            spans = [int(f.removeprefix("part=")) for f in folders(self.spark, f"{self.root}/new") if f.startswith("part=")]
            new = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/new")
            kept = self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.root}/ids").parquet(*[f"{self.root}/ids/batch={n}" for n in done]).filter(F.col("part").isin(spans))
            kept = kept.groupBy("ident").agg(F.min("first").alias("known"), F.max("sound").alias("was"))
            new = new.join(kept, "ident", "left").filter("known IS NULL OR (sound AND NOT was)")
            new = new.withColumn("first", F.coalesce("known", "first")).select(*[c.split()[0] for c in self.SCHEMA.split(", ")])
        place(new, f"{self.root}/ids/batch={number}")
        written = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/ids/batch={number}")
        self.table.apply(number, written.filter("sound"))

    def read(self, tombstones: bool = False) -> DataFrame:
        return self.table.read(tombstones)
