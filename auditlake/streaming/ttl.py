"""Deduplication within a time to live, as a stateful streaming operator.

A copy is accepted if the last *accepted* one of its identifier has expired; a refused copy extends nothing. (Spark's
``dropDuplicatesWithinWatermark`` expires by event time and is another operator.) The session must use the RocksDB state
store: ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditlake.session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WithinTtl(StatefulProcessor):
    """``idle`` milliseconds (of the machine's clock) after its last accepted copy an identifier is forgotten."""

    def __init__(self, ttl: int, idle: int) -> None:
        self.ttl, self.idle = ttl, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expires = handle.getValueState("expires", "expires long", self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        expires = self.expires.get()[0] if self.expires.exists() else None
        parts = [(p["t"].to_numpy(np.int64), p["row"].to_numpy(np.int64)) for p in rows]  # sixteen bytes a row of one micro-batch
        t, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((row, t))
        t, kept, at, new = t[by], [], 0, False
        while at < len(t):
            if expires is not None and t[at] < expires:
                at = int(np.searchsorted(t, expires))  # over the copies that are refused
                continue
            expires, new = int(t[at]) + self.ttl, True
            kept.append(at)
            at += 1
        if new:
            self.expires.update((expires,))
        yield pd.DataFrame({"row": row[by[kept]], "t": t[kept]} if kept else {"row": np.zeros(0, np.int64), "t": np.zeros(0, np.int64)})

    def close(self) -> None:
        pass


def accepted(stream: DataFrame, ttl: int, idle: int | None = None) -> DataFrame:
    """``row``, ``t`` of the accepted rows of a stream with ``id``, ``t`` (long, milliseconds) and ``row`` (long).

    Identifiers are forgotten after ``idle`` milliseconds of processing (by default twice ``ttl``, so that a stream may lie still
    for as long as ``ttl`` without accepting a copy it should not). A query that is to end by itself (``availableNow``) needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off: state that expires asks for further batches without end.
    """
    ship(stream.sparkSession)
    return stream.groupBy("id").transformWithStateInPandas(WithinTtl(ttl, 2 * ttl if idle is None else idle), outputStructType="row long, t long", outputMode="append", timeMode="ProcessingTime")
