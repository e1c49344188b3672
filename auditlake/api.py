"""One object per data folder, with a method per registered query."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from auditlake.plans import audit, log, merkle, problems, streams, witness


class AuditLake:
    """``AuditLake(spark, folder).reconcile_findings()`` and so on; ``queries`` lists the names.

    Queries that take parameters (pages, ranges) accept them by keyword.
    """

    queries: dict[str, Callable[..., DataFrame]] = {n: f for part in (problems, log, merkle, audit, streams, witness) for n, f in part.QUERIES.items()}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        if name in type(self).queries:
            return partial(type(self).queries[name], self.spark, self.folder)
        raise AttributeError(name)

    def __dir__(self) -> list[str]:
        return sorted({*super().__dir__(), *type(self).queries})
