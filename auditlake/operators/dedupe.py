"""Messages delivered at least once: one copy of each is kept.

Rows are partitioned by message identifier and ranked by arrival with a deterministic tie-break; the first is kept. Spark
plans ``row_number() = 1`` with a partial group limit before the shuffle, so of an identifier that holds a third of all
rows only one row per map task is shuffled. New batches are anti-joined against the stored identifiers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ID = "__message_id"


def free(df: DataFrame, name: str) -> str:
    """A column name the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def message_id(fields: Sequence[Column]) -> Column:
    """SHA-256 (32 bytes) of an injective encoding of the identifier's fields; null is a value and equals null.

    Each field is prefixed with its length in bytes, so different fields never run together into the same text.
    """
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("~")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def with_id(df: DataFrame, fields: Sequence[Column], required: Sequence[Column] = ()) -> DataFrame:
    """Adds the identifier as ``__message_id`` (a column of that name is replaced); null where a required field is missing (such a row is nobody's copy)."""
    ident = message_id(fields)
    for c in required:
        ident = F.when(c.isNotNull(), ident)
    return df.withColumn(ID, ident)


def _first(df: DataFrame, order: Sequence[Column], ident: str) -> DataFrame:
    rank = free(df, "__rank")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(ident).orderBy(*order)))
    return ranked.filter(F.col(rank) == 1).drop(rank)


def keep_first(df: DataFrame, order: Sequence[Column], ident: str = ID) -> DataFrame:
    """The first row of each identifier by ``order`` (make it total: ties would be resolved arbitrarily).

    Rows without identifier are kept, all of them. Empty input gives no rows. Extra columns pass unchanged.
    """
    return _first(df.filter(F.col(ident).isNotNull()), order, ident).unionByName(df.filter(F.col(ident).isNull()))


def dedupe_batch(batch: DataFrame, stored: DataFrame | None, order: Sequence[Column], ident: str = ID) -> tuple[DataFrame, DataFrame]:
    """Of a new batch, the rows to keep, and the identifiers to add to the store (a table with the column ``ident``).

    The batch is ranked first, so each side of the anti-join holds an identifier once and no key is skewed.
    """
    first = keep_first(batch, order, ident)
    if stored is not None:
        first = first.join(stored.select(ident), ident, "left_anti")  # null identifiers never match and stay
    return first, first.filter(F.col(ident).isNotNull()).select(ident)


def copies(df: DataFrame, fields: Sequence[Column], required: Sequence[Column], arrival: str) -> DataFrame:
    """The rows that :func:`keep_first` leaves out, as their (unique) ``arrival`` numbers.

    Rows that lack a required field are nobody's copy. The kept rows are two columns wide; the rest is an anti-join on the
    arrival number, which is spread evenly whatever the identifiers are.
    """
    present = df
    for c in required:
        present = present.filter(c.isNotNull())
    kept = _first(present.select(message_id(fields).alias(ID), arrival), [F.col(arrival)], ID)
    return present.select(arrival).join(kept.select(arrival), arrival, "left_anti")
