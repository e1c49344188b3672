"""RFC 3339 text to whole milliseconds, as JVM expressions (no UDF, independent of the session's time zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, 'T', time, at most nine fraction digits, and a mandatory offset.
PATTERN = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?"
    r"(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
)


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 of an RFC 3339 text; finer digits are cut off.

    Null for null, for other notations, for a missing offset and for dates that do not exist (30 February, second 60).
    Offsets run to 23:59, further than Spark's own parser goes, so the offset is applied by hand.
    """
    seconds = F.unix_seconds(F.concat(F.substring(c, 1, 19), F.lit("Z")).try_cast("timestamp"))
    zone = F.when(F.endswith(c, F.lit("Z")), F.lit(1)).otherwise(F.lit(6))
    digits = F.substr(c, F.lit(21), F.least(F.lit(3), F.greatest(F.lit(0), F.length(c) - 20 - zone)))
    millis = F.when(F.substring(c, 20, 1) == ".", F.rpad(digits, 3, "0").try_cast("int")).otherwise(F.lit(0))
    minutes = F.substring(c, -5, 2).try_cast("int") * 60 + F.substring(c, -2, 2).try_cast("int")
    offset = F.when(zone == 1, F.lit(0)).when(F.substring(c, -6, 1) == "-", -minutes).otherwise(minutes)
    return F.when(c.rlike(PATTERN), seconds * 1000 + millis - offset.cast("long") * 60_000)


def iso_hour(ms: Column) -> Column:
    """``yyyy-MM-ddTHH`` in UTC of epoch milliseconds."""
    days = F.floor(ms / F.lit(86_400_000)).cast("int")
    hour = (F.pmod(ms, F.lit(86_400_000)) / 3_600_000).cast("int")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"))


def iso_ms(ms: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` in UTC of epoch milliseconds."""
    rest = F.pmod(ms, F.lit(3_600_000))
    pad = lambda c, n: F.lpad(F.floor(c).cast("string"), n, "0")
    return F.concat(
        iso_hour(ms), F.lit(":"), pad(rest / 60_000, 2), F.lit(":"), pad(rest % 60_000 / 1000, 2), F.lit("."), pad(rest % 1000, 3), F.lit("Z")
    )
