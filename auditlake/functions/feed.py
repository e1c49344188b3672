"""Rules of change notifications: classes, reasons for refusal, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.rfc3339 import epoch_ms

WRITES = ("PutObject", "CopyObject", "CompleteMultipartUpload")
DELETES = ("DeleteObject", "LifecycleDeletion")
ACTIONS = WRITES + DELETES
ETAG = r"\A[\x21\x23-\x7e]{1,256}\z"
BUCKET = r"\A[a-z0-9][a-z0-9-]{1,61}[a-z0-9]\z"
MAX_KEY_BYTES = 1024
MAX_SAFE = 2**53 - 1


def good_key(c: Column) -> Column:
    return c.isNotNull() & F.octet_length(c).between(1, MAX_KEY_BYTES)


def is_delete(action: Column) -> Column:
    return action.isin(*DELETES)


def invalid_reason(action: Column, key: Column, size: Column, etag: Column, event_time: Column, copied: Column) -> Column:
    """The first rule a message of the monitored bucket breaks, naming the field and never its value; null if sound.

    ``copied``: whether the message has a copy source.
    """
    deletion = F.coalesce(is_delete(action), F.lit(False))
    return (
        F.when(action.isNull() | ~action.isin(*ACTIONS), "action")
        .when(~good_key(key), "object.key")
        .when(size.isNotNull() & ~size.between(0, MAX_SAFE), "object.size")
        .when(etag.isNotNull() & ~etag.rlike(ETAG), "object.etag")
        .when(epoch_ms(event_time).isNull(), "event_time")
        .when(deletion & size.isNotNull(), "object.size on a deletion")
        .when(deletion & etag.isNotNull(), "object.etag on a deletion")
        .when(copied & (action != "CopyObject"), "copy_source")
    )
