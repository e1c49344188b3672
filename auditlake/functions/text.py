"""Text, bytes and hashes as JVM expressions: canonical JSON, hex and base64, HMAC, Merkle hashes, hash sampling."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters with a short escape (fixed by JSON).
SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(c: Column) -> Column:
    """A JSON string literal in canonical form: controls escaped in lower-case hex, everything else as it is. Null stays null.

    Texts without a control character, nearly all, take two replacements; the others one per kind of control.
    """
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(32):
        ch = chr(code)
        full = F.replace(full, F.lit(ch), F.lit(SHORT.get(ch, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def json_array(*items: Column) -> Column:
    """A canonical JSON array of already encoded items; null items become ``null``."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(i, F.lit("null")) for i in items]), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """A canonical JSON object of already encoded values: names sorted by their UTF-8 bytes, null values left out."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields, key=lambda k: k.encode())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def event_id(bucket: Column, key: Column, action: Column, etag: Column, event_time: Column) -> Column:
    """Hex SHA-256 of the canonical array of the fields that identify a change; a missing etag is ``null``."""
    return sha256_hex(json_array(*map(json_string, (bucket, key, action, etag, event_time))))


def hmac_sha256_hex(key: bytes, c: Column) -> Column:
    """HMAC-SHA256 by two nested hashes over the padded key; keys over 64 bytes are hashed first."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def sampled(scan_id: Column, key: Column, rate: float) -> Column:
    """Whether the first 32 bits of the SHA-256 of ``[scan_id, key]``, as a fraction, lie below ``rate``."""
    head = F.substring(sha256_hex(json_array(json_string(scan_id), json_string(key))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0) < F.lit(rate)


def base64(c: Column) -> Column:
    """Base64 on one line (Spark's own breaks it after 76 characters)."""
    return F.regexp_replace(F.base64(c), r"[\r\n]", "")


def strict_base64(c: Column) -> Column:
    """Bytes of canonical base64, null for any other text (re-encoding must give the same text)."""
    raw = F.try_to_binary(c, F.lit("base64"))
    return F.when(base64(raw) == c, raw)


def strict_hex(c: Column) -> Column:
    """Bytes of lower-case hex of even length, null for any other text."""
    return F.when(c.rlike(r"\A([0-9a-f]{2})*\z"), F.unhex(c))
