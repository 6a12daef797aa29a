"""Digests and stable identifiers built from JVM-side expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

URL_NAMESPACE = uuid.NAMESPACE_URL.bytes


def sha256_label(col: Column) -> Column:
    """`sha256:<hex>` of a string or binary column."""

    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def sorted_json(**fields: Column) -> Column:
    """JSON text of the fields with sorted keys and kept nulls.

    Meant for strings, integers, booleans and nested values of those.
    """

    return F.to_json(
        F.struct(*[fields[name].alias(name) for name in sorted(fields)]),
        {"ignoreNullFields": "false"},
    )


def hmac_sha256(key: bytes, col: Column) -> Column:
    """Hex HMAC-SHA256 of a string column under a driver-side key."""

    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    first = F.sha2(F.concat(inner, F.encode(col, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID text of `name` in the URL namespace."""

    digest = F.sha1(F.concat(F.lit(bytearray(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(
        F.hex(
            F.conv(F.substring(digest, 17, 2), 16, 10)
            .cast("bigint")
            .bitwiseAND(F.lit(0x3F))
            .bitwiseOR(F.lit(0x80))
        )
    )
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 19, 2),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )
