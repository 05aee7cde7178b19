"""HMAC-SHA256 from built-in hashing."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column


def hmac_sha256(key: bytes, message) -> Column:
    """Hex HMAC-SHA256 with a driver-side key; the pads are computed once."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, as_column(message).cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)
