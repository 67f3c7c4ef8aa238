"""HMAC-SHA256 from built-in hash functions, evaluated in the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a text column under a shared secret."""
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(body, "UTF-8")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)
