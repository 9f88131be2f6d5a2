"""Deterministic ids, digests and masks as built-in expressions."""

from __future__ import annotations

import hashlib
import hmac
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\u001f"  # between the parts of a name


def uuid5(namespace: uuid.UUID, *parts: Column) -> Column:
    """UUID version 5 of the parts' texts joined by UNIT; null if any part is null."""
    name = F.encode(F.array_join(F.array(*[p.cast("string") for p in parts]), UNIT, ""), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, text)


def run_key(key: bytes, run: str) -> bytes:
    """A masking key of one run, so that masks of different runs can't be linked."""
    return hmac.new(key, run.encode(), hashlib.sha256).digest()


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, from two SHA-256 with pads made on the driver.

    The pads stand in the plan: do not show plans of masking queries.
    """
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def mask(kind: Column, value: Column, key: bytes) -> Column:
    """``kind:mask_`` and 24 digits; null if kind or value is null."""
    return F.concat(kind, F.lit(":mask_"), F.substring(hmac_sha256(key, F.concat(kind, F.lit(":"), value)), 1, 24))
