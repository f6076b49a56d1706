"""Keyed and canonical digests as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 hex digest, built from two ``sha2`` calls so it stays inside code generation."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    inner_digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, inner_digest), 256)


def hmac_sha256_by_column(key: Column, message: Column) -> Column:
    """As above with the key (text of at most 64 bytes) in a column."""
    padded = F.rpad(F.hex(F.encode(key, "UTF-8")), 128, "0")
    nibbles = {f"{i:X}": i for i in range(16)}

    def pad(byte: int) -> Column:
        high, low = byte >> 4, byte & 15
        # XOR with a repeated byte maps each hex digit on its own: odd places by ``high``, even places by ``low``.
        high_map = "".join(f"{v ^ high:X}" for v in nibbles.values())
        low_map = "".join(f"{v ^ low:X}" for v in nibbles.values())
        digits = "".join(nibbles)
        pairs = F.regexp_extract_all(padded, F.lit(".."), F.lit(0))
        mapped = F.transform(pairs, lambda p: F.concat(
            F.translate(F.substring(p, 1, 1), digits, high_map), F.translate(F.substring(p, 2, 1), digits, low_map)))
        return F.unhex(F.array_join(mapped, ""))

    inner_digest = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner_digest), 256)


def indicator_hash(key: bytes, kind: Column, value: Column) -> Column:
    return hmac_sha256(key, F.concat(kind, F.lit("\0"), value))


def session_marker(key: bytes, session: Column) -> Column:
    return F.substring(hmac_sha256(key, F.concat(F.lit("session\0"), session.cast("string"))), 1, 32)


def canonical_json(*columns: Column) -> Column:
    """Compact JSON with the fields in the order given; sort them by name for a canonical form."""
    return F.to_json(F.struct(*columns))
