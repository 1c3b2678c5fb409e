"""Keyed hashing as plain Column expressions (no Python worker)."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NET24_BUCKETS, PSEUDONYM_CHARS
from .columns import as_col

PSEUDONYM_KEY_VAR = "HOSTWATCH_PSEUDONYM_KEY"
LEDGER_KEY_VAR = "HOSTWATCH_LEDGER_KEY"
_BLOCK = 64


def key_from_env(var: str, env: dict | None = None) -> bytes:
    """A key from the environment; an unset key raises, there is no default."""
    key = (os.environ if env is None else env).get(var, "")
    if not key:
        raise RuntimeError(f"key variable {var!r} is unset; refusing to run with a default key")
    return key.encode("utf-8")


def sha256_hex(c: str | Column) -> Column:
    return F.sha2(as_col(c), 256)


def hmac_sha256_hex(key: bytes, message: str | Column) -> Column:
    """HMAC-SHA256 of a text or binary column, as lower-case hex."""
    if not key:
        raise ValueError("key must be non-empty")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    body = F.sha2(F.concat(inner, as_col(message).cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(body)), 256)


def pseudonym(ip_text: str | Column, key: bytes, heldout: bool = False,
              split: str | Column = "train") -> Column:
    """16-hex keyed pseudonym; held-out mode re-domains every non-train split."""
    ip_text = as_col(ip_text)
    plain = F.substring(hmac_sha256_hex(key, F.concat(F.lit("node:"), ip_text)), 1, PSEUDONYM_CHARS)
    if not heldout:
        return plain
    other = F.substring(
        hmac_sha256_hex(key, F.concat(F.lit("node-heldout:"), ip_text)), 1, PSEUDONYM_CHARS)
    split = F.lit(split) if isinstance(split, str) else split
    return F.when(split == "train", plain).otherwise(other)


def net24_bucket(ip_text: str | Column, key: bytes, buckets: int = NET24_BUCKETS) -> Column:
    """Keyed bucket of the /24 prefix."""
    prefix = F.substring_index(as_col(ip_text), ".", 3)
    digest = hmac_sha256_hex(key, F.concat(F.lit("net24:"), prefix))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("long")


def portable_hash(seed, *cols: str | Column) -> Column:
    """Uniform 52-bit integer from a seed and columns; same value in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[as_col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def pseudonym_plain(host: str | Column, key: bytes) -> Column:
    """16-hex keyed pseudonym without a domain prefix, as ledger records use it."""
    return F.substring(hmac_sha256_hex(key, host), 1, PSEUDONYM_CHARS)
