"""Pseudonyms, redaction and field encryption, all as Catalyst expressions."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scrub_username(name: Column) -> Column:
    """`user_` and eight digits of the SHA-256; null and empty names stay."""
    return F.when(F.length(name) > 0, F.concat(F.lit("user_"), F.substring(F.sha2(name, 256), 1, 8))).otherwise(name)


def new_key() -> bytes:
    """A fresh key for one run's pseudonyms."""
    return secrets.token_bytes(32)


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Lower-case hex HMAC-SHA-256 of the value's UTF-8 bytes."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def pseudonym(ip: Column, key: bytes) -> Column:
    """`ip_` and twelve digits of the keyed hash: the same within a run, different across runs. Null and empty stay."""
    return F.when(F.length(ip) > 0, F.concat(F.lit("ip_"), F.substring(hmac_sha256(ip, key), 1, 12))).otherwise(ip)


def _secret(secret: str) -> Column:
    return F.lit(bytearray(hashlib.sha256(secret.encode()).digest()))


def encrypt(value: Column, secret: str | None) -> Column:
    """AES-GCM in Base64 under the secret's SHA-256; null stays null; without a secret nothing changes."""
    return value if not secret else F.base64(F.aes_encrypt(value.cast("binary"), _secret(secret), F.lit("GCM")))


def decrypt(value: Column, secret: str | None) -> Column:
    """What encrypt() hid; anything else comes back as it is."""
    if not secret:
        return value
    plain = F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), _secret(secret), F.lit("GCM"))
    return F.coalesce(plain.cast("string"), value)


def protect(df: DataFrame, *, scrub: bool = False, pseudonymise: bool = False, drop_raw: bool = False, key: bytes | None = None) -> DataFrame:
    """The privacy steps a frame has columns for. They come after detection and enrichment and before scoring, reports and storage;
    labels for evaluation then have to be pseudonymised with the same key."""
    if scrub and "username" in df.columns:
        df = df.withColumn("username", scrub_username(F.col("username")))
    if pseudonymise and "source_ip" in df.columns:
        df = df.withColumn("source_ip", pseudonym(F.col("source_ip"), key or new_key()))
    if drop_raw and "raw_line" in df.columns:
        df = df.withColumn("raw_line", F.lit(None).cast("string"))
    return df
