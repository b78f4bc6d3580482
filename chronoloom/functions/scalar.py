"""Scalar expressions over columns; all run inside whole-stage code or constant folding, none in Python workers."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.when(v >= 0, v * 2).otherwise(-v * 2 - 1)


def bit_length(v: Column) -> Column:
    """Bits of a non-negative integer; 1 for zero."""
    return F.greatest(F.lit(1), F.length(F.bin(v)))


def varint_bytes(v: Column) -> Column:
    """Bytes of a signed integer as a zigzag varint, seven bits a byte."""
    return F.ceil(bit_length(zigzag(v)) / 7).cast("long")


def severity(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a >= 4, "critical").when(a >= 3, "high").when(a >= 2.5, "medium").otherwise("low")


def regime(monotonicity: Column, unique: Column, flips: Column, outliers: Column) -> Column:
    return (
        F.when((monotonicity > 0.9) | (unique < 0.05), "ORDERED")
        .when(((flips > 0.4) & (unique > 0.8)) | (outliers > 0.1), "CHAOTIC")
        .otherwise("MIXED")
    )


def lifecycle(inactive_ms: Column, velocity: Column, writes: Column) -> Column:
    """The class an item has when looked at inactive_ms after its last write."""
    return (
        F.when(inactive_ms > 30 * DAY_MS, "dead")
        .when(inactive_ms > 7 * DAY_MS, "dormant")
        .when(velocity > 0.5, F.when(writes < 10, "emerging").otherwise("active"))
        .when(velocity < 0.05, "declining")
        .otherwise("stable")
    )


def direction(value: Column, ema: Column) -> Column:
    return F.when(value > ema * 1.005, "up").when(value < ema * 0.995, "down").otherwise("flat")


def magnitude(value: Column, ema: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.abs(value - ema) / (high - low)).otherwise(0.0)


def forecast(ema: Column, way: Column, size: Column, low: Column, high: Column, horizon: Column) -> Column:
    momentum = F.when(way == "up", size).when(way == "down", -size).otherwise(0.0)
    return ema + momentum * (high - low) * horizon


def forecast_confidence(low: Column, high: Column, horizon: Column) -> Column:
    return F.when(high != low, 0.8).otherwise(0.3) * F.exp(-0.1 * horizon)


def period_class(hours: Column) -> Column:
    return (
        F.when(F.abs(hours - 24) <= 6, "daily")
        .when(F.abs(hours - 168) <= 24, "weekly")
        .when(F.abs(hours - 720) <= 120, "monthly")
        .otherwise("custom")
    )


def scope(target: Column) -> Column:
    """The part of a key before its first bar, or * where there is none."""
    return F.when(F.instr(target, "|") > 1, F.substring_index(target, "|", 1)).otherwise("*")


def mean_signal(*fields: Column) -> Column:
    """Mean of the numeric fields that are present."""
    present = [F.when(f.isNotNull(), 1).otherwise(0) for f in fields]
    total = sum((F.coalesce(f, F.lit(0.0)) for f in fields[1:]), F.coalesce(fields[0], F.lit(0.0)))
    return F.try_divide(total, sum(present[1:], present[0]).cast("double"))


def text_signal(text: Column) -> Column:
    """A number in [0, 1] from a text without numeric fields: 32-bit h * 31 + code, over UTF-16 code units' range of ASCII."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    hashed = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))
    return hashed / F.lit(4294967295.0)


def similarity_score(key: Column, other: Column) -> Column:
    """Two keys' shared segments: 2 for the same segment in the same place, 1 for one that stands elsewhere in the other key."""
    a, b = F.split(key, r"\|"), F.split(other, r"\|")
    n = F.least(F.size(a), F.size(b))
    scored = F.transform(
        F.slice(a, 1, n), lambda s, i: F.when(s == F.get(b, i), 2).when(F.array_contains(b, s), 1).otherwise(0)
    )
    return F.aggregate(scored, F.lit(0), lambda t, s: t + s)


def present_only(fields: Column) -> Column:
    """A map of fields without those that are missing."""
    return F.map_filter(fields, lambda _, v: v.isNotNull())


def fingerprint(joined: Column) -> Column:
    """Sixteen hex digits that name a sample."""
    return F.substring(F.sha2(joined, 256), 1, 16)


def derive_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """A 256-bit key by PBKDF2 with SHA-256; on the driver, once a file set."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def nonce(key: bytes, name: str, number: int) -> bytes:
    """A 96-bit nonce that no other stream and file of this key has."""
    return hmac.new(key, f"{name}/{number}".encode(), hashlib.sha256).digest()[:12]


def encrypted(payload: Column, key: bytes, aad: str) -> Column:
    """AES-GCM of a payload with a fresh nonce a row; aad is bound to it and must match on reading."""
    return F.aes_encrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.lit(aad).cast("binary"))


def decrypted(payload: Column, key: bytes, aad: str) -> Column:
    return F.aes_decrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad).cast("binary"))
