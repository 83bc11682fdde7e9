"""Column expressions: entity keys, risk buckets, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device labels that stand for no device of their own.
GENERIC_DEVICES = ("Windows", "iOS Device", "MacOS", "Linux", "Trident/7.0", "other")
EDGES, MIDS = (0.2, 0.4, 0.6, 0.8), (0.1, 0.3, 0.5, 0.7, 0.9)


def composite_key(*cols: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("n")) for c in cols])


def day() -> Column:
    return F.floor(F.col("t") / 86400).cast("long")


def account_key(*cols: str) -> Column:
    """Columns and the day on which the account's age ``d1`` was nought."""
    return F.concat_ws("|", composite_key(*cols), F.coalesce(F.round(F.col("d1") - day()).cast("long").cast("string"), F.lit("n")))


def device_key() -> Column:
    return F.when(F.col("device_info").isNotNull(), composite_key("device_info", "browser"))


def specific_device(device: Column) -> Column:
    return F.coalesce(~device.isin(*GENERIC_DEVICES) & device.rlike("[0-9 ]"), F.lit(False))


def address_key() -> Column:
    return F.when(F.col("addr1").isNotNull() & F.col("email_domain").isNotNull(), composite_key("addr1", "addr2", "email_domain"))


def merchant(n: int = 8) -> Column:
    return F.pmod(F.coalesce(F.col("card1"), F.lit(-1)), F.lit(n)).cast("long")


def email_domain(email: Column) -> Column:
    return F.nullif(F.lower(F.element_at(F.split(email, "@"), -1)), F.lit(""))


def card_identity(card: str, method: str) -> Column:
    part = lambda f: F.nullif(F.trim(F.col(f"{card}.{f}")), F.lit(""))
    full = F.concat_ws("|", part("network"), part("issuer"), part("type"), F.concat(F.lit("last4:"), part("last4")))
    return F.when(part("last4").isNotNull(), full).otherwise(F.col(method))


def risk_bucket(score: Column) -> Column:
    out = F.when(score >= EDGES[3], 4)
    for i in (2, 1, 0):
        out = out.when(score >= EDGES[i], i + 1)
    return out.otherwise(0)


def risk_tenths(buckets: list[Column]) -> Column:
    """Sum of the buckets' middles in tenths: whole numbers, exact in any order."""
    return sum((b * (2 * i + 1) for i, b in enumerate(buckets[1:], 1)), buckets[0])


def risk_estimate(buckets: list[Column]) -> Column:
    total = sum(buckets[1:], buckets[0])
    return risk_tenths(buckets) / (10 * F.greatest(total, F.lit(1.0)))


def risk_reaches(buckets: list[Column], threshold: float) -> Column:
    """risk_estimate >= threshold (in thousandths), in whole numbers: no rounding decides a tie."""
    return 100 * risk_tenths(buckets) >= round(1000 * threshold) * F.greatest(sum(buckets[1:], buckets[0]), F.lit(1.0))


def hmac_sha256(secret: bytes, value: Column) -> Column:
    """Hexadecimal HMAC-SHA256, in expressions only; long keys are hashed first."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(inner), value.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def gaussian_sigma(epsilon: Column, delta: float = 1e-5, sensitivity: float = 1.0) -> Column:
    return F.when(epsilon.isNull() | (epsilon <= 0), 0.0).otherwise(F.sqrt(2 * F.log(F.lit(1.25 / delta))) * sensitivity / epsilon)


def unit_noise(*parts: Column) -> Column:
    """Standard normal value from a hash of the parts: the same however rows are partitioned."""
    return unit_normal(F.sha2(F.concat_ws("|", *parts), 256))


def unit_normal(h: Column) -> Column:
    """Standard normal value from a hexadecimal hash."""
    u = lambda a: (F.conv(F.substr(h, F.lit(a), F.lit(12)), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(13))


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
