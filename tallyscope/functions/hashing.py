"""Engine-portable hashes: tokens, buckets, uniforms, content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_HEX = 16


def token(value: Column, salt: str) -> Column:
    """First hex digits of sha256(salt:value); NULL stays NULL."""
    digest = F.sha2(F.concat_ws(":", F.lit(salt), value.cast("string")), 256)
    return F.when(value.isNotNull(), F.substring(digest, 1, TOKEN_HEX))


def md5_bucket(value: Column, modulus: int) -> Column:
    """First 8 hex digits of md5 as an integer, modulo `modulus`."""
    return (F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("bigint") % modulus).cast("bigint")


def uniform(value: Column) -> Column:
    """First 6 bytes of sha256 as a number in [0, 1)."""
    digits = F.conv(F.substring(F.sha2(value.cast("string"), 256), 1, 12), 16, 10)
    return digits.cast("bigint").cast("double") / float(2**48)


def hash48(value: Column) -> Column:
    """First 12 hex digits of sha256 as BIGINT; the sum over rows is an order-free content hash."""
    return _leading(value, 12)


def hash60(value: Column) -> Column:
    """First 15 hex digits of sha256 as BIGINT: all that a BIGINT holds without a sign."""
    return _leading(value, 15)


def _leading(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.sha2(value, 256), 1, digits), 16, 10).cast("bigint")
