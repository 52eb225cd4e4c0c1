"""Seeded, deterministic randomness from md5 of stable ids.

``md5(concat_ws(':', seed, parts...))`` is computed by the JVM, gives the same
value on every re-run or retried task, and the same value in DuckDB, so every
seeded draw can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 12345


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_md5(seed: int, *parts) -> Column:
    """Hex md5 of ``seed:part1:part2...`` (parts are columns or names)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))


def hash32(seed: int, *parts) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of the seeded md5."""
    return F.conv(F.substring(seeded_md5(seed, *parts), 1, 8), 16, 10).cast("bigint")


def hash_unit(seed: int, *parts) -> Column:
    """Uniform fraction in [0, 1) from ``hash32``."""
    return hash32(seed, *parts) / F.lit(4294967296.0)


def hash_bucket(md5_hex: Column, bits: int = 12) -> Column:
    """Top ``bits`` bits (a multiple of 4) of an md5 hex string, as an int.

    Ordering rows by (bucket, md5) equals ordering by md5, so a rank inside a
    hot group can be cut into 2**bits evenly sized sub-groups.
    """
    if bits % 4:
        raise ValueError("bits must be a multiple of 4")
    return F.conv(F.substring(md5_hex, 1, bits // 4), 16, 10).cast("int")
