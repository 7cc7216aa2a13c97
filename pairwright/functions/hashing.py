"""Repeatable hashing (replaces every unseeded random choice).

``hash32(seed, key)`` = first 32 bits of ``md5("<seed>:<key>")`` as a bigint in
[0, 2^32).  The same value is produced by DuckDB with
``('0x' || substr(md5('<seed>:' || key), 1, 8))::BIGINT`` so oracle queries
can reproduce every sample, split and position choice exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296


def _key(*cols) -> Column:
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(":"))
        parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def hash32(seed, *cols) -> Column:
    """Stable 32-bit hash of ``seed:col1:col2...`` (bigint, never negative)."""
    key = F.concat(F.lit(f"{seed}:"), _key(*cols))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def unit_hash(seed, *cols) -> Column:
    """Hash mapped to [0, 1)."""
    return hash32(seed, *cols) / F.lit(float(TWO32))


def hash_pick(seed, lo: Column, hi: Column, *cols) -> Column:
    """Uniform integer in [lo, hi] (both inclusive) chosen by hash."""
    return lo + F.pmod(hash32(seed, *cols), hi - lo + F.lit(1))


def sql_hash32(seed, expr: str) -> str:
    """DuckDB text of :func:`hash32` for one key expression (oracle side)."""
    return f"('0x' || substr(md5('{seed}:' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"
