"""Keyed-hash randomness.

Every random choice is a pure function of (purpose, seed, row key), so results do
not depend on partitioning or task retries, and an SQL engine with ``md5`` can
repeat them: u = first 8 hex digits of md5('purpose|seed|k1|k2...') / 2^32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    if isinstance(x, str):
        return F.col(x).cast("string")
    return F.lit(str(x))


def keyed_hash32(*parts) -> Column:
    """Unsigned 32-bit integer from md5 over '|'-joined parts (as long)."""
    key = F.concat_ws("|", *[_as_col(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def keyed_uniform(*parts) -> Column:
    """Uniform in [0, 1) keyed by the parts; strings are literals, Columns are values."""
    return keyed_hash32(*parts).cast("double") / F.lit(TWO_32)


def lit_key(s) -> Column:
    """Literal key part (use for purpose tags and seeds)."""
    return F.lit(str(s))


def sql_uniform(*parts: str) -> str:
    """DuckDB twin of :func:`keyed_uniform`; parts are SQL expressions."""
    key = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"
