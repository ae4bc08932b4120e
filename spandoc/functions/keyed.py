"""Keyed pseudo-random columns: pure functions of (seed, row key).

md5 makes every draw independent of partitioning, retries and engine, so a lost
executor recomputes exactly the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _joined(parts) -> Column:
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *cols)


def keyed_md5(*parts) -> Column:
    """Hex digest of the parts joined by ``|`` (plain values become literals)."""
    return F.md5(_joined(parts).cast("binary"))


def keyed_int(*parts, digits: int = 8) -> Column:
    """First ``digits`` hex digits of the digest as a non-negative BIGINT."""
    return F.conv(F.substring(keyed_md5(*parts), 1, digits), 16, 10).cast("bigint")


def keyed_uniform(*parts) -> Column:
    """Uniform double in (0, 1) with 32 bits."""
    return (keyed_int(*parts).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def keyed_normal(*parts) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u1 = keyed_uniform(*parts, "u")
    u2 = keyed_uniform(*parts, "v")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)
