"""Randomness derived from hashes, as columns: the same under any partitioning, and computable by other engines.

A known seed gives no privacy: a real release must draw a secret one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of the digest that make a uniform, and two to the power of its bits.
DIGITS, SPAN = 13, 4503599627370496


def uniform(seed: str, key: Column) -> Column:
    """Uniform in (0, 1) from the MD5 of ``seed:key``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(SPAN))


def uniform_sql(seed: str, key: str) -> str:
    """The same in DuckDB."""
    return f"((('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, {DIGITS}))::BIGINT) + 0.5) / {SPAN}::DOUBLE"


def laplace(seed: str, key: Column, scale: float) -> Column:
    u = uniform(seed, key) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def gaussian(seed: str, key: Column, sigma: float) -> Column:
    """Box-Muller on two streams."""
    u, v = uniform(f"{seed}:1", key), uniform(f"{seed}:2", key)
    return sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def gumbel(seed: str, key: Column) -> Column:
    return -F.log(-F.log(uniform(seed, key)))


def exponential(seed: str, key: Column) -> Column:
    return -F.log(uniform(seed, key))
