"""Uniform and normal draws derived from row keys.

Reproducible under any partitioning and retry, unlike ``rand(seed)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52


def uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    """Uniform in (0, 1) from the md5 of (seed, tag, keys)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *keys)
    head = F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("double")
    return (head + 0.5) / float(2**_BITS)


def normal(seed: int, tag: str, *keys: Column | str) -> Column:
    """Standard normal by Box-Muller on two uniforms."""
    u, v = uniform(seed, tag + "-r", *keys), uniform(seed, tag + "-a", *keys)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * F.pi() * v)
