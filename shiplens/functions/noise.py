"""Reproducible invoice-variance noise keyed by the order line.

The source draws ``N(0, sigma)`` from one seeded random stream in row
order. A distributed plan has no row order (and ``randn(seed)`` depends on
the partitioning), so each line gets a normal draw derived from a hash of
its own key: two 32-bit uniforms from an MD5 digest, then Box-Muller.
The draw is a pure function of (seed, key): it survives re-partitioning,
task retries and lost executors, and can be restated in plain SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32_PLUS_1 = 4294967297.0


def _uniform(hex_digest: Column, start: int) -> Column:
    word = F.conv(F.substring(hex_digest, start, 8), 16, 10).cast("double")
    return (word + F.lit(1.0)) / F.lit(_TWO_32_PLUS_1)  # in (0, 1)


def key_digest(key: Column, seed: int) -> Column:
    """The digest both uniforms of a line are read from."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def keyed_normal(digest: Column, sigma: float) -> Column:
    """``sigma * N(0,1)`` drawn from a line's digest; give it as a column, so it
    is computed once."""
    u1 = _uniform(digest, 1)
    u2 = _uniform(digest, 9)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(float(sigma)) * z
