"""Deterministic draws: every random number is a pure function of its key.

A lost executor recomputes exactly the same values, and all strengths of one
perturbation share the same state because strength is not part of the key.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(2**52)  # 13 hex digits


def digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def unit_from(hex_digest, start: int = 1) -> Column:
    """Uniform in [0, 1) from 13 hex digits of a digest."""
    return F.conv(F.substring(hex_digest, start, 13), 16, 10).cast("double") / SPAN


def uniform(*parts) -> Column:
    return unit_from(digest(*parts))


def normal(*parts) -> Column:
    """Standard normal by Box-Muller from the two halves of one digest."""
    from .arrays import let

    return let(
        digest(*parts),
        lambda h: F.sqrt(-2.0 * F.log(unit_from(h, 1) + 0.5 / SPAN))
        * F.cos(2.0 * math.pi * unit_from(h, 14)),
    )


def draw_index(size, *parts) -> Column:
    """Integer in [0, size)."""
    return F.floor(uniform(*parts) * size).cast("long")


def sign(*parts) -> Column:
    return F.when(uniform(*parts) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
