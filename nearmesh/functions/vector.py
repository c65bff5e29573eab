"""Vector expressions as built-in array functions (JVM side), always in double.

Arrays of float are widened before any arithmetic, so results do not depend on
the order in which single-precision sums would be taken.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIST_SCALE = 9


def _wide(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def l2_squared(a, b) -> Column:
    """Squared Euclidean distance of two array columns."""
    terms = F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def norm_squared(v) -> Column:
    return F.aggregate(_wide(v), F.lit(0.0), lambda s, x: s + x * x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)


def l2_squared_expanded(a, b) -> Column:
    """|a|^2 + |b|^2 - 2ab; can be slightly negative for near-equal vectors."""
    return norm_squared(a) + norm_squared(b) - 2 * dot(a, b)


def normalize(v, inside_root: bool = False, epsilon: float = 1e-12) -> Column:
    """Unit-length vector; ``epsilon`` is added to the norm, or under the root."""
    n2 = norm_squared(v)
    length = F.sqrt(n2 + epsilon) if inside_root else F.sqrt(n2) + epsilon
    return F.transform(_wide(v), lambda x: x / length)


def smallest(arr, k: int) -> Column:
    """The k smallest values of an array, ascending."""
    return F.slice(F.array_sort(arr), 1, k)


def argmin(arr) -> Column:
    """Place (from 0) of the first smallest value."""
    return F.array_position(arr, F.array_min(arr)) - 1


def quantize(v, low, scale, bits: int) -> Column:
    """Codes 0 .. 2^bits - 1 of a vector under per-dimension minimum and range."""
    top = float((1 << bits) - 1)
    unit = F.zip_with(F.zip_with(_wide(v), low, lambda x, m: x - m), scale, lambda d, s: F.when(s > 0, d / s).otherwise(0.0))
    return F.transform(unit, lambda u: F.floor(F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * top + 0.5).cast("int"))


def dequantize(codes, low, scale, bits: int) -> Column:
    top = float((1 << bits) - 1)
    return F.zip_with(F.zip_with(codes, scale, lambda c, s: c.cast("double") / top * s), low, lambda d, m: d + m)
