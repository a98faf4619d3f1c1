"""Vector and score arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a vector is null, empty, of another length or zero."""
    n = norm(a) * norm(b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(ok & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def rice(reach: Column, impact: Column, confidence: Column, effort: Column) -> Column:
    return F.round(reach * impact * confidence / F.greatest(F.lit(0.1), effort), 3)


def bloom_bits(n: int, p: float) -> tuple[int, int]:
    """(bits, hash functions) of a filter for ``n`` keys at false-positive rate ``p``."""
    import math

    m = max(8, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / max(1, n) * math.log(2)))
