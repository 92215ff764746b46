"""Vector expressions: distances, similarities, normalisation, truncation; all in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | Sequence[float]) -> Column:
    return v.cast("array<double>") if isinstance(v, Column) else F.array(*(F.lit(float(x)) for x in v))


def _folded(a: Column, b: Column, pair) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), pair), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: x * y)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_folded(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / F.when(size > 0, size)).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(doubles(a), lambda x: x / F.when(size > 0, size))).otherwise(doubles(a))


def truncated(a: Column, dimension: int, unit: bool = True) -> Column:
    """The first components, scaled to length 1 again."""
    cut = F.slice(doubles(a), 1, dimension)
    return normalized(cut) if unit else cut


def rounded(x: Column, digits: int) -> Column:
    """As SQL engines round doubles in binary: half away from zero, and what is rounded to zero keeps its sign, which Spark's own function drops."""
    scaled = x * F.lit(10.0**digits)
    size = F.abs(scaled)
    whole = F.floor(size).cast("double")
    near = F.signum(x) * F.when(size - whole >= 0.5, whole + 1.0).otherwise(whole) / F.lit(10.0**digits)
    # from 2 ** 52 on there are no fractions; what isn't finite stays
    return F.when(size < 2.0**52, near).when(size < float("inf"), scaled / F.lit(10.0**digits)).otherwise(x)


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer: 1 - distance for l2, the similarity for cosine and dot."""
    if metric == "l2":
        return F.lit(1.0) - l2_distance(a, b)
    return cosine_similarity(a, b) if metric == "cosine" else dot(a, b)
