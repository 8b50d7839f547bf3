"""Similarities as column expressions. Vectors are widened to double before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def widened(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def maxsim(q: Column, c: Column) -> Column:
    """The sum over q's vectors of the best dot product with any of c's."""
    best = F.transform(q, lambda a: F.array_max(F.transform(c, lambda b: dot(a, b))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v)


def slices(v: Column, n: int, width: int) -> Column:
    return F.array(*[F.slice(v, i * width + 1, width) for i in range(n)])


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is true, scaled to length 1; zeros where there are none. All vectors have one length."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m, v)), lambda v: v.isNotNull())
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    mean = F.transform(F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)), lambda x: x / F.greatest(F.size(kept), F.lit(1)))
    length = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mean, lambda x: x / F.greatest(length, F.lit(1e-9)))


def fused(d: Column, s: Column, c: Column, wd, ws, wc) -> Column:
    lit = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    return lit(wd) * d + lit(ws) * s + lit(wc) * c
