"""Vector expressions over ARRAY<FLOAT> columns, computed in DOUBLE from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalize(a: Column) -> Column:
    """Unit vector in DOUBLE; a zero vector stays as it is."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))  # the length is computed once
    return F.get(scaled, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def usable(a: Column, dim: int) -> Column:
    """Right length, every part a finite number, not all zero."""
    return a.isNotNull() & (F.size(a) == dim) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(a, lambda x: x != 0)


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the vectors of ARRAY<ARRAY<FLOAT>> whose entry in ``mask`` (ARRAY of numbers) isn't 0, weighted by it; zero where none counts."""
    weight = F.aggregate(mask, F.lit(0.0), lambda s, x: s + x.cast("double"))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(F.arrays_zip(tokens.alias("v"), mask.alias("m")), zero, lambda s, z: F.zip_with(s, z["v"], lambda a, x: a + x.cast("double") * z["m"].cast("double")))
    return F.transform(total, lambda x: x / F.greatest(weight, F.lit(1e-9)))
