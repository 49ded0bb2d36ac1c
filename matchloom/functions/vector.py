"""Column expressions on vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchloom.functions.text import let


def as_doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def unit(c: Column) -> Column:
    """L2-normalised; a zero vector stays zero."""
    return let(F.greatest(norm(c), F.lit(1e-12)), lambda n: F.transform(c, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors and for vectors of different lengths."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same, dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))).otherwise(F.lit(0.0))


def parse_vector(c: Column) -> Column:
    """``[1.0 2.0]`` or ``[1.0, 2.0]`` as an array; anything that is no number is null."""
    parts = F.filter(F.split(F.regexp_replace(c, r"[\[\],]", " "), r"\s+"), lambda s: s != "")
    return F.transform(parts, lambda s: s.try_cast("double"))
