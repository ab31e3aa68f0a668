"""Vector and score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Cosine; null if either is all zero."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def affinity(x: Column, y: Column) -> Column:
    """Cosine moved to 0..1."""
    return F.lit(0.5) * (F.lit(1.0) + cosine(x, y))


def unit(x: Column) -> Column:
    """``x`` at length one; nulls if it is all zero."""
    n = norm(x)
    return F.transform(x, lambda v: F.try_divide(v.cast("double"), n))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v.cast("double") - top.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def log_softmax(x: Column) -> Column:
    return F.transform(softmax(x), lambda v: F.ln(v))


def argmax(x: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def top_k(x: Column, k: int) -> Column:
    """(score, place) of the k largest values, ties to the first place."""
    tagged = F.transform(x, lambda v, i: F.struct(v.alias("score"), (-i).alias("i")))
    return F.transform(F.slice(F.sort_array(tagged, asc=False), 1, k), lambda s: F.struct(s["score"].alias("score"), (-s["i"]).alias("place")))


def normalised(x: Column, shift: Column, scale: Column) -> Column:
    """(x + shift) * scale, value by value."""
    return F.zip_with(F.zip_with(x, shift, lambda a, b: a + b), scale, lambda a, b: a * b)


def decibel(x: Column) -> Column:
    return F.lit(10.0) * F.log10(dot(x, x) + F.lit(1e-6))


def padded(x: Column, length: Column, value: object) -> Column:
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(F.lit(0), (length - F.size(x)).cast("int"))))


def mask_bias(length: Column, whole: Column) -> Column:
    """(1 - mask) * -10000 for the first ``length`` of ``whole`` places."""
    return F.transform(F.sequence(F.lit(1), whole), lambda i: F.when(i <= length, F.lit(0.0)).otherwise(F.lit(-10000.0)))


def next_power(n: Column) -> Column:
    """The next power of two."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long"))


def mean_or(x: Column, default: float) -> Column:
    """Mean of an array; ``default`` if it is empty."""
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return F.when(F.size(x) > 0, total / F.size(x)).otherwise(F.lit(default))


def bucket(n: Column, sizes: list[int]) -> Column:
    """The smallest of ``sizes`` that holds n, else the largest."""
    s = F.array(*[F.lit(v) for v in sorted(sizes)])
    return F.coalesce(F.array_min(F.filter(s, lambda v: v >= n)), F.lit(max(sizes)))
