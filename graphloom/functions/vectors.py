"""Vector functions as column expressions over arrays; sums are in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector is zero or empty; null where the dimensions differ."""
    lengths = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def l2_squared(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def quantize(v: Column) -> Column:
    """struct(data, scale, offset, norm): 8-bit steps between the least and the greatest component; a constant vector has scale and norm 0."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    scale = (high - low) / 254
    offset = low + 127 * scale
    steps = F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround((x.cast("double") - offset) / scale))).cast("tinyint"))
    flat = high == low
    data = F.when(flat, F.transform(v, lambda x: F.lit(0).cast("tinyint"))).otherwise(steps)
    back = F.transform(data, lambda q: q.cast("double") * scale + offset)
    return F.struct(
        data.alias("data"),
        F.when(flat, F.lit(0.0)).otherwise(scale).alias("scale"),
        F.when(flat, low).otherwise(offset).alias("offset"),
        F.when(flat, F.lit(0.0)).otherwise(norm(back)).alias("norm"),
    )


def dequantize(q: Column) -> Column:
    return F.transform(q["data"], lambda x: x.cast("double") * q["scale"] + q["offset"])


def quantized_dot(q: Column, b: Column) -> Column:
    """Inner product of a quantized and a plain vector."""
    steps = total(F.zip_with(q["data"], b, lambda x, y: x.cast("double") * y.cast("double")))
    return q["scale"] * steps + q["offset"] * total(F.transform(b, lambda y: y.cast("double")))


def quantized_cosine_distance(q: Column, b: Column) -> Column:
    """1 where a norm is 0."""
    lengths = q["norm"] * norm(b)
    return F.when(lengths == 0, F.lit(1.0)).otherwise(1 - quantized_dot(q, b) / lengths)
