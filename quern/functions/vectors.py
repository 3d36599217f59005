"""Embedding vectors as Catalyst expressions: exact single-precision arithmetic.

Spark widens ``/`` and ``sqrt`` to double; results are cast back at the points where
a single-precision loop rounds, so values agree bit for bit with a sequential one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920928955078125e-07


def _f(x: Column) -> Column:
    return x.cast("float")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, and not again for each element of a lambda in it."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _f(x * y)), F.lit(0.0).cast("float"), lambda s, x: _f(s + x))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("float"), lambda s, x: _f(s + x * x))


def cosine(a: Column, b: Column, a_squared: Column | None = None) -> Column:
    """Cosine in single precision; 0 if a norm is 0; an error if the lengths differ."""
    aa = squared_norm(a) if a_squared is None else a_squared
    bb = squared_norm(b)
    norms = _f(_f(F.sqrt(aa.cast("double"))) * _f(F.sqrt(bb.cast("double"))))
    value = F.when((aa == 0) | (bb == 0), F.lit(0.0).cast("float")).otherwise(_f(dot(a, b) / norms))
    wrong = F.raise_error(F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" dimensions")))
    return F.when(F.size(a) == F.size(b), value).otherwise(wrong.cast("float"))


def cosine_double(a: Column, b: Column) -> Column:
    """Cosine in double precision."""

    def over(v: Column, w: Column) -> Column:
        return F.aggregate(F.zip_with(v, w, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    norms = F.sqrt(over(a, a)) * F.sqrt(over(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(over(a, b) / norms)


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def int8_scale(v: Column) -> Column:
    spread = _f(F.array_max(v) - F.array_min(v))
    return F.when(spread <= EPSILON, F.lit(0.0).cast("float")).otherwise(_f(spread / F.lit(255.0)))


def int8_offset(v: Column, scale: Column) -> Column:
    low = F.array_min(v)
    return F.when(scale == 0, low).otherwise(_f(low + _f(F.lit(128.0).cast("float") * scale)))


def int8_values(v: Column, scale: Column, offset: Column) -> Column:
    """Quantized values, rounded half away from zero and clamped to a byte."""

    def one(x: Column) -> Column:
        q = F.round(_f((x - offset) / scale).cast("double"))
        return F.when(scale == 0, F.lit(0)).otherwise(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), q)).cast("int")).cast("tinyint")

    return F.transform(v, one)


def int8_decode(values: Column, scale: Column, offset: Column) -> Column:
    return F.transform(values, lambda q: _f(_f(q.cast("float") * scale) + offset))


def project(v: Column, dimensions: int) -> Column:
    """The leading dimensions, not renormalized."""
    return F.slice(v, 1, dimensions)


def norm_double(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; an error if the norm is zero, near it or not finite."""
    norm = norm_double(v)
    bad = F.raise_error(F.lit("a vector without length can't be normalized")).cast("double")
    safe = F.when((norm > EPSILON) & (norm < F.lit(float("inf"))), norm).otherwise(bad)
    return bound(safe, lambda length: F.transform(v, lambda x: _f(x / length)))


def layer_norm(v: Column, epsilon: float = 1e-5) -> Column:
    """Less its mean, over its population deviation."""
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / n

    def centred(m: Column) -> Column:
        var = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)) / n
        return bound(F.sqrt(var + F.lit(epsilon)), lambda d: F.transform(v, lambda x: _f((x.cast("double") - m) / d)))

    return bound(mean, centred)
