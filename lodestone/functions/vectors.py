"""Vector expressions over arrays of numbers, summed in double precision from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let

TOLERANCE = 1e-4


def inner(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner(v, v))


def normalized(v: Column) -> Column:
    """Of length one; a zero vector stays as it is."""
    return let(v, lambda w: let(norm(w), lambda n: F.transform(w, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))))


def rounded(x: Column, places: int) -> Column:
    """As SQL engines round doubles: a half goes away from zero, and what is rounded to zero keeps its sign (``F.round`` loses it)."""
    return F.round(F.abs(x) * 10.0**places) * F.signum(x) / 10.0**places


def is_normalized(v: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(norm(v) - 1) < tolerance


def is_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def well_formed(v: Column, dim: int) -> Column:
    """Of the right width, without missing or infinite parts, and of length one."""
    return F.coalesce((F.size(v) == dim) & is_finite(v) & is_normalized(v), F.lit(False))


def stub_embedding(text: Column, dim: int) -> Column:
    """A deterministic embedding for runs without a provider: the bytes of the text's SHA-256, cycled and normalized."""

    def parts(digest: Column) -> Column:
        byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (byte(i) - 128) / F.lit(128.0))

    return normalized(let(F.sha2(text, 256), parts))
