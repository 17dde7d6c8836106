"""Expressions over vectors, always in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; a missing part counts as zero."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine of the angle."""
    return 1.0 - dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def usable(a: Column, width: int | None = None) -> Column:
    """Whether a vector can be compared: present, finite, not all zero and of the given width."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = a.isNotNull() & (F.size(a) > 0) & finite & F.exists(a, lambda x: x != 0)
    return good if width is None else good & (F.size(a) == width)


def digest_vector(text: Column, width: int) -> Column:
    """Deterministic stand-in for a model: the bytes of the SHA-256 of a text, repeated, as (byte + 1) / 256."""
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (byte(i) + 1) / 256)
