"""Column expressions on ``array<double>`` vectors and portable random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    squares = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def combine(a: Column | str, b: Column | str, wa: float, wb: float) -> Column:
    """``wa * a + wb * b``."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.lit(wa) * x + F.lit(wb) * y)


def scale(a: Column | str, factor: Column) -> Column:
    """Each item times ``factor``."""
    return F.transform(_c(a), lambda x: x * factor)


def as_vector(a: Column | str) -> Column:
    """Any numeric array, or a single number, as ``array<double>``."""
    return _c(a).cast("array<double>")


def draw(identifier: Column | str, seed: int) -> Column:
    """A number in (0, 1) that depends on identifier and seed alone, the same on every engine with md5."""
    return (F.conv(F.substring(draw_key(identifier, seed), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def draw_key(identifier: Column | str, seed: int) -> Column:
    """The text whose order is the order of a uniform sample."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(identifier).cast("string")))


def _c(a: Column | str) -> Column:
    return F.col(a) if isinstance(a, str) else a
