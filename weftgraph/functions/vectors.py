"""Vector and score expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.constants import DECAY_PER_DAY, FUSE_ALPHA


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_of(d: Column, na: Column, nb: Column) -> Column:
    """Cosine from a dot product and two norms: 0 for a norm under 1e-9, clamped to [-1, 1]."""
    return F.when((na < 1e-9) | (nb < 1e-9), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d / (na * nb))))


def cosine(a: Column, b: Column) -> Column:
    return cosine_of(dot(a, b), norm(a), norm(b))


def alignment(i1: Column, p1: Column, i2: Column, p2: Column) -> Column:
    """1 less half the distance of interest and profession, at least 0."""
    return F.greatest(F.lit(0.0), 1 - (F.abs(i1 - i2) + F.abs(p1 - p2)) / 2)


def magnitude(i1: Column, p1: Column, i2: Column, p2: Column) -> Column:
    return (i1 + p1 + i2 + p2) / 4


def unit(v: Column) -> Column:
    """The vector over its norm; unchanged if the norm is under 1e-9."""
    n = norm(v)
    return F.when(n < 1e-9, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / n))


def fuse(text: Column, graph: Column, alpha: float = FUSE_ALPHA) -> Column:
    """alpha times the unit text vector plus the rest times the unit graph vector; text alone if the other is missing or of another length."""
    both = F.zip_with(unit(text), unit(graph), lambda x, y: alpha * x + (1 - alpha) * y)
    return F.when(graph.isNull() | (F.size(graph) != F.size(text)), _doubles(text)).otherwise(both)


def decay(created: Column, now: Column, rate: float = DECAY_PER_DAY) -> Column:
    """exp(-rate * days), days not below 0; 1 for a missing time."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.coalesce(F.exp(-F.lit(rate) * F.greatest(F.lit(0.0), days)), F.lit(1.0))
