"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero, or lengths differ."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def minus_projection(neighbour: Column, seed: Column) -> Column:
    """The part of ``neighbour`` that is orthogonal to ``seed``."""
    share = F.when(dot(seed, seed) > 0, dot(neighbour, seed) / dot(seed, seed)).otherwise(0.0)
    return F.zip_with(neighbour, F.transform(seed, lambda x: x.cast("double") * share), lambda n, p: n.cast("double") - p)


def dots(query: Column, neighbour: Column, seed: Column) -> dict[str, Column]:
    """The products of the three vectors that novelty is made of, to be columns of their own: each is worked out once."""
    return {"qq": dot(query, query), "qn": dot(query, neighbour), "qs": dot(query, seed), "nn": dot(neighbour, neighbour), "ns": dot(neighbour, seed), "ss": dot(seed, seed)}


def novelty_of(qq: Column, qn: Column, qs: Column, nn: Column, ns: Column, ss: Column) -> Column:
    """How much the neighbour's own part, beyond the seed, points to the query: 0 to 1, 0 if it has none."""
    share = F.when(ss > 0, F.try_divide(ns, ss)).otherwise(0.0)
    rest = F.sqrt(F.greatest(F.lit(0.0), nn - 2 * share * ns + share * share * ss))
    return F.when(rest < 1e-8, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(qn - share * qs, F.sqrt(qq) * rest))))


def novelty(query: Column, neighbour: Column, seed: Column) -> Column:
    return novelty_of(**dots(query, neighbour, seed))
