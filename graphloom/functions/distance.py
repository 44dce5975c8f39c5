"""Distances as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6371008.8
MEASURES = ("EUCLIDEAN", "COSINE", "DOT_PRODUCT")


def vector_distance(vector: Column, query: list[float], measure: str) -> Column:
    """Null where sizes differ, a component isn't finite, or a cosine has no length to divide by."""
    q = F.array(*[F.lit(float(x)) for x in query])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    dot = total(F.zip_with(vector, q, lambda a, b: a * b))
    if measure == "DOT_PRODUCT":
        value = dot
    elif measure == "EUCLIDEAN":
        value = F.sqrt(total(F.zip_with(vector, q, lambda a, b: (a - b) * (a - b))))
    else:
        norm, own = F.sqrt(total(F.transform(vector, lambda a: a * a))), math.sqrt(sum(x * x for x in query))
        value = F.when((norm > 0) & F.lit(own > 0), 1 - dot / (norm * F.lit(own or 1.0)))
    finite = F.forall(vector, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")))
    return F.when((F.size(vector) == len(query)) & finite, value)


def haversine(lat: Column, lng: Column, at_lat: float, at_lng: float) -> Column:
    """Metres on a sphere of the mean radius of the earth."""
    a = F.sin(F.radians(lat - at_lat) / 2) ** 2 + F.cos(F.radians(F.lit(at_lat))) * F.cos(F.radians(lat)) * F.sin(F.radians(lng - at_lng) / 2) ** 2
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
