"""Vector functions as Column expressions over array columns; everything is computed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once: what a lambda holds from outside is computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _zero(), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diff, _zero(), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, _zero(), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """v / (norm + eps)."""
    return _once(v, lambda w: _once(norm(w) + F.lit(eps), lambda n: F.transform(w, lambda x: x.cast("double") / n)))


def l2_normalize_if(v: Column, above: float = 1e-8) -> Column:
    """v / norm where the norm exceeds `above`, else v."""
    scaled = lambda w, n: F.when(n > above, F.transform(w, lambda x: x.cast("double") / n)).otherwise(F.transform(w, lambda x: x.cast("double")))
    return _once(v, lambda w: _once(norm(w), lambda n: scaled(w, n)))


def rootsift(d: Column, eps: float = 1e-7) -> Column:
    """Square roots of the descriptor's shares; null and empty pass through."""
    return _once(d, lambda w: _once(total(w) + F.lit(eps), lambda s: F.transform(w, lambda x: F.sqrt(x.cast("double") / s))))


def signed_sqrt(v: Column) -> Column:
    return F.transform(v, lambda x: F.signum(x.cast("double")) * F.sqrt(F.abs(x.cast("double"))))


def gem_term(x: Column, p: float = 3.0) -> Column:
    """What GeM pooling averages; the pooled value is the average to the power 1 / p."""
    return F.pow(F.greatest(x.cast("double"), F.lit(1e-6)), F.lit(float(p)))


def nearest(v: Column, centroids: Column) -> Column:
    """struct<d, cid> of the nearest of array<struct<cid, vec>>, the least cid on ties."""
    return F.array_min(F.transform(centroids, lambda c: F.struct(squared_l2(v, c["vec"]).alias("d"), c["cid"].alias("cid"))))


def confidence(inliers: Column, full: float = 50.0) -> Column:
    return F.least(inliers / F.lit(full), F.lit(1.0))


def inlier_ratio(inliers: Column, good: Column) -> Column:
    return F.when(good > 0, inliers / good).otherwise(F.lit(0.0))


def match_score(inliers: Column, good: Column, photometric: Column) -> Column:
    return inliers * inlier_ratio(inliers, good) * photometric


def affine_valid(a: Column, b: Column, least: float = 1e-3, most: float = 1e3) -> Column:
    """Whether the scale of a similarity with first column (a, b) lies strictly between the bounds."""
    scale = F.hypot(a, b)
    return (scale > least) & (scale < most)
