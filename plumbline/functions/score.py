"""Score functions as column expressions; all sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ScoreSpec


def vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def l2_normalize(a: Column) -> Column:
    """a at unit length; a zero vector stays zero."""
    size = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / size)


def angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def recency(ts: Column, now: float, half_life: float) -> Column:
    """0.5 to the age in half-lives; the future counts as now."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.lit(float(now)) - ts) / F.lit(float(half_life)))


def sparse_dot(terms: Column, query: dict[str, float]) -> Column:
    """The summed weights of the query's terms in a map of terms; the loop is over the query, not the map."""
    total = F.lit(0.0)
    for t, w in sorted(query.items()):
        total = total + F.coalesce(F.try_element_at(terms, F.lit(t)).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return total


def fused(spec: ScoreSpec, vec: str = "vec", terms: str = "terms", ts: str = "ts") -> Column:
    """The score of a unit; parts whose weight is 0 are left out of the plan."""
    total = F.lit(0.0)
    if spec.alpha and spec.dense:
        total = total + F.lit(spec.alpha) * inner_product(F.col(vec), vector(spec.dense))
    if spec.beta and spec.sparse:
        total = total + F.lit(spec.beta) * sparse_dot(F.col(terms), spec.sparse)
    if spec.gamma:
        total = total + F.lit(spec.gamma) * recency(F.col(ts), spec.now, spec.half_life)
    return total


def ratio(kth: Column, remaining: Column) -> Column:
    """A certificate's ratio: how far a row outside the answer could beat the k-th."""
    return F.when(kth > 0, F.greatest(F.lit(1.0), remaining / kth)).when(remaining > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
