"""Predicates: a row filter, and a three-valued verdict over a block's summary.

A summary has `lo_<c>`, `hi_<c>` for numbers and `set_<c>` for categories (null: any value).

A facet's key is text that is equal wherever Spark compares the values as equal: numbers of all types by their double
(two that share one are summed up together, which only loosens a bound), text and truth values as they are.  Columns of other types have
no facets, and a key of one kind says nothing about a column of another."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE, SOME, ALL = 0, 1, 2


@dataclass(frozen=True)
class Range:
    """lo <= column <= hi; strict ends exclude themselves.  Null fails."""

    column: str
    lo: float = -math.inf
    hi: float = math.inf
    lo_strict: bool = False
    hi_strict: bool = False

    def mask(self) -> Column:
        c, out = F.col(self.column), F.col(self.column).isNotNull()
        if self.lo > -math.inf:
            out = out & (c > self.lo if self.lo_strict else c >= self.lo)
        if self.hi < math.inf:
            out = out & (c < self.hi if self.hi_strict else c <= self.hi)
        return out

    def verdict(self, known: set[str]) -> Column:
        if f"lo_{self.column}" not in known:
            return F.lit(SOME)
        lo, hi = F.col(f"lo_{self.column}"), F.col(f"hi_{self.column}")
        below = hi <= self.lo if self.lo_strict else hi < self.lo
        above = lo >= self.hi if self.hi_strict else lo > self.hi
        inside = (lo > self.lo if self.lo_strict else lo >= self.lo) & (hi < self.hi if self.hi_strict else hi <= self.hi)
        whole = inside & (F.col(f"nulls_{self.column}") == 0) if f"nulls_{self.column}" in known else inside
        return F.when(lo.isNull() | below | above, NONE).when(whole, ALL).otherwise(SOME)

    def facet(self) -> tuple[str, object] | None:
        return None


@dataclass(frozen=True)
class InSet:
    """column IN values.  Null fails."""

    column: str
    values: frozenset

    def mask(self) -> Column:
        # -0.0 is asked for as the 0.0 that it equals: Parquet's filters tell the two apart
        return F.col(self.column).isin(sorted(v + 0.0 if isinstance(v, float) else v for v in self.values)) if self.values else F.lit(False)

    def verdict(self, known: set[str]) -> Column:
        if not self.values:
            return F.lit(NONE)
        if f"set_{self.column}" not in known:
            return F.lit(SOME)
        held, wanted = F.col(f"set_{self.column}"), F.array(*[F.lit(v) for v in sorted(self.values)])
        whole = F.size(F.array_except(held, wanted)) == 0
        whole = whole & (F.col(f"nulls_{self.column}") == 0) if f"nulls_{self.column}" in known else whole
        return F.when(held.isNull(), SOME).when(~F.arrays_overlap(held, wanted), NONE).when(whole, ALL).otherwise(SOME)

    def facet(self) -> tuple[str, object] | None:
        return (self.column, next(iter(self.values))) if len(self.values) == 1 else None


NUMBERS = frozenset("byte short integer long float double decimal".split())


def facet_kind(type_name: str) -> str | None:
    """The kind of keys of a column of a type; None if it has none."""
    return "number" if type_name in NUMBERS else {"string": "text", "boolean": "truth"}.get(type_name)


def facet_key(value: Column, kind: str) -> Column:
    # adding 0 makes -0.0 the 0.0 that it equals
    return (value.cast("double") + F.lit(0.0) if kind == "number" else value).cast("string")


def fixed_facet(value) -> tuple[str, Column] | None:
    """The kind and key of a predicate's value."""
    kind = "truth" if isinstance(value, bool) else "number" if isinstance(value, (int, float, Decimal)) else "text" if isinstance(value, str) else None
    return (kind, facet_key(F.lit(value), kind)) if kind else None


def conjunction(predicates) -> Column:
    return reduce(lambda a, b: a & b, [p.mask() for p in predicates], F.lit(True))


def verdict(predicates, known: set[str]) -> Column:
    """NONE over SOME over ALL; no predicate gives ALL."""
    each = [p.verdict(known) for p in predicates]
    return F.lit(ALL) if not each else each[0] if len(each) == 1 else F.least(*each)
