"""Block summaries and the upper bounds they give.

A summary of a set of units holds its count, the unit-length mean vector with the angle that reaches all its vectors,
the greatest weights of its terms, value ranges and sets, and its newest time.  All are aggregations with partial sums
before the shuffle; only a block's key and its sums travel."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.predicates import facet_key, facet_kind
from ..functions.score import angle, inner_product, norm, recency, vector
from ..model import ScoreSpec

#: Distinct values of a category a block keeps; beyond, it holds null: any.
TRACKED = 64

#: Slack of the bounds over rounding in acos and cos, and over vectors longer than 1 by their rounding to single precision.
SLACK, LENGTH_SLACK = 1e-9, 2e-7


def centroids(units: DataFrame, by: list[str], d: int) -> DataFrame:
    """`by`, n, centroid: the mean vector at unit length, a sum for each dimension in one aggregation."""
    sums = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("vec")[i].cast("double")).alias(f"_{i}") for i in range(d)])
    mean = sums.select(*by, "n", F.array(*[F.col(f"_{i}") for i in range(d)]).alias("m"))
    return mean.select(*by, "n", F.transform("m", lambda x: x / F.greatest(norm(F.col("m")), F.lit(1e-12))).alias("centroid"))


def radii(units: DataFrame, centers: DataFrame, by: list[str]) -> DataFrame:
    """centers with radius, the greatest angle of a unit to its centroid."""
    far = units.select(*by, "vec").join(centers.select(*by, "centroid"), by).groupBy(*by).agg(F.max(angle(inner_product(F.col("vec"), F.col("centroid")))).alias("radius"))
    return centers.join(far, by)


def zone_maps(units: DataFrame, by: list[str], numeric: list[str], categorical: list[str]) -> DataFrame:
    """`by`, n, lo_/hi_ of numbers, nulls_ of both, set_ of categories (null beyond TRACKED), max_ts if there is a ts."""
    ranges = [f(F.col(c)).alias(f"{p}_{c}") for c in numeric for p, f in (("lo", F.min), ("hi", F.max))]
    nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls_{c}") for c in dict.fromkeys([*numeric, *categorical])]
    newest = [F.max("ts").alias("max_ts")] if "ts" in units.columns else []
    out = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *ranges, *nulls, *newest)
    for c in categorical:
        # at most TRACKED + 1 values of a block are ever collected
        each = units.where(F.col(c).isNotNull()).select(*by, c).distinct()
        few = each.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(c))).where(F.col("_i") <= TRACKED + 1)
        sets = few.groupBy(*by).agg(F.sort_array(F.collect_list(c)).alias("_s")).select(*by, F.when(F.size("_s") <= TRACKED, F.col("_s")).alias(f"set_{c}"), F.lit(True).alias("_any"))
        kind = F.array().cast(f"array<{units.schema[c].dataType.simpleString()}>")
        out = out.join(sets, by, "left").withColumn(f"set_{c}", F.when(F.col("_any").isNull(), kind).otherwise(F.col(f"set_{c}"))).drop("_any")
    return out


def term_maxima(terms: DataFrame, by: list[str], lam: int) -> DataFrame:
    """`by`, term, w, rank: the lam greatest maxima of each block and, at rank lam + 1, its residual.

    terms has `by`, term, w.  Equal weights are ranked by term."""
    top = terms.groupBy(*by, "term").agg(F.max("w").alias("w"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("w", 9)), "term"))
    return top.withColumn("rank", rank).where(F.col("rank") <= lam + 1)


def max_row_norms(terms: DataFrame, by: list[str]) -> DataFrame:
    """`by`, max_norm: the greatest length of a unit's vector of term weights."""
    rows = terms.groupBy(*by, "row_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w"))
    return rows.groupBy(*by).agg(F.max("w").alias("max_norm"))


# --- term filter: 2048 bits, four positions a term


BITS, PROBES, WORD = 2048, 4, 64


def term_id(term: Column) -> Column:
    """A term as a number below 2^60, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(term), 1, 15), 16, 10).cast("long")


def probe_positions(number: Column) -> Column:
    """The four positions of a term's number: begin and odd step are its lowest and next 11 bits."""
    begin, step = F.pmod(number, F.lit(BITS)), F.pmod(F.shiftright(number, 11), F.lit(BITS)).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(begin + F.lit(i) * step, F.lit(BITS)) for i in range(PROBES)])


def places_of(term: str) -> list[int]:
    """The positions of a term, on the driver."""
    number = int(hashlib.md5(term.encode()).hexdigest()[:15], 16)
    return [(number + i * (number >> 11 | 1)) % BITS for i in range(PROBES)]


def term_filter(terms: DataFrame, by: list[str], term_id: str = "term_id") -> DataFrame:
    """`by`, word, bits: the set bits of each block's filter, 64 to a word.  Filters merge by bit_or."""
    each = terms.select(*by, F.explode(probe_positions(F.col(term_id))).alias("p"))
    bit = F.expr(f"shiftleft(1L, cast(p % {WORD} as int))")
    return each.withColumn("word", F.floor(F.col("p") / WORD).cast("int")).groupBy(*by, "word").agg(F.bit_or(bit).alias("bits"))


# --- bounds


def dense_bound(spec: ScoreSpec) -> Column:
    """cos(max(0, angle to the centroid - radius)): no vector of the block is closer."""
    gap = angle(inner_product(F.col("centroid"), vector(spec.dense))) - F.col("radius") - F.lit(SLACK)
    return F.cos(F.greatest(F.lit(0.0), gap)) + F.lit(LENGTH_SLACK)


def sparse_summary(terms: DataFrame, by: list[str], lam: int, filtered: bool = True) -> DataFrame:
    """The sparse part of a block in one row: `kept` (at most lam terms and their maxima), `residual`, `max_norm` and,
    if asked for, `words`, the 64-bit words of the filter that are not 0.

    terms has `by`, row_id, term, w.  All maps are bounded: by lam, and by the filter's 32 words."""
    top = term_maxima(terms, by, lam)
    kept = top.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("rank") <= lam, F.struct("term", "w")))).alias("kept"),
        F.coalesce(F.max(F.when(F.col("rank") > lam, F.col("w"))), F.lit(0.0)).alias("residual"),
    )
    out = kept.join(max_row_norms(terms, by), by)
    if filtered:
        numbers = terms.select(*by, "term").distinct().select(*by, term_id(F.col("term")).alias("term_id"))
        words = term_filter(numbers, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
        out = out.join(words, by)
    return out


def holds(words: Column, term: str) -> Column:
    """Whether a filter may hold a term: all its bits are set.  Never false for a term that is there."""
    bits: dict[int, int] = {}
    for p in places_of(term):
        bits[p // WORD] = bits.get(p // WORD, 0) | 1 << p % WORD
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    each = [F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(0).cast("long")).bitwiseAND(F.lit(signed(m)).cast("long")) == F.lit(signed(m)).cast("long") for i, m in sorted(bits.items())]
    return reduce(lambda a, b: a & b, each)


def sparse_bound(spec: ScoreSpec, filtered: bool = True) -> Column:
    """Of a row of `sparse_summary`: each query term adds its maximum where kept, the residual where the filter may hold it,
    and nothing else; and the sum is no more than norm times norm."""
    total = F.lit(0.0)
    for term, w in sorted(spec.sparse.items()):
        rest = F.when(holds(F.col("words"), term), F.col("residual")).otherwise(0.0) if filtered else F.col("residual")
        total = total + F.lit(float(w)) * F.coalesce(F.try_element_at("kept", F.lit(term)), rest)
    return F.least(total, F.lit(spec.sparse_norm) * F.col("max_norm"))


def saturation(words: Column) -> Column:
    """The share of a filter's bits that are set."""
    return F.aggregate(F.map_values(words), F.lit(0), lambda n, x: n + F.bit_count(x)) / F.lit(float(BITS))


def fused_bound(spec: ScoreSpec) -> Column:
    """The bound of a block with centroid, radius, sparse_ub and max_ts, as far as the weights need them."""
    total = F.lit(SLACK)
    if spec.alpha and spec.dense:
        total = total + F.lit(spec.alpha) * dense_bound(spec)
    if spec.beta and spec.sparse:
        total = total + F.lit(spec.beta) * F.coalesce("sparse_ub", F.lit(0.0))
    if spec.gamma:
        total = total + F.lit(spec.gamma) * recency(F.col("max_ts"), spec.now, spec.half_life)
    return total


def summarize(units: DataFrame, by: list[str], d: int, numeric: list[str], categorical: list[str]) -> DataFrame:
    """A row per block with all but the sparse part."""
    return radii(units, centroids(units, by, d), by).join(zone_maps(units, by, numeric, categorical).drop("n"), by)


def term_table(units: DataFrame, by: list[str]) -> DataFrame:
    """`by`, row_id, term, w of the units' term maps."""
    return units.select(*by, "row_id", F.explode("terms").alias("term", "w"))


def facets(units: DataFrame, by: list[str], columns: list[str], d: int) -> DataFrame:
    """Summaries of each (block, facet column, value): `kind` and `value` are the key of functions.predicates.

    Columns whose type has no keys are left out."""
    kinds = {c: k for c in columns if (k := facet_kind(units.schema[c].dataType.typeName()))}
    each = F.array(*[F.struct(F.lit(c).alias("facet"), F.lit(k).alias("kind"), facet_key(F.col(c), k).alias("value")) for c, k in kinds.items()])
    if not kinds:
        each = F.array().cast("array<struct<facet: string, kind: string, value: string>>")
    rows = units.select(*by, "vec", "ts", F.explode(each).alias("f")).select(*by, "vec", "ts", "f.*").where("value IS NOT NULL")
    keys = [*by, "facet", "kind", "value"]
    return radii(rows, centroids(rows, keys, d), keys).join(rows.groupBy(*keys).agg(F.max("ts").alias("max_ts")), keys)


# --- merging


def merge_dense(children: DataFrame, parent: list[str], d: int) -> DataFrame:
    """Summaries of unions: counts add, the centroid is the weighted mean at unit length, and the radius reaches each
    child's cap (at most pi).  The bound of a parent is at least each child's."""
    weighted = children.groupBy(*parent).agg(F.sum("n").alias("n"), *[F.sum(F.col("centroid")[i] * F.col("n")).alias(f"_{i}") for i in range(d)])
    mean = weighted.select(*parent, "n", F.array(*[F.col(f"_{i}") for i in range(d)]).alias("m"))
    center = mean.select(*parent, "n", F.transform("m", lambda x: x / F.greatest(norm(F.col("m")), F.lit(1e-12))).alias("centroid"))
    reach = children.select(*parent, "radius", F.col("centroid").alias("_c")).join(center, parent)
    far = reach.groupBy(*parent).agg(F.least(F.lit(3.141592653589793), F.max(angle(inner_product(F.col("_c"), F.col("centroid"))) + F.col("radius"))).alias("radius"))
    return center.join(far, parent)


def merge_zones(children: DataFrame, parent: list[str]) -> DataFrame:
    """Value ranges, null counts, sets and newest times of unions, for whichever of those columns the children have.

    A set of more than TRACKED values is null (any), and one that is null in a child stays so; of others at most
    TRACKED + 1 values of a parent are ever collected."""
    names = children.columns
    fold = {"lo_": F.min, "hi_": F.max, "nulls_": F.sum, "max_": F.max}
    plain = [f(c).alias(c) for c in names for p, f in fold.items() if c.startswith(p)]
    sets = [c for c in names if c.startswith("set_")]
    out = children.groupBy(*parent).agg(F.count(F.lit(1)).alias("_children"), *plain, *[F.max(F.col(c).isNull()).alias(f"_any_{c}") for c in sets]).drop("_children")
    for c in sets:
        few = children.select(*parent, F.explode(c).alias("_v")).distinct()
        few = few.withColumn("_i", F.row_number().over(Window.partitionBy(*parent).orderBy("_v"))).where(F.col("_i") <= TRACKED + 1)
        few = few.groupBy(*parent).agg(F.sort_array(F.collect_list("_v")).alias("_s"))
        empty = F.array().cast(children.schema[c].dataType)
        out = out.join(few, parent, "left").withColumn(c, F.when(~F.col(f"_any_{c}") & (F.coalesce(F.size("_s"), F.lit(0)) <= TRACKED), F.coalesce("_s", empty))).drop("_s", f"_any_{c}")
    return out


def merge_sparse(children: DataFrame, parent: list[str], lam: int) -> DataFrame:
    """`kept`, `residual`, `max_norm` and `words` of unions of rows of `sparse_summary`.

    A term that some child did not keep counts there with the child's residual, unless its filter rules it out; what the
    parent does not keep goes into its residual."""
    filtered = "words" in children.columns
    slim = children.select(*parent, "kept", "residual", "max_norm", *(["words"] if filtered else [])).withColumn("_child", F.monotonically_increasing_id())
    names = slim.select(*parent, F.explode(F.map_keys("kept")).alias("term")).distinct()
    known = F.try_element_at("kept", F.col("term"))
    rest = F.col("residual")
    if filtered:
        bit = lambda p: F.shiftright(F.coalesce(F.try_element_at("words", F.floor(p / WORD).cast("int")), F.lit(0).cast("long")), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(WORD)).cast("int"))) != 0
        rest = F.when(F.forall(probe_positions(term_id(F.col("term"))), bit), rest).otherwise(0.0)
    top = names.join(slim, parent).groupBy(*parent, "term").agg(F.max(F.coalesce(known, rest)).alias("w"))
    rank = F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc(F.round("w", 9)), "term"))
    ranked = top.withColumn("rank", rank).groupBy(*parent).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("rank") <= lam, F.struct("term", "w")))).alias("kept"),
        F.coalesce(F.max(F.when(F.col("rank") > lam, F.col("w"))), F.lit(0.0)).alias("_over"),
    )
    out = slim.groupBy(*parent).agg(F.max("residual").alias("_r"), F.max("max_norm").alias("max_norm")).join(ranked, parent)
    out = out.select(*parent, "kept", F.greatest("_r", "_over").alias("residual"), "max_norm")
    if filtered:
        words = slim.select(*parent, F.explode("words").alias("word", "bits")).groupBy(*parent, "word").agg(F.bit_or("bits").alias("bits"))
        out = out.join(words.groupBy(*parent).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")), parent)
    return out


def merge(children: DataFrame, parent: list[str], d: int, lam: int = 0) -> DataFrame:
    """Whole summaries of unions of blocks: the dense part, and all others that the children have.  Facets, which are rows
    of their own, merge by `merge_dense` over their keys."""
    out = merge_dense(children, parent, d)
    if any(c.startswith(("lo_", "hi_", "nulls_", "set_", "max_")) for c in children.columns):
        out = out.join(merge_zones(children.drop("max_norm"), parent), parent)
    return out.join(merge_sparse(children, parent, lam), parent) if "kept" in children.columns else out


def summary_bytes(summaries: DataFrame) -> Column:
    """The bytes of a row of a table of summaries: 8 a number, text by its length; maps and arrays by what they hold."""

    def size(c: Column, kind) -> Column:
        name = kind.typeName()
        if name == "string":
            out = F.octet_length(c)
        elif name == "array":
            out = F.aggregate(c, F.lit(0), lambda n, x: n + size(x, kind.elementType).cast("int"))
        elif name == "map":
            out = size(F.map_keys(c), ArrayType(kind.keyType)) + size(F.map_values(c), ArrayType(kind.valueType))
        else:
            out = F.lit(8)
        return F.coalesce(out.cast("int"), F.lit(0))

    return reduce(lambda a, b: a + b, [size(F.col(f.name), f.dataType) for f in summaries.schema.fields])
