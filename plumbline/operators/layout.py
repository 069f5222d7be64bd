"""Physical layout: units to blocks of near vectors, and a tree over blocks.

Coarse centres, found on a bounded sample, deal the units out in a map step; a cell larger than `cell` units is dealt into
salted parts; within a part, cuts in two go on until a block is small and narrow enough.  The parts are what one task
holds.  Each row goes through one shuffle, whole, and comes out beside its neighbours; rows in are rows out, whatever their row_ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.score import l2_normalize
from ..shipping import ship

#: Coarse centres at most (in two levels of the root of that) and sampled units for each; units of one task's part.
CENTRES, PER_CENTRE, CELL = 4096, 16, 50_000

#: Units of a block below which it is not cut for its width alone, rounds in which a cut settles, and fan-out of the tree.
LEAST, SETTLE, FANOUT = 16, 12, 16


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def width(vecs: np.ndarray) -> float:
    """The greatest angle between unit vectors and their mean direction."""
    return float(np.arccos(np.clip((vecs @ _unit(vecs.mean(0))).min(), -1.0, 1.0)))


def halves(vecs: np.ndarray) -> np.ndarray:
    """A mask that parts unit vectors in two: by nearness to two poles, which then move to the means of their sides.

    The first pole is the vector furthest from the mean, the second the one furthest from the first.  Vectors that cannot be
    told apart are cut in the middle of their order along the poles."""
    first = vecs[(vecs @ vecs.mean(0)).argmin()]
    axis = vecs[(vecs @ first).argmin()] - first
    mask = np.zeros(len(vecs), bool)
    for _ in range(SETTLE):
        now = vecs @ axis > 0
        if now.all() or not now.any():
            order = np.argsort(vecs @ axis, kind="stable")
            now = np.zeros(len(vecs), bool)
            now[order[len(vecs) // 2 :]] = True
            return now
        if (now == mask).all():
            break
        mask = now
        axis = _unit(vecs[mask].mean(0)) - _unit(vecs[~mask].mean(0))
    return mask


def _cut(vecs: np.ndarray, rows: np.ndarray, most: int, widest: float | None) -> Iterator[np.ndarray]:
    own = vecs[rows]
    if len(rows) <= 1 or len(rows) <= most and (widest is None or len(rows) <= LEAST or width(own) <= widest):
        yield rows
        return
    stack = halves(own)
    for side in (~stack, stack):
        yield from _cut(vecs, rows[side], most, widest)


def block_numbers(vecs: np.ndarray, block_size: int, max_radius: float | None = None) -> np.ndarray:
    """A block number for each vector: at most block_size in a block, and none wider than max_radius above LEAST."""
    out = np.zeros(len(vecs), np.int64)
    for number, rows in enumerate(_cut(vecs, np.arange(len(vecs)), block_size, max_radius)):
        out[rows] = number
    return out


def coarse_centres(units: DataFrame, k: int, n: int, seed: int = 0) -> list[np.ndarray]:
    """At most k centres of a bounded sample, as a list of groups: the first level's centres and then each one's own."""
    want = PER_CENTRE * k
    rows = units.select("vec").sample(min(1.0, 1.2 * want / max(n, 1)), seed).limit(want).toPandas()["vec"]
    if k <= 1 or not len(rows):
        return []
    vecs = np.stack(rows.to_numpy()).astype(np.float32)
    means = lambda x, cells: _unit(np.stack([x[cells == c].mean(0) for c in np.unique(cells)]))
    size = lambda m, parts: max(1, -(-2 * m // parts))
    top = int(np.ceil(np.sqrt(k)))
    cells = block_numbers(vecs, size(len(vecs), top))
    groups = [means(vecs, cells)]
    near = (vecs @ groups[0].T).argmax(1)
    for c in range(len(groups[0])):
        own = vecs[near == c]
        groups.append(means(own, block_numbers(own, size(len(own), top))) if len(own) else groups[0][c : c + 1])
    return groups


def lay_out(units: DataFrame, block_size: int = 256, max_radius: float | None = 0.7, partition_by: str | None = None, seed: int = 0, cell: int = CELL, n: int | None = None) -> DataFrame:
    """units (vec at unit length) with block_id, a string; values of partition_by never share a block.

    Rows of a block stand together.  `n` is their number, if known; units should come from a table, since they are read
    three times: vectors for the sample, vectors for the sizes of cells, and whole rows."""
    spark = units.sparkSession
    ship(spark)
    units = units.drop("block_id").withColumn("vec", l2_normalize(F.col("vec")).cast("array<float>"))
    n = units.count() if n is None else n
    sent = spark.sparkContext.broadcast(coarse_centres(units, min(CENTRES, n // max(1, cell // 4)), n, seed))

    @F.pandas_udf(T.IntegerType())
    def nearest(vec: pd.Series) -> pd.Series:
        groups, out = sent.value, np.zeros(len(vec), np.int32)
        if groups:
            x = np.stack(vec.to_numpy()).astype(np.float32)
            top = (x @ groups[0].T).argmax(1)
            for c in np.unique(top):
                out[top == c] = c * CENTRES + (x[top == c] @ groups[1 + c].T).argmax(1)
        return pd.Series(out)

    part = [F.col(partition_by).alias("_p")] if partition_by else []
    dealt = units.withColumn("_cell", nearest("vec"))
    sizes = dealt.groupBy(F.col("_cell").alias("_c"), *part).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("_parts")).where("_parts > 1")
    on = F.col("_cell") == F.col("_c")
    if partition_by:
        on = on & F.col(partition_by).eqNullSafe(F.col("_p"))
    # only cells of several parts are in it: n / cell rows at most
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = dealt.join(sizes, on, "left").withColumn("_salt", salt).drop("_c", "_p", "_parts")

    def split(table: pa.Table) -> pa.Table:
        flat = table["vec"].combine_chunks()
        vecs = flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(np.float32)
        numbers = block_numbers(vecs, block_size, max_radius)
        value = f"{table[partition_by][0].as_py()}-" if partition_by else ""
        begin = f"{value}{table['_cell'][0].as_py()}-{table['_salt'][0].as_py()}-"
        names = pa.array([f"{begin}{b:06d}" for b in numbers.tolist()])
        return table.drop_columns(["_cell", "_salt"]).append_column("block_id", names).take(pa.array(np.argsort(numbers, kind="stable")))

    keys = ["_cell", "_salt", *([partition_by] if partition_by else [])]
    return dealt.groupBy(*keys).applyInArrow(split, T.StructType([*units.schema.fields, T.StructField("block_id", T.StringType())]))


# --- the tree


def build_tree(summaries: DataFrame, d: int, folder: str, lam: int = 0, fanout: int = FANOUT) -> list[DataFrame]:
    """Summaries of summaries, level by level: the blocks with `parent`, their parents, and so on to one root.

    Each level is laid out by its centroids like units, at most `fanout` children to a node, and merged by
    `summary.merge`.  Levels are written under `folder`, which driver and executors share, so that none is made twice."""
    from . import summary

    def kept(level: DataFrame, name: str) -> DataFrame:
        level.write.parquet(f"{folder}/{name}")
        return summaries.sparkSession.read.parquet(f"{folder}/{name}")

    levels, nodes, depth = [], kept(summaries.withColumnRenamed("block_id", "node"), "blocks"), 0
    while (n := nodes.count()) > 1:
        slim = nodes.select("node", F.col("centroid").alias("vec"))
        # width plays no part: nodes are grouped by nearness, and every level is at most half of the one below
        owner = slim.select("node", F.lit("root").alias("block_id")) if n <= fanout else lay_out(slim, fanout, None, n=n)
        levels.append(kept(nodes.join(owner.select("node", F.concat(F.lit(f"{depth}:"), "block_id").alias("parent")), "node"), f"level-{depth}"))
        nodes = kept(summary.merge(levels[-1], ["parent"], d, lam).withColumnRenamed("parent", "node"), f"nodes-{depth}")
        depth += 1
    return [*levels, nodes]


def descend(levels: list[DataFrame], bound, least: float) -> DataFrame:
    """The blocks (node, ub) that may hold a row scoring above `least`, from the root down: a level's nodes are looked at
    only under parents whose own bound exceeds it."""
    open_ = levels[-1].select("node", bound.alias("ub")).where(F.col("ub") > least)
    for level in reversed(levels[:-1]):
        under = level.join(open_.select(F.col("node").alias("parent")), "parent", "left_semi")
        open_ = under.select("node", bound.alias("ub")).where(F.col("ub") > least)
    return open_
