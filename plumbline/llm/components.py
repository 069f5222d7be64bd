"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step groups by node; the edges never reach the driver or a single task, and each round is written to the shared
folder, so that lost executors cost one round and the plan stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_files, stored


#: Parts into which the rows of one node are dealt; beyond them adaptive execution splits what is large.
SALT = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the least of them and itself: in the large star those above the node, in the
    small star those below."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # a component's root has as many rows as the component has members: they are dealt to SALT tasks
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(salted, ["u", "salt"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60, nodes: int | None = None) -> DataFrame:
    """(node, root) of each node of `edges` (u, v), root being the least node reachable.  No edges give no rows.

    The rounds follow the logarithm of the longest path; running out of them raises.  `nodes`, if known, tells how many
    files the first round is worth; it bounds nothing."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges if nodes is None else in_files(edges, nodes), "edges")
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark[0] == 0 or mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, edges = mark, stored(in_files(_star(_star(edges, True), False), mark[0]), "edges")
    raise RuntimeError(f"components are not settled after {rounds} rounds")
