"""Top-k search: the full scan, and the pruned search in waves of blocks by descending bound.

Bounds of blocks stay in a DataFrame: a wave takes the best of them by a limit, and the rows of the opened blocks are
found by a join, in the files that the summaries name.  The driver holds at most WAVE_BLOCKS block names at a time."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import NONE, conjunction, fixed_facet, verdict
from ..functions.score import fused, inner_product, ratio, vector
from ..model import Certificate, ScoreSpec, SearchStats
from ..shipping import ship
from . import summary

#: Blocks of the first wave, by how much the next is larger, and blocks of a wave at most; beyond that many that may still
#: matter, the rest is one join.  Files that a wave may name before the whole table is read instead.
FIRST_WAVE, GROWTH, WAVE_BLOCKS, WAVE_FILES = 16, 4, 4096, 10_000


@dataclass
class Result:
    hits: DataFrame
    certificate: Certificate
    stats: SearchStats
    elapsed_ms: float = 0.0
    context: object = None


def scored(units: DataFrame, spec: ScoreSpec, predicates=(), digits: int | None = None) -> DataFrame:
    score: Column = fused(spec)
    return units.where(conjunction(predicates)).withColumn("score", F.round(score, digits) if digits is not None else score)


def top_k(units: DataFrame, spec: ScoreSpec, k: int = 10, predicates=(), digits: int | None = None, columns=("row_id",)) -> DataFrame:
    """The exact answer by a full scan: filter, score, and a bounded heap in each task.  Ties go to the lesser row_id."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return scored(units, spec, predicates, digits).select(*columns, "score").orderBy(F.desc("score"), "row_id").limit(k)


def bounds(summaries: DataFrame, spec: ScoreSpec, predicates=(), facets: DataFrame | None = None, filtered: bool = True) -> DataFrame:
    """block_id, n, verdict, ub and, if the summaries have them, files of each block.

    Where a predicate fixes a facet column, the facet's bound caps the block's, and a block without that facet is out.
    That holds only for a column whose keys are all of the kind of the predicate's value; on others facets say nothing."""
    known = set(summaries.columns)
    if spec.beta and spec.sparse and "kept" in known:
        summaries = summaries.withColumn("sparse_ub", summary.sparse_bound(spec, filtered and "words" in known))
    more = [c for c in ("files",) if c in known]
    out = summaries.withColumn("ub", summary.fused_bound(spec)).withColumn("verdict", verdict(predicates, known))
    fixed = [(f[0], *key) for p in predicates if (f := p.facet()) and (key := fixed_facet(f[1]))]
    if facets is not None and fixed:
        kinds: dict[str, set] = {}
        for r in facets.select("facet", "kind").distinct().collect():  # a row for each facet column
            kinds.setdefault(r.facet, set()).add(r.kind)
        carried = [c for c in ("sparse_ub",) if c in summaries.columns]
        for i, (column, kind, key) in enumerate(x for x in fixed if kinds.get(x[0]) == {x[1]}):
            own = facets.where((F.col("facet") == column) & (F.col("value") == key)).join(summaries.select("block_id", *carried), "block_id")
            own = own.select("block_id", summary.fused_bound(spec).alias(f"_f{i}"))
            out = out.join(own, "block_id", "left").withColumn("verdict", F.when(F.col(f"_f{i}").isNull(), NONE).otherwise(F.col("verdict")))
            out = out.withColumn("ub", F.least("ub", F.coalesce(f"_f{i}", "ub")))
    return out.select("block_id", "n", "verdict", "ub", *more)


def certify(scores: list[float], k: int, remaining: float, probabilistic: bool = False) -> Certificate:
    """With fewer than k hits nothing bounds the missing ranks: exact only if nothing remains."""
    kth = scores[k - 1] if len(scores) >= k else -math.inf
    return Certificate(kth, remaining, remaining == -math.inf or remaining <= kth, probabilistic)


def certificate_frame(spark, certificate: Certificate) -> DataFrame:
    """The certificate as a row, with its ratio."""
    row = spark.createDataFrame([(certificate.kth_score, certificate.max_remaining_bound, certificate.exact)], "kth_score double, max_remaining_bound double, exact boolean")
    return row.withColumn("ratio", ratio(F.col("kth_score"), F.col("max_remaining_bound")))


def pruned_top_k(units: DataFrame, block_bounds: DataFrame, spec: ScoreSpec, k: int = 10, predicates=(), epsilon: float = 0.0, block_budget: int | None = None, memtable: DataFrame | None = None, read: Callable[[list[str]], DataFrame] | None = None, quantizer=None) -> Result:
    """Opens blocks by descending bound until no bound left can change the answer (to a factor 1 + epsilon), or
    block_budget blocks are open.  units has block_id; memtable rows have no block and are always scored.

    Bounds exceed all scores by at least summary.SLACK, so a closed block holds no row that ties with the k-th.  `read`
    gives the rows of some files, where block_bounds has their names.  With a quantizer, units have codes: vectors are
    read only of rows whose estimate may do, and the answer is marked probabilistic."""
    if k < 1:
        raise ValueError("k must be at least 1")
    began, spark = time.perf_counter(), units.sparkSession
    table = block_bounds.persist()
    named = read is not None and "files" in table.columns
    best: list[tuple[float, int]] = []
    guessed = -math.inf

    def take(rows: DataFrame, coded: bool) -> None:
        nonlocal best, guessed
        if coded:
            rows, guessed = quantizer.candidates(rows.where(conjunction(predicates)), spec, k, guessed)
        found = [(r.score, r.row_id) for r in top_k(rows, spec, k, predicates).collect()]
        # a repeated row_id may stand in the answer as often as in the table, but a row only once
        best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]

    def scan(blocks: DataFrame, count: int) -> int:
        """Scores the rows of `count` blocks; the rows read for it."""
        source, rows = units, total.rows
        if named:
            files = blocks.select(F.explode("files").alias("f")).distinct()
            some = [r.f for r in files.limit(WAVE_FILES + 1).collect()]
            if len(some) <= WAVE_FILES:
                source = read(some)
                rows = table.select("n", F.explode("files").alias("f")).join(F.broadcast(files), "f").agg(F.sum("n")).first()[0]
        names = blocks.select("block_id")
        # a wave's names are few; the join with more of them is left to the planner
        take(source.join(F.broadcast(names) if count <= WAVE_BLOCKS else names, "block_id", "left_semi"), quantizer is not None)
        return rows

    try:
        total = table.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when(F.col("verdict") == NONE, 1)).alias("none")).first()
        stats = SearchStats(blocks_total=total.blocks, pruned_by_predicate=total.none, rows_total=total.rows)
        if memtable is not None:
            take(memtable, False)
        order, live = [F.desc("ub"), "block_id"], table.where(F.col("verdict") != NONE)
        left, size, budget = live, FIRST_WAVE, math.inf if block_budget is None else block_budget
        while True:
            kth = best[k - 1][0] if len(best) >= k else -math.inf
            limit = kth * (1 + epsilon if kth > 0 else 1)
            # what is left, and how much of it may matter
            may = F.col("ub") > limit
            rest = left.agg(F.max("ub").alias("ub"), F.count(F.when(may, 1)).alias("blocks")).first()
            open_now = int(min(rest.blocks, budget - stats.blocks_opened))
            if open_now <= 0:
                break
            count = open_now if kth > -math.inf and open_now > WAVE_BLOCKS and block_budget is None else min(open_now, size, WAVE_BLOCKS)
            if count == open_now and block_budget is None:
                wave, last = left.where(may), None
            else:
                rows = left.orderBy(*order).limit(count).collect()
                last = rows[-1]
                wave = spark.createDataFrame(rows, left.schema)
            n = wave.agg(F.sum("n")).first()[0]
            read_rows = scan(wave, count)
            stats = replace(stats, waves=stats.waves + 1, blocks_opened=stats.blocks_opened + count, rows_scored=stats.rows_scored + n, rows_read=stats.rows_read + read_rows)
            left = left.where(~may) if last is None else left.where((F.col("ub") < last.ub) | (F.col("ub") == last.ub) & (F.col("block_id") > last.block_id))
            size *= GROWTH
        remaining = rest.ub if rest.ub is not None else -math.inf
        stats = replace(stats, pruned_by_bound=total.blocks - total.none - stats.blocks_opened)
    finally:
        table.unpersist()
    hits = spark.createDataFrame([(i, s) for s, i in best], "row_id long, score double")
    return Result(hits, certify([s for s, _ in best], k, remaining, quantizer is not None), stats, (time.perf_counter() - began) * 1e3)


def fetch(hits: DataFrame, units: DataFrame, columns: list[str]) -> DataFrame:
    """The payload of k hits: a broadcast of k small rows against a narrow scan."""
    return units.select("row_id", *columns).join(F.broadcast(hits), "row_id")


def batch_top_k(units: DataFrame, queries: np.ndarray, k: int = 10) -> DataFrame:
    """query, row_id, score: exact dense top-k of many queries, one matrix product per Arrow batch.

    queries is a matrix the caller holds already; each task sends at most k rows a query."""
    ship(units.sparkSession)
    sent = units.sparkSession.sparkContext.broadcast(np.asarray(queries, np.float64))

    def run(batches):
        import pyarrow as pa

        q = sent.value
        scores, ids = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            vecs = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            own = np.round(q @ vecs.T.astype(np.float64), 6)
            scores = np.concatenate([scores, own], 1)
            ids = np.concatenate([ids, np.broadcast_to(b.column(0).to_numpy(), own.shape)], 1)
            order = np.lexsort((ids, -scores))[:, :k]
            scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        names = np.repeat(np.arange(len(q)), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(ids.reshape(-1), pa.int64()), pa.array(scores.reshape(-1), pa.float64())], ["query", "row_id", "score"])

    found = units.select("row_id", "vec").mapInArrow(run, "query int, row_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def batch_over(units: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """query (a row_id of `asked`), row_id, score: batch_top_k for any number of queries.

    The queries come to the driver in blocks of at most `block`, by ranges of their ids, one after the other; each block is one pass
    over the units."""
    out, last = None, None
    while True:
        part = asked.select("row_id", "vec") if last is None else asked.select("row_id", "vec").where(F.col("row_id") > last)
        rows = part.orderBy("row_id").limit(block).collect()
        if not rows:
            break
        last, q = rows[-1].row_id, np.stack([np.asarray(r.vec, np.float64) for r in rows])
        names = units.sparkSession.createDataFrame([(i, r.row_id) for i, r in enumerate(rows)], "query int, _id long")
        found = batch_top_k(units, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12), k)
        found = found.join(F.broadcast(names), "query").select(F.col("_id").alias("query"), "row_id", "score")
        out = found if out is None else out.unionByName(found)
        if len(rows) < block:
            break
    return out if out is not None else units.select(F.col("row_id").alias("query"), "row_id", F.lit(0.0).alias("score")).limit(0)


def ivf_top_k(units: DataFrame, centres: DataFrame, spec: ScoreSpec, nprobe: int, k: int, digits: int | None = None) -> DataFrame:
    """The lists (`block_id`) of the nprobe nearest centroids, scanned; approximate."""
    near = centres.withColumn("_s", F.round(inner_product(F.col("centroid"), vector(spec.dense)), 9)).orderBy(F.desc("_s"), "block_id").limit(nprobe).select("block_id")
    return top_k(units.join(F.broadcast(near), "block_id", "left_semi"), spec, k, digits=digits)


