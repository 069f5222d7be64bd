"""The engine's registered queries with their SQL.  Each runs over whole tables.

The units are the documents: each has the vector of one embedding, the time and value of one event and the quality of
its label.  Blocks are the embeddings' labels, so that block queries have a plain SQL form."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import score as S
from .functions.predicates import InSet, Range, conjunction, verdict
from .model import Config, ScoreSpec
from .operators import assemble as A
from .operators import layout, search, summary
from .operators.quantize import Quantizer, rotation
from .plans.ql import parse
from .sources.store import Store

NOW, PROBE, K, LAM = 1706745600.0, 7, 10, 24
TERMS = {"the": 0.5, "of": 0.3, "token": 1.0, "und": 0.7}

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@cache
def _rows_of(spark: SparkSession, sf: str, name: str) -> int:
    return table(spark, sf, name).count()


def units(spark: SparkSession, sf: str) -> DataFrame:
    docs, emb, events, labels = (table(spark, sf, t) for t in ("documents", "embeddings", "events", "labels"))
    ne, nv = _rows_of(spark, sf, "embeddings"), _rows_of(spark, sf, "events")
    d = docs.withColumn("_e", F.col("doc_id") % ne).withColumn("_v", F.col("doc_id") % nv)
    e = emb.select(F.col("vec_id").alias("_e"), F.col("embedding").alias("vec"), "label")
    v = events.select(F.col("event_id").alias("_v"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "value")
    out = d.join(e, "_e").join(v, "_v").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return out.select(
        F.col("doc_id").alias("row_id"), F.floor(F.col("doc_id") / 8).alias("doc_id"), (F.col("doc_id") % 8).cast("int").alias("ordinal"), (F.col("doc_id") % 80 + 40).alias("tokens"),
        "ts", "vec", "label", "lang", "source", "n_chars", "value", "quality", "text",
    )


def terms(u: DataFrame, by: list[str] = [], only: list[str] | None = None) -> DataFrame:  # noqa: B006
    """`by`, row_id, term, w of the units' texts; of the terms `only`, if given, before anything is shuffled."""
    words = F.split(F.lower("text"), r"[^\p{L}0-9]+", -1)
    if only is not None:
        words = F.filter(words, lambda x: x.isin(only))
    each = u.select(*by, "row_id", F.explode(words).alias("term")).where("term <> ''")
    return each.groupBy(*by, "row_id", "term").agg((F.log(F.count(F.lit(1)).cast("double")) + 1).alias("w"))


def probe(spark: SparkSession, sf: str, **more) -> ScoreSpec:
    v = table(spark, sf, "embeddings").where(F.col("vec_id") == PROBE).first()["embedding"]
    return ScoreSpec(tuple(map(float, v)), now=NOW, **more).bound()


U = r"""u AS (SELECT d.doc_id AS row_id, d.doc_id // 8 AS doc_id, (d.doc_id % 8)::INT AS ordinal, d.doc_id % 80 + 40 AS tokens, epoch_us(v.ts) / 1e6 AS ts, e.embedding::DOUBLE[] AS vec, e.label, d.lang, d.source, d.n_chars, v.value, l.quality, d.text
 FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) JOIN events v ON v.event_id = d.doc_id % (SELECT count(*) FROM events) LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
Q = "q AS (SELECT list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS q FROM embeddings WHERE vec_id = 7)"
T = r"t AS (SELECT row_id, label, lang, term, 1 + ln(count(*)) AS w FROM (SELECT row_id, label, lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}0-9]+')) AS term FROM u) WHERE term <> '' GROUP BY ALL)"
QT = "qt(term, qw) AS (VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in TERMS.items()) + ")"
DENSE, REC = "list_inner_product(u.vec, q.q)", f"power(0.5, greatest(0, {NOW} - u.ts) / 2592000)"
SP = f"{T}, {QT}, sp AS (SELECT row_id, sum(w * qw) AS s FROM t JOIN qt USING (term) GROUP BY row_id)"


def top_sql(score: str, where: str = "true", more: str = "", joins: str = "", k: int = K) -> str:
    return f"WITH {U}, {Q}{more} SELECT u.row_id, round({score}, 6) AS score FROM u CROSS JOIN q {joins} WHERE {where} ORDER BY score DESC, row_id LIMIT {k}"


# --- filters


def _filtered(*predicates):
    return lambda spark, sf: table(spark, sf, "lineitem").where(conjunction(predicates)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def _filter_sql(where: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE {where}"


for _name, _predicates, _where in (
    ("filter_range", [Range("l_discount", 0.05, 0.07)], "l_discount BETWEEN 0.05 AND 0.07"),
    ("filter_in", [InSet("l_returnflag", frozenset("RA"))], "l_returnflag IN ('R', 'A')"),
    ("filter_conj", [Range("l_quantity", hi=24), InSet("l_linestatus", frozenset("F")), Range("l_extendedprice", 1000, 30000)], "l_quantity <= 24 AND l_linestatus = 'F' AND l_extendedprice BETWEEN 1000 AND 30000"),
    ("filter_strict", [Range("l_quantity", 10, 20, True, True)], "l_quantity > 10 AND l_quantity < 20"),
    ("filter_eq", parse("SELECT TOP 1 WHERE l_linenumber = 3 AND l_quantity = 7").predicates, "l_linenumber = 3 AND l_quantity = 7"),
):
    REGISTRY[_name], SQL[_name] = _filtered(*_predicates), _filter_sql(_where)


# --- scores


@query("SELECT vec_id, round(list_inner_product(n, n), 6) AS size, round(n[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS n FROM embeddings)")
def l2_normalize(spark, sf):
    n = table(spark, sf, "embeddings").select("vec_id", S.l2_normalize(F.col("embedding")).alias("n"))
    return n.select("vec_id", F.round(S.inner_product(F.col("n"), F.col("n")), 6).alias("size"), F.round(F.col("n")[0], 6).alias("first"))


@query(top_sql(DENSE))
def topk_dense(spark, sf):
    return search.top_k(units(spark, sf), probe(spark, sf), K, digits=6)


@query(f"WITH {U}, {SP} SELECT row_id, round(s, 6) AS score FROM sp ORDER BY score DESC, row_id LIMIT {K}")
def topk_sparse(spark, sf):
    return _sparse(spark, units(spark, sf)).select("row_id", F.round("s", 6).alias("score")).orderBy(F.desc("score"), "row_id").limit(K)


def _sparse(spark, u: DataFrame) -> DataFrame:
    """row_id, s: the long form of the sparse product, a join with the query's few terms before the sums."""
    asked = spark.createDataFrame(list(TERMS.items()), "term string, qw double")
    return terms(u, only=list(TERMS)).join(F.broadcast(asked), "term").groupBy("row_id").agg(F.sum(F.col("w") * F.col("qw")).alias("s"))


@query(top_sql(f"0.5 * {REC}"))
def topk_recency(spark, sf):
    return search.top_k(units(spark, sf), ScoreSpec(None, {}, 0.0, 0.0, 0.5, NOW), K, digits=6)


@query(top_sql(f"0.7 * {DENSE} + 0.3 * coalesce(sp.s, 0)", more=f", {SP}", joins="LEFT JOIN sp USING (row_id)"))
def topk_hybrid(spark, sf):
    return _hybrid(spark, sf, 0.0)


@query(top_sql(f"0.7 * {DENSE} + 0.3 * coalesce(sp.s, 0) + 0.2 * {REC}", more=f", {SP}", joins="LEFT JOIN sp USING (row_id)"))
def topk_hybrid_recency(spark, sf):
    return _hybrid(spark, sf, 0.2)


def _hybrid(spark, sf, gamma):
    u = units(spark, sf)
    per_row = terms(u, only=list(TERMS)).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("terms"))
    spec = probe(spark, sf, sparse=TERMS, alpha=0.7, beta=0.3, gamma=gamma)
    return search.top_k(u.select("row_id", "vec", "ts").join(per_row, "row_id", "left"), spec, K, digits=6)


@query(top_sql(f"0.7 * {DENSE} + 0.1 * {REC}", "u.label IN (1, 2, 3) AND u.n_chars >= 500 AND u.lang = 'en'"))
def topk_filtered(spark, sf):
    spec = probe(spark, sf, alpha=0.7, gamma=0.1)
    return search.top_k(units(spark, sf), spec, K, [InSet("label", frozenset({1, 2, 3})), Range("n_chars", 500), InSet("lang", frozenset({"en"}))], 6)


FLAGSHIP = "SELECT TOP 10 FROM units WHERE label IN (1, 2, 3) AND n_chars > 200 NEAR :v FUSE dense 0.7, recency 0.1 HALFLIFE 30 d GUARANTEE EXACT"


@query(top_sql(f"0.7 * {DENSE} + 0.1 * {REC}", "u.label IN (1, 2, 3) AND u.n_chars > 200"))
def ql_execute(spark, sf):
    q = parse(FLAGSHIP)
    spec = q.bind({"v": table(spark, sf, "embeddings").where(F.col("vec_id") == PROBE).first()["embedding"]}, NOW)
    return search.top_k(units(spark, sf), spec, q.k, q.predicates, 6)


# --- summaries over the embeddings' labels as blocks

E = "e AS (SELECT vec_id AS row_id, label AS block_id, embedding::DOUBLE[] AS vec FROM embeddings)"
CEN = f"""{E}, m AS (SELECT block_id, i, avg(x) AS x FROM (SELECT block_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM e) GROUP BY ALL),
 ml AS (SELECT block_id, list(x ORDER BY i) AS m FROM m GROUP BY block_id),
 c AS (SELECT block_id, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) AS centroid FROM ml)"""
RAD = f"{CEN}, r AS (SELECT block_id, count(*) AS n, max(acos(greatest(-1, least(1, list_inner_product(vec, centroid))))) AS radius FROM e JOIN c USING (block_id) GROUP BY block_id)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("block_id"), F.col("embedding").alias("vec"))


@cache
def _dimensions(sf: str, spark: SparkSession) -> int:
    return table(spark, sf, "embeddings").select(F.size("embedding").alias("d")).first()["d"]


def _summaries(spark, sf, by=("block_id",)):
    e = _vectors(spark, sf)
    return summary.radii(e, summary.centroids(e, list(by), _dimensions(sf, spark)), list(by))


@query(f"WITH {RAD} SELECT block_id, i - 1 AS i, n, round(x, 6) AS x FROM (SELECT block_id, n, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM c JOIN r USING (block_id))")
def block_summary(spark, sf):
    return _summaries(spark, sf).select("block_id", "n", F.posexplode("centroid").alias("i", "x")).select("block_id", F.col("i").cast("long").alias("i"), "n", F.round("x", 6).alias("x"))


@query(f"WITH {RAD} SELECT block_id, n, round(radius, 6) AS radius FROM r")
def block_radius(spark, sf):
    return _summaries(spark, sf).select("block_id", "n", F.round("radius", 6).alias("radius"))


ZONES = f"""z AS (SELECT label AS block_id, count(*) AS n, min(n_chars) AS lo_n_chars, max(n_chars) AS hi_n_chars, min(value) AS lo_value, max(value) AS hi_value, max(ts) AS max_ts, count(*) FILTER (quality IS NULL) AS nulls_quality, list_sort(list(DISTINCT lang)) AS set_lang FROM u GROUP BY label)"""


def _zones(spark, sf):
    return summary.zone_maps(units(spark, sf).withColumn("block_id", F.col("label")), ["block_id"], ["n_chars", "value", "quality"], ["lang"])


@query(f"WITH {U}, {ZONES} SELECT block_id, n, lo_n_chars, hi_n_chars, round(lo_value, 6) AS lo_value, round(hi_value, 6) AS hi_value, round(max_ts, 3) AS max_ts, nulls_quality, array_to_string(set_lang, ',') AS langs FROM z")
def zone_maps(spark, sf):
    z = _zones(spark, sf)
    return z.select("block_id", "n", "lo_n_chars", "hi_n_chars", F.round("lo_value", 6).alias("lo_value"), F.round("hi_value", 6).alias("hi_value"), F.round("max_ts", 3).alias("max_ts"), "nulls_quality", F.array_join("set_lang", ",").alias("langs"))


MAXIMA = f"{T}, tm AS (SELECT lang AS block_id, term, max(w) AS w FROM t GROUP BY ALL), rk AS (SELECT block_id, term, w, row_number() OVER (PARTITION BY block_id ORDER BY round(w, 9) DESC, term) AS rank FROM tm)"


def _maxima(spark, sf, lam=LAM):
    u = units(spark, sf).withColumn("block_id", F.col("lang"))
    return summary.term_maxima(terms(u, ["block_id"]), ["block_id"], lam)


@query(f"WITH {U}, {MAXIMA} SELECT block_id, term, round(w, 6) AS w, rank::INT AS rank FROM rk WHERE rank <= {LAM + 1}")
def term_maxima(spark, sf):
    return _maxima(spark, sf).select("block_id", "term", F.round("w", 6).alias("w"), "rank")


FACETS = f"""{U}, f AS (SELECT label AS block_id, lang AS value, vec, ts FROM u), m AS (SELECT block_id, value, i, avg(x) AS x FROM (SELECT block_id, value, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM f) GROUP BY ALL),
 ml AS (SELECT block_id, value, list(x ORDER BY i) AS m FROM m GROUP BY ALL), c AS (SELECT block_id, value, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) AS centroid FROM ml),
 fr AS (SELECT block_id, value, count(*) AS n, max(acos(greatest(-1, least(1, list_inner_product(vec, centroid))))) AS radius, max(ts) AS max_ts, any_value(centroid) AS centroid FROM f JOIN c USING (block_id, value) GROUP BY ALL)"""


def _facets(spark, sf):
    return summary.facets(units(spark, sf).withColumn("block_id", F.col("label")), ["block_id"], ["lang"], _dimensions(sf, spark)).drop("facet", "kind")


@query(f"WITH {FACETS} SELECT block_id, value, n, round(radius, 6) AS radius, round(max_ts, 3) AS max_ts FROM fr")
def facet_summary(spark, sf):
    return _facets(spark, sf).select("block_id", "value", "n", F.round("radius", 6).alias("radius"), F.round("max_ts", 3).alias("max_ts"))


ROLL = f"""{RAD}, w AS (SELECT block_id % 3 AS parent, i, sum(x * n) AS x FROM (SELECT block_id, n, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM c JOIN r USING (block_id)) GROUP BY ALL),
 wl AS (SELECT parent, list(x ORDER BY i) AS m FROM w GROUP BY parent), pc AS (SELECT parent, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) AS pcentroid FROM wl)"""


@query(f"WITH {ROLL} SELECT parent, sum(n)::BIGINT AS n, round(least(pi(), max(acos(greatest(-1, least(1, list_inner_product(centroid, pcentroid)))) + radius)), 6) AS radius FROM c JOIN r USING (block_id) JOIN pc ON parent = block_id % 3 GROUP BY parent")
def merge_rollup(spark, sf):
    children = _summaries(spark, sf).withColumn("parent", F.col("block_id") % 3)
    return summary.merge_dense(children, ["parent"], _dimensions(sf, spark)).select("parent", "n", F.round("radius", 6).alias("radius"))


MERGED = f"""{U}, z AS (SELECT label % 3 AS parent, count(*) AS n, min(n_chars) AS lo_n_chars, max(value) AS hi_value, max(ts) AS max_ts, count(*) FILTER (quality IS NULL) AS nulls_quality, list_sort(list(DISTINCT lang)) AS set_lang FROM u GROUP BY ALL)"""


@query(f"WITH {MERGED} SELECT parent, n, lo_n_chars, round(hi_value, 6) AS hi_value, round(max_ts, 3) AS max_ts, nulls_quality, array_to_string(set_lang, ',') AS langs, 0::BIGINT AS terms_below FROM z")
def merge_summary(spark, sf):
    """Blocks' whole summaries merged, beside what the rows give; terms_below counts merged term maxima below the rows' own."""
    u, d = units(spark, sf).withColumn("block_id", F.col("label")), _dimensions(sf, spark)
    e = u.select("block_id", "vec")
    dense = summary.radii(e, summary.centroids(e, ["block_id"], d), ["block_id"])
    t = terms(u, ["block_id"])
    children = dense.join(summary.zone_maps(u, ["block_id"], ["n_chars", "value", "quality"], ["lang"]).drop("n"), "block_id").join(summary.sparse_summary(t, ["block_id"], LAM), "block_id")
    m = summary.merge(children.withColumn("parent", F.col("block_id") % 3), ["parent"], d, LAM)
    own = t.groupBy((F.col("block_id") % 3).alias("parent"), "term").agg(F.max("w").alias("w"))
    below = own.join(m.select("parent", "kept", "residual"), "parent").groupBy("parent").agg(F.count(F.when(F.coalesce(F.try_element_at("kept", F.col("term")), F.col("residual")) < F.col("w") - 1e-9, 1)).alias("terms_below"))
    out = m.join(below, "parent")
    return out.select("parent", "n", "lo_n_chars", F.round("hi_value", 6).alias("hi_value"), F.round("max_ts", 3).alias("max_ts"), F.col("nulls_quality").cast("long").alias("nulls_quality"), F.array_join("set_lang", ",").alias("langs"), "terms_below")


@query(f"WITH {U}, b AS (SELECT source, label, count(*) AS n FROM u GROUP BY ALL) SELECT count(*) AS leaves, sum(n)::BIGINT AS rows, 1::BIGINT AS roots, 0::BIGINT AS violations, 0::BIGINT AS missed FROM b")
def summary_tree(spark, sf):
    """The tree over blocks: one root of all rows, no child's bound above its parent's, and no block lost on the way down."""
    u, d = units(spark, sf).withColumn("block_id", F.concat_ws("-", "source", "label")), _dimensions(sf, spark)
    s = summary.summarize(u.select("block_id", "vec", "n_chars", "lang", "ts"), ["block_id"], d, ["n_chars"], ["lang"])
    levels, bound = layout.build_tree(s, d, f"{_shared(spark)}/plumbline/tree-{uuid.uuid4().hex}", fanout=4), summary.dense_bound(probe(spark, sf))
    own = [x.select("parent", bound.alias("ub")) if "parent" in x.columns else None for x in levels]
    over = 0
    for children, parents in zip(own, levels[1:]):
        over += children.join(parents.select(F.col("node").alias("parent"), bound.alias("most")), "parent").where("ub > most + 1e-9").count()
    least = levels[0].select(bound.alias("ub")).agg(F.percentile("ub", 0.8)).first()[0]
    missed = levels[0].select("node", bound.alias("ub")).where(F.col("ub") > least).join(layout.descend(levels, bound, least), "node", "left_anti").count()
    root = levels[-1].agg(F.count(F.lit(1)), F.sum("n")).first()
    return spark.createDataFrame([(levels[0].count(), root[1], root[0], over, missed)], "leaves long, rows long, roots long, violations long, missed long")


@query(f"WITH {U} SELECT lang, count(*) AS n, 1::BIGINT AS langs FROM u GROUP BY lang")
def partition_layout(spark, sf):
    """The layout's blocks hold one value of the partitioning column each."""
    laid = layout.lay_out(units(spark, sf), 64, None, "lang")
    per_block = laid.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"), F.min("lang").alias("lang"))
    return per_block.groupBy("lang").agg(F.sum("n").alias("n"), F.max("langs").alias("langs"))


FILTERED = """b AS (SELECT lang AS block_id, ('0x' || substr(md5(term), 1, 15))::BIGINT AS id FROM t),
 p AS (SELECT block_id, (id % 2048 + i * (((id >> 11) % 2048) | 1)) % 2048 AS p FROM b CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)),
 w AS (SELECT block_id, (p // 64)::INT AS word, bit_or((1::UBIGINT << (p % 64)::UBIGINT)) AS bits FROM p GROUP BY ALL)"""


@query(f"WITH {U}, {T}, {FILTERED} SELECT block_id, word, bit_count(bits)::INT AS ones FROM w")
def term_filter(spark, sf):
    u = units(spark, sf).withColumn("block_id", F.col("lang"))
    ids = terms(u, ["block_id"]).select("block_id", "term").distinct().select("block_id", summary.term_id(F.col("term")).alias("term_id"))
    return summary.term_filter(ids, ["block_id"]).select("block_id", "word", F.bit_count("bits").alias("ones"))


@query(f"WITH {U}, {T}, {FILTERED} SELECT block_id, round(sum(bit_count(bits)) / 2048.0, 6) AS saturation FROM w GROUP BY block_id")
def filter_saturation(spark, sf):
    return _sparse_summaries(spark, sf, True).select("block_id", F.round(summary.saturation(F.col("words")), 6).alias("saturation"))


# --- bounds

UBD = f"(cos(greatest(0, acos(greatest(-1, least(1, list_inner_product(centroid, q.q)))) - radius)) + {summary.LENGTH_SLACK:.1e})"


@query(f"WITH {RAD}, {Q} SELECT block_id, round({UBD}, 6) AS ub FROM c JOIN r USING (block_id) CROSS JOIN q")
def bound_dense(spark, sf):
    return _summaries(spark, sf).select("block_id", F.round(summary.dense_bound(probe(spark, sf)), 6).alias("ub"))


UBS = f"""{MAXIMA}, {QT}, nm AS (SELECT block_id, max(nn) AS max_norm FROM (SELECT lang AS block_id, row_id, sqrt(sum(w * w)) AS nn FROM t GROUP BY ALL) GROUP BY block_id),
 k AS (SELECT block_id, sum(CASE WHEN rank <= {LAM} AND qw IS NOT NULL THEN w * qw ELSE 0 END) AS held, sum(CASE WHEN rank <= {LAM} AND qw IS NOT NULL THEN qw ELSE 0 END) AS covered, coalesce(max(CASE WHEN rank > {LAM} THEN w END), 0) AS residual FROM (SELECT * FROM rk WHERE rank <= {LAM + 1}) LEFT JOIN qt USING (term) GROUP BY block_id),
 sb AS (SELECT block_id, least(held + residual * greatest(0, (SELECT sum(qw) FROM qt) - covered), (SELECT sqrt(sum(qw * qw)) FROM qt) * max_norm) AS sparse_ub FROM k JOIN nm USING (block_id))"""


def _sparse_summaries(spark, sf, filtered):
    return summary.sparse_summary(terms(units(spark, sf).withColumn("block_id", F.col("lang")), ["block_id"]), ["block_id"], LAM, filtered)


def _sparse_bounds(spark, sf):
    return _sparse_summaries(spark, sf, False).select("block_id", summary.sparse_bound(ScoreSpec(None, TERMS, 0.0, 1.0), False).alias("sparse_ub"))


@query(f"WITH {U}, {UBS} SELECT block_id, round(sparse_ub, 6) AS ub FROM sb")
def bound_sparse(spark, sf):
    return _sparse_bounds(spark, sf).select("block_id", F.round("sparse_ub", 6).alias("ub"))


#: Terms that blocks of small size mostly do not hold, beside one that all do.
RARE = {"the": 0.5, "password": 1.0, "licensed": 0.7, "aulich": 0.4, "nowhere": 2.0}
SMALL = T.replace("label, lang, term", "block_id, term").replace("label, lang, unnest", "source || '-' || label AS block_id, unnest")
UBR = f"""{SMALL}, qt(term, qw) AS (VALUES {", ".join(f"('{t}', {w}::DOUBLE)" for t, w in RARE.items())}),
 tm AS (SELECT block_id, term, max(w) AS w FROM t GROUP BY ALL), rk AS (SELECT block_id, term, w, row_number() OVER (PARTITION BY block_id ORDER BY round(w, 9) DESC, term) AS rank FROM tm),
 {FILTERED.replace("SELECT lang AS block_id", "SELECT DISTINCT block_id")},
 qp AS (SELECT DISTINCT term, ((id % 2048 + i * (((id >> 11) % 2048) | 1)) % 2048) AS p FROM (SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS id FROM qt) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)),
 bp AS (SELECT DISTINCT block_id, p FROM p),
 need AS (SELECT term, count(*) AS c FROM qp GROUP BY term), hit AS (SELECT block_id, term, count(*) = any_value(c) AS maybe FROM bp JOIN qp USING (p) JOIN need USING (term) GROUP BY block_id, term),
 nm AS (SELECT block_id, max(nn) AS max_norm FROM (SELECT block_id, row_id, sqrt(sum(w * w)) AS nn FROM t GROUP BY ALL) GROUP BY block_id),
 res AS (SELECT block_id, coalesce(max(w) FILTER (rank > {LAM}), 0) AS residual FROM rk WHERE rank <= {LAM + 1} GROUP BY block_id),
 each AS (SELECT res.block_id, qw * CASE WHEN rk.w IS NOT NULL THEN rk.w WHEN coalesce(hit.maybe, false) THEN residual ELSE 0 END AS part FROM res CROSS JOIN qt LEFT JOIN rk ON rk.block_id = res.block_id AND rk.term = qt.term AND rank <= {LAM} LEFT JOIN hit ON hit.block_id = res.block_id AND hit.term = qt.term)"""


@query(f"WITH {U}, {UBR} SELECT block_id, round(least(s, nq * mn), 6) AS ub FROM (SELECT block_id, sum(part) AS s, any_value(max_norm) AS mn FROM each JOIN nm USING (block_id) GROUP BY block_id) CROSS JOIN (SELECT sqrt(sum(qw * qw)) AS nq FROM qt)")
def bound_sparse_filtered(spark, sf):
    """The bound with the term filter: a residual counts only for terms that the filter may hold."""
    u = units(spark, sf).withColumn("block_id", F.concat_ws("-", "source", "label"))
    s = summary.sparse_summary(terms(u, ["block_id"]), ["block_id"], LAM)
    return s.select("block_id", F.round(summary.sparse_bound(ScoreSpec(None, RARE, 0.0, 1.0)), 6).alias("ub"))


LANGS = f"""g AS (SELECT lang AS block_id, vec, ts FROM u), m AS (SELECT block_id, i, avg(x) AS x FROM (SELECT block_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM g) GROUP BY ALL), ml AS (SELECT block_id, list(x ORDER BY i) AS m FROM m GROUP BY block_id),
 c AS (SELECT block_id, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) AS centroid FROM ml), r AS (SELECT block_id, max(acos(greatest(-1, least(1, list_inner_product(vec, centroid))))) AS radius, max(ts) AS max_ts FROM g JOIN c USING (block_id) GROUP BY block_id)"""
UBF = f"0.6 * {UBD} + 0.3 * sparse_ub + 0.2 * power(0.5, greatest(0, {NOW} - max_ts) / 2592000)"


def _fused_bounds(spark, sf):
    u = units(spark, sf).withColumn("block_id", F.col("lang"))
    dense = summary.radii(u, summary.centroids(u, ["block_id"], _dimensions(sf, spark)), ["block_id"])
    newest = u.groupBy("block_id").agg(F.max("ts").alias("max_ts"))
    spec = probe(spark, sf, sparse=TERMS, alpha=0.6, beta=0.3, gamma=0.2)
    return dense.join(newest, "block_id").join(_sparse_bounds(spark, sf), "block_id").select("block_id", summary.fused_bound(spec).alias("ub"))


@query(f"WITH {U}, {Q}, {UBS}, {LANGS} SELECT block_id, round({UBF}, 6) AS ub FROM c JOIN r USING (block_id) JOIN sb USING (block_id) CROSS JOIN q")
def bound_fused(spark, sf):
    return _fused_bounds(spark, sf).select("block_id", F.round("ub", 6).alias("ub"))


@query(f"WITH {U} SELECT lang AS block_id, count(*) AS n, 0::BIGINT AS violations FROM u GROUP BY lang")
def bound_violations(spark, sf):
    """Units that score above their block's bound; there are none."""
    spec = probe(spark, sf, sparse=TERMS, alpha=0.6, beta=0.3, gamma=0.2)
    u = units(spark, sf).withColumn("block_id", F.col("lang"))
    per_row = terms(u, only=list(TERMS)).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("terms"))
    scored = search.scored(u.select("row_id", "block_id", "vec", "ts").join(per_row, "row_id", "left"), spec)
    return scored.join(_fused_bounds(spark, sf), "block_id").groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("score") > F.col("ub"), 1)).alias("violations"))


@query(f"WITH {FACETS}, {Q} SELECT block_id, round({UBD}, 6) AS ub FROM fr CROSS JOIN q WHERE value = 'de'")
def bound_facet(spark, sf):
    return _facets(spark, sf).where("value = 'de'").select("block_id", F.round(summary.dense_bound(probe(spark, sf)), 6).alias("ub"))


V_RANGE = "CASE WHEN hi_n_chars < 500 OR lo_n_chars > 4000 THEN 0 WHEN lo_n_chars >= 500 AND hi_n_chars <= 4000 THEN 2 ELSE 1 END"
V_IN = "CASE WHEN NOT list_has_any(set_lang, ['de', 'fr']) THEN 0 WHEN len(list_filter(set_lang, lambda x: x NOT IN ('de', 'fr'))) = 0 THEN 2 ELSE 1 END"
P_RANGE, P_IN = Range("n_chars", 500, 4000), InSet("lang", frozenset({"de", "fr"}))


def _verdicts(*predicates):
    def run(spark, sf):
        # blocks of one source and label: small enough for all three verdicts
        u = units(spark, sf).withColumn("block_id", F.concat_ws("-", "source", "label"))
        z = summary.zone_maps(u, ["block_id"], ["n_chars"], ["lang"])
        return z.select("block_id", verdict(predicates, set(z.columns)).alias("verdict"))

    return run


for _name, _predicates, _verdict in (("tristate_range", [P_RANGE], V_RANGE), ("tristate_in", [P_IN], V_IN), ("tristate_conj", [P_RANGE, P_IN], f"least({V_RANGE}, {V_IN})")):
    REGISTRY[_name] = _verdicts(*_predicates)
    SQL[_name] = f"WITH {U}, z AS (SELECT source || '-' || label AS block_id, min(n_chars) AS lo_n_chars, max(n_chars) AS hi_n_chars, list(DISTINCT lang) AS set_lang FROM u GROUP BY ALL) SELECT block_id, {_verdict} AS verdict FROM z"


# --- search


def _blocked(spark, sf):
    u = units(spark, sf).withColumn("block_id", F.col("label").cast("string"))
    e = u.select("block_id", "vec")
    s = summary.radii(e, summary.centroids(e, ["block_id"], _dimensions(sf, spark)), ["block_id"]).join(summary.zone_maps(u, ["block_id"], ["n_chars"], ["lang"]).drop("n"), "block_id")
    return u, s


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("row_id", F.round("score", 6).alias("score"))


@query(top_sql(DENSE, "u.n_chars >= 500"))
def topk_pruned(spark, sf):
    u, s = _blocked(spark, sf)
    spec, p = probe(spark, sf), [Range("n_chars", 500)]
    return _rounded(search.pruned_top_k(u, search.bounds(s, spec, p), spec, K, p).hits)


@query(f"WITH x AS ({top_sql(DENSE)}) SELECT row_number() OVER (ORDER BY score DESC, row_id) AS rank, score AS best, true AS within FROM x")
def topk_epsilon(spark, sf):
    """Each rank's true score, and whether the answer to a factor of 1.2 comes that close."""
    u, s = _blocked(spark, sf)
    spec = probe(spark, sf)
    hits = search.pruned_top_k(u, search.bounds(s, spec), spec, K, epsilon=0.2).hits
    ranked = lambda df, c: df.select(F.row_number().over(Window.orderBy(F.desc("score"), "row_id")).cast("long").alias("rank"), F.round("score", 6).alias(c))
    # both sides are K rows
    return ranked(search.top_k(u, spec, K, digits=6), "best").join(ranked(hits, "found"), "rank", "left").select("rank", "best", F.coalesce(F.col("found") * 1.2 + 1e-6 >= F.col("best"), F.lit(False)).alias("within"))


BEST = f"ub AS (SELECT label AS block_id, n, round({UBD}, 9) AS ub FROM (SELECT block_id AS label, centroid FROM c) JOIN (SELECT block_id AS label, n, radius FROM r) USING (label) CROSS JOIN q), best AS (SELECT block_id, n, ub, row_number() OVER (ORDER BY ub DESC, block_id::VARCHAR) AS rank FROM ub)"
LABELS = LANGS.replace("lang AS block_id", "label AS block_id").replace("max(ts) AS max_ts", "count(*) AS n")
OPENED = f"{U}, {Q}, {LABELS}, {BEST}"


@query(f"WITH {OPENED} SELECT u.row_id, round({DENSE}, 6) AS score FROM u JOIN best ON best.block_id = u.label CROSS JOIN q WHERE rank <= 3 ORDER BY score DESC, row_id LIMIT {K}")
def topk_blocks(spark, sf):
    u, s = _blocked(spark, sf)
    spec = probe(spark, sf)
    return _rounded(search.pruned_top_k(u, search.bounds(s, spec), spec, K, block_budget=3).hits)


@query(f"WITH {OPENED}, h AS (SELECT {DENSE} AS score FROM u JOIN best ON best.block_id = u.label CROSS JOIN q WHERE rank <= 3 ORDER BY score DESC LIMIT {K}) SELECT round(min(score), 6) AS kth_score, round((SELECT ub FROM best WHERE rank = 4), 6) AS max_remaining_bound, (SELECT ub FROM best WHERE rank = 4) <= min(score) AS exact, round(greatest(1, (SELECT ub FROM best WHERE rank = 4) / min(score)), 6) AS ratio FROM h")
def certificate(spark, sf):
    u, s = _blocked(spark, sf)
    spec = probe(spark, sf)
    c = search.pruned_top_k(u, search.bounds(s, spec), spec, K, block_budget=3).certificate
    return search.certificate_frame(spark, c).select(F.round("kth_score", 6).alias("kth_score"), F.round("max_remaining_bound", 6).alias("max_remaining_bound"), "exact", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {OPENED} SELECT count(*) AS blocks_total, 3::BIGINT AS blocks_opened, sum(n)::BIGINT AS rows_total, (sum(n) FILTER (rank <= 3))::BIGINT AS rows_scored FROM best")
def search_stats(spark, sf):
    u, s = _blocked(spark, sf)
    spec = probe(spark, sf)
    x = search.pruned_top_k(u, search.bounds(s, spec), spec, K, block_budget=3).stats
    return spark.createDataFrame([(x.blocks_total, x.blocks_opened, x.rows_total, x.rows_scored)], "blocks_total long, blocks_opened long, rows_total long, rows_scored long")


@query(top_sql(DENSE, "u.label IN (2, 5)"))
def block_scan_topk(spark, sf):
    u, _ = _blocked(spark, sf)
    return search.top_k(u.where(F.col("block_id").isin("2", "5")), probe(spark, sf), K, digits=6)


# --- the store


def _shared(spark) -> str:
    """The folder that driver and executors share; one of this machine only where Spark runs on it alone."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").rstrip("/")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base or f"file://{_local_folder()}"


def _store(spark, sf, **config) -> Store:
    return Store(spark, f"{_shared(spark)}/plumbline/store-{uuid.uuid4().hex}", Config(**{"block_size": 64, "max_radius": None, "memtable_rows": 10**9} | config))


@cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="plumbline-store-")
    atexit.register(shutil.rmtree, path, True)
    return path


_rows = units


def _parts(u: DataFrame, n: int) -> list[DataFrame]:
    return [u.where(F.col("row_id") % n == i) for i in range(n)]


@query(top_sql(DENSE))
def memtable_topk(spark, sf):
    store = _store(spark, sf)
    store.insert(_rows(spark, sf))
    return _rounded(store.search(probe(spark, sf), K).hits)


@query(top_sql(DENSE))
def topk_multisegment(spark, sf):
    store = _store(spark, sf, compact_threshold=9)
    for part in _parts(_rows(spark, sf), 3)[:2]:
        store.insert(part)
        store.flush()
    store.insert(_parts(_rows(spark, sf), 3)[2])
    return _rounded(store.search(probe(spark, sf), K).hits)


@query(f"WITH {U} SELECT count(*) AS rows, sum(row_id)::BIGINT AS ids FROM u")
def lsm_insert(spark, sf):
    store = _store(spark, sf)
    for part in _parts(_rows(spark, sf), 2):
        store.insert(part)
    return store.units().agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"))


@query(f"WITH {U} SELECT count(*) AS rows, sum(row_id)::BIGINT AS ids, 0::BIGINT AS waiting FROM u")
def lsm_flush(spark, sf):
    store = _store(spark, sf)
    store.insert(_rows(spark, sf))
    store.flush()
    return store.sealed().agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"), F.lit(store.state["memtable_rows"]).cast("long").alias("waiting"))


def _deleted(spark, sf) -> Store:
    store = _store(spark, sf, compact_threshold=9)
    first, second = _parts(_rows(spark, sf), 2)
    store.insert(first)
    store.flush()
    store.insert(second)
    store.delete(units(spark, sf).where("row_id % 7 = 0").select("row_id"))
    return store


@query(top_sql(DENSE, "u.row_id % 7 <> 0"))
def lsm_delete_topk(spark, sf):
    return _rounded(_deleted(spark, sf).search(probe(spark, sf), K).hits)


@query(top_sql(DENSE, "u.row_id % 7 <> 0"))
def lsm_compact_topk(spark, sf):
    store = _deleted(spark, sf)
    store.flush()
    store.compact()
    return _rounded(store.search(probe(spark, sf), K).hits)


@query(f"WITH {U} SELECT count(*) FILTER (row_id % 7 <> 0) AS rows, 1::BIGINT AS segments, count(*) FILTER (row_id % 7 <> 0 AND row_id % 2 = 1) AS memtable_rows FROM u")
def db_stats(spark, sf):
    return _deleted(spark, sf).stats().select("rows", "segments", "memtable_rows")


@query(f"WITH {U} SELECT count(*) + count(*) FILTER (row_id % 5 = 0) AS rows, count(DISTINCT row_id) AS ids, 1::BIGINT AS segments FROM u")
def lsm_repeated(spark, sf):
    """Rows inserted twice under one row_id are two rows, through flush and compaction."""
    store = _store(spark, sf, compact_threshold=9)
    store.insert(_rows(spark, sf))
    store.insert(_rows(spark, sf).where("row_id % 5 = 0"))
    store.flush()
    store.compact()
    return store.sealed().agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("ids"), F.lit(len(store.state["segments"])).cast("long").alias("segments"))


@query(top_sql(DENSE, "u.quality = 1 AND u.lang = 'de'"))
def topk_faceted(spark, sf):
    """Facets of a number that is a double in the store, asked for by a whole number, and of text."""
    store = _store(spark, sf, facet_columns=("quality", "lang"))
    store.insert(_rows(spark, sf).withColumn("quality", F.col("quality").cast("double")))
    store.flush()
    return _rounded(store.search(probe(spark, sf), K, [InSet("quality", frozenset({1})), InSet("lang", frozenset({"de"}))]).hits)


def _with_terms(spark, sf, **config) -> Store:
    """A store of the units with the weights of all their terms, flushed."""
    u = units(spark, sf)
    maps = terms(u).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("terms"))
    store = _store(spark, sf, lam=LAM, **config)
    store.insert(u.join(maps, "row_id", "left"))
    store.flush()
    return store


HYBRID = top_sql(f"0.7 * {DENSE} + 0.3 * coalesce(sp.s, 0)", "u.n_chars >= 300", more=f", {SP}", joins="LEFT JOIN sp USING (row_id)")


@query(HYBRID)
def store_hybrid(spark, sf):
    """Hybrid search through the store, its blocks bounded with the term filter."""
    return _rounded(_with_terms(spark, sf).search(probe(spark, sf, sparse=TERMS, alpha=0.7, beta=0.3), K, [Range("n_chars", 300)]).hits)


@query(HYBRID)
def store_execute(spark, sf):
    """The same as a statement, its sections in an order of their own."""
    vec = table(spark, sf, "embeddings").where(F.col("vec_id") == PROBE).first()["embedding"]
    statement = "NEAR :v MATCH :t FUSE dense 0.7, sparse 0.3 WHERE n_chars >= 300 SELECT TOP 10 GUARANTEE EXACT"
    return _rounded(_with_terms(spark, sf).execute(statement, {"v": vec, "t": TERMS}, NOW).hits)


@query(top_sql(DENSE, "u.n_chars >= 300"))
def store_quantized(spark, sf):
    """Codes first, exact scores of what may do after; the codes' error bound is taken from all of a sample here."""
    store = _store(spark, sf, quantize=True)
    store.insert(_rows(spark, sf))
    store.flush()
    return _rounded(store.search(probe(spark, sf), K, [Range("n_chars", 300)]).hits)


@query("SELECT 'a' AS part, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'b', s_suppkey, s_acctbal, NULL FROM supplier")
def union_batches(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("a").alias("part"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.lit("b").alias("part"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


# --- fetch and assembly

POOL, BUDGET = 24, 600
HITS = f"{U}, {Q}, h AS (SELECT u.*, round({DENSE}, 6) AS score FROM u CROSS JOIN q ORDER BY score DESC, row_id LIMIT {POOL})"


def _pool(spark, sf):
    u = units(spark, sf)
    hits = search.top_k(u, probe(spark, sf), POOL, digits=6)
    return u, search.fetch(hits, u, ["doc_id", "ordinal", "tokens", "vec", "lang", "text"])


@query(f"WITH {HITS} SELECT row_id, doc_id, ordinal, lang, tokens, score, md5(text) AS digest FROM h")
def topk_fetch(spark, sf):
    return _pool(spark, sf)[1].select("row_id", "doc_id", "ordinal", "lang", "tokens", "score", F.md5("text").alias("digest"))


@query(f"WITH {HITS} SELECT DISTINCT u.row_id, u.doc_id, u.ordinal FROM u JOIN h ON u.doc_id = h.doc_id AND abs(u.ordinal - h.ordinal) <= 1")
def neighbour_lookup(spark, sf):
    u, pool = _pool(spark, sf)
    return A.neighbours_of(pool, u).select("row_id", "doc_id", "ordinal")


SIM = "greatest(0, least(1, list_inner_product(a.vec, b.vec)))"


@query(f"WITH {HITS} SELECT a.row_id AS a, b.row_id AS b, round({SIM}, 6) AS sim FROM h a CROSS JOIN h b")
def pool_similarity(spark, sf):
    return A.pool_similarity(_pool(spark, sf)[1]).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"WITH {HITS} SELECT a.row_id AS a, b.row_id AS b, round({SIM}, 6) AS sim FROM h a JOIN h b ON a.row_id < b.row_id WHERE {SIM} > 0.98")
def near_dup_pairs(spark, sf):
    return A.near_duplicate_pairs(_pool(spark, sf)[1]).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"WITH {HITS}, s AS (SELECT a.row_id, a.score, max({SIM}) AS sim FROM h a CROSS JOIN (SELECT * FROM h ORDER BY score DESC, row_id LIMIT 5) b GROUP BY ALL) SELECT round(sum(sim * greatest(0, score)) / sum(greatest(0, score)), 6) AS coverage FROM s")
def coverage(spark, sf):
    pool = _pool(spark, sf)[1]
    chosen = pool.orderBy(F.desc("score"), "row_id").limit(5).select("row_id")
    return A.coverage(pool, chosen).select(F.round("coverage", 6).alias("coverage"))


@query("""WITH i AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations WHERE length(text) % 4 <> 0)
SELECT conv_id AS doc_id, min(turn) AS start_ordinal, max(turn) AS end_ordinal, count(*) AS units, sum(length(text))::BIGINT AS tokens, max(length(text)) AS score, string_agg((conv_id * 1000 + turn)::VARCHAR, ',' ORDER BY turn) AS row_ids, md5(string_agg(text, ' ' ORDER BY turn) FILTER (text <> '')) AS digest FROM i GROUP BY conv_id, island""")
def stitch_islands(spark, sf):
    c = table(spark, sf, "conversations").where(F.length("text") % 4 != 0)
    u = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.length("text").cast("long").alias("tokens"), F.length("text").cast("long").alias("score"), "text")
    return A.islands(u).select("doc_id", "start_ordinal", "end_ordinal", "units", "tokens", "score", "row_ids", F.md5("text").alias("digest"))


def _pack(spark, sf):
    u, pool = _pool(spark, sf)
    own = A.collect_units(pool)
    known = {(x.doc_id, x.ordinal): x for x in A.collect_units(A.neighbours_of(pool, u).withColumn("score", F.lit(0.0)))} | {(x.doc_id, x.ordinal): x for x in own}
    return own, A.assemble(own, BUDGET, 1, known)


#: The greedy choice as a recursion over its steps, and the filling of gaps as one over the chosen units in a row.
CHOICE = f"""{HITS}, c AS (SELECT row_number() OVER (ORDER BY score DESC, row_id) AS i, row_id, doc_id, ordinal, tokens, score, vec, coalesce(text, '') AS text FROM h),
 al AS (SELECT a.i, list(greatest(0, least(1, list_inner_product(a.vec, b.vec))) ORDER BY b.i) AS alike FROM c a CROSS JOIN c b GROUP BY a.i),
 p AS (SELECT c.*, alike FROM c JOIN al USING (i)), wl AS (SELECT list(greatest(0, score) ORDER BY i) AS w, count(*) AS n FROM c),
 g(step, i, gain, chosen, covered, spent) AS (
  SELECT 0, 0::BIGINT, 0::DOUBLE, []::BIGINT[], list_transform(range(n), lambda x: 0::DOUBLE), 0::BIGINT FROM wl
  UNION ALL
  SELECT step + 1, i, gain, list_append(chosen, i), after, spent FROM (SELECT *, row_number() OVER (ORDER BY gain / greatest(1, tokens) DESC, i) AS r FROM (
   SELECT g.step, p.i, p.tokens, g.chosen, g.spent + p.tokens AS spent, list_transform(range(1, n + 1), lambda j: greatest(p.alike[j], g.covered[j])) AS after,
    list_sum(list_transform(range(1, n + 1), lambda j: greatest(p.alike[j] - g.covered[j], 0) * w[j])) AS gain
   FROM g JOIN p ON NOT list_contains(g.chosen, p.i) AND g.spent + p.tokens <= {BUDGET} CROSS JOIN wl) WHERE gain > 1e-6) WHERE r = 1),
 last AS (SELECT * FROM g ORDER BY step DESC LIMIT 1)"""
SPANS = f"""{CHOICE}, picked AS (SELECT p.*, step, min(step) OVER (PARTITION BY doc_id) AS first FROM g JOIN p USING (i) WHERE step > 0),
 row AS (SELECT *, row_number() OVER (ORDER BY first, ordinal) AS k, lead(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) - ordinal AS gap FROM picked),
 known AS (SELECT DISTINCT u.row_id, u.doc_id, u.ordinal, u.tokens, coalesce(u.text, '') AS text, coalesce(c.score, 0) AS score FROM u JOIN h ON u.doc_id = h.doc_id AND abs(u.ordinal - h.ordinal) <= 1 LEFT JOIN c ON c.row_id = u.row_id),
 gap AS (SELECT k, CASE WHEN gap = 1 THEN 0 ELSE f.tokens END AS price, f.row_id, f.ordinal, f.tokens, f.text, f.score FROM row LEFT JOIN known f ON gap = 2 AND f.doc_id = row.doc_id AND f.ordinal = row.ordinal + 1),
 fill(k, slack, filled) AS (SELECT 0::BIGINT, {BUDGET} - spent, true FROM last UNION ALL SELECT gap.k, slack - CASE WHEN price <= slack THEN price ELSE 0 END, coalesce(price <= slack, false) FROM fill JOIN gap ON gap.k = fill.k + 1),
 member AS (SELECT k, row_id, ordinal, tokens, text, score, 0 AS bridged FROM row UNION ALL SELECT k, row_id, ordinal, tokens, text, score, 1 FROM gap JOIN fill USING (k) WHERE filled AND row_id IS NOT NULL),
 island AS (SELECT k, count(*) FILTER (NOT filled) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM fill),
 span AS (SELECT island, any_value(row.doc_id) AS doc_id, min(m.ordinal) AS start_ordinal, max(m.ordinal) AS end_ordinal, sum(m.tokens)::BIGINT AS tokens, string_agg(m.row_id::VARCHAR, ',' ORDER BY m.ordinal) AS row_ids, max(m.score) AS score,
  sum(m.bridged)::INT AS bridged, coalesce(string_agg(m.text, ' ' ORDER BY m.ordinal) FILTER (m.text <> ''), '') AS text FROM member m JOIN island USING (k) JOIN row USING (k) GROUP BY island)"""


@query(f"WITH RECURSIVE {CHOICE} SELECT (step - 1)::INT AS step, row_id, tokens, score FROM g JOIN p USING (i) WHERE step > 0")
def context_select(spark, sf):
    own, pack = _pack(spark, sf)
    return spark.createDataFrame([(n, own[i].row_id, own[i].tokens, own[i].score) for n, i in enumerate(pack.chosen)], "step int, row_id long, tokens long, score double")


def _spans(spark, pack) -> DataFrame:
    rows = [(s.doc_id, s.start_ordinal, s.end_ordinal, s.tokens, ",".join(map(str, s.row_ids)), s.score, s.bridged) for s in pack.spans]
    return spark.createDataFrame(rows, "doc_id long, start_ordinal int, end_ordinal int, tokens long, row_ids string, score double, bridged int")


SPAN = "doc_id, start_ordinal, end_ordinal, tokens, row_ids, score, bridged"


@query(f"WITH RECURSIVE {SPANS} SELECT {SPAN} FROM span")
def context_spans(spark, sf):
    return _spans(spark, _pack(spark, sf)[1])


@query(f"""WITH RECURSIVE {SPANS} SELECT string_agg('[doc ' || doc_id || ' units ' || start_ordinal || '-' || end_ordinal || ' (' || tokens || ' tok, score ' || printf('%.3f', score) || ')]' || chr(10) || text, chr(10) || chr(10) ORDER BY score DESC, island) AS context,
 sum(tokens)::BIGINT AS tokens, round((SELECT list_sum(list_transform(range(1, n + 1), lambda j: covered[j] * w[j])) / list_sum(w) FROM last CROSS JOIN wl), 6) AS coverage, round((SELECT sum(gain) FROM g), 6) AS utility FROM span""")
def context_render(spark, sf):
    _, pack = _pack(spark, sf)
    return spark.createDataFrame([(pack.render(), pack.tokens, round(pack.coverage, 6), round(pack.utility, 6))], "context string, tokens long, coverage double, utility double")


@query(f"WITH RECURSIVE {SPANS} SELECT {SPAN} FROM span")
def store_context(spark, sf):
    """The same pack by a statement through the store, whose search keeps scores unrounded."""
    store = _store(spark, sf)
    store.insert(_rows(spark, sf))
    store.flush()
    vec = table(spark, sf, "embeddings").where(F.col("vec_id") == PROBE).first()["embedding"]
    result = store.context(parse("SELECT CONTEXT NEAR :v").bind({"v": vec}, NOW), BUDGET, POOL)
    return _spans(spark, result.context).withColumn("score", F.round("score", 6))


# --- layout, codes, lists


@query(f"WITH {U} SELECT count(*) AS rows, count(DISTINCT row_id) AS ids, true AS small FROM u")
def seg_blocks(spark, sf):
    laid = layout.lay_out(units(spark, sf), 64, 0.7)
    per = laid.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"))
    return per.agg(F.sum("n").alias("rows"), F.sum("ids").alias("ids"), (F.max("n") <= 64).alias("small"))


def _turn_sql(d: int = 64, seed: int = 0) -> str:
    return ", ".join(f"({i}, {j}, {x!r})" for i, row in enumerate(rotation(d, seed).tolist(), 1) for j, x in enumerate(row, 1))


ENCODED = f"""{E}, turn(i, j, x) AS (VALUES {_turn_sql()}), v AS (SELECT row_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM e),
 y AS (SELECT row_id, j, sum(v.x * turn.x) AS y FROM v JOIN turn USING (i) GROUP BY ALL)"""


@query(f"WITH {ENCODED} SELECT row_id, string_agg(CASE WHEN y >= 0 THEN '1' ELSE '0' END, '' ORDER BY j) AS code, round((1 / sum(abs(y)))::FLOAT::DOUBLE, 5) AS scale FROM y GROUP BY row_id")
def quant_encode(spark, sf):
    coded = Quantizer(_dimensions(sf, spark), 0.0).with_codes(_vectors(spark, sf))
    bits = F.concat(*[F.lpad(F.conv(F.hex(F.substring("_code", i + 1, 1)), 16, 2), 8, "0") for i in range(_dimensions(sf, spark) // 8)])
    return coded.select("row_id", bits.alias("code"), F.round(F.col("_scale").cast("double"), 5).alias("scale"))


@query(f"WITH {E}, {Q} SELECT row_id, round(list_inner_product(vec, q.q), 6) AS score FROM e CROSS JOIN q ORDER BY score DESC, row_id LIMIT {K}")
def quant_topk(spark, sf):
    e = _vectors(spark, sf)
    z = Quantizer.fit(e, quantile=1.0)
    return z.top_k(z.with_codes(e), probe(spark, sf), K, digits=6)


@query(f"WITH {RAD}, {Q}, near AS (SELECT block_id FROM c CROSS JOIN q ORDER BY round(list_inner_product(centroid, q.q), 9) DESC, block_id LIMIT 3) SELECT row_id, round(list_inner_product(vec, q.q), 6) AS score FROM e JOIN near USING (block_id) CROSS JOIN q ORDER BY score DESC, row_id LIMIT {K}")
def ivf_topk(spark, sf):
    return search.ivf_top_k(_vectors(spark, sf), _summaries(spark, sf), probe(spark, sf), 3, K, digits=6)


#: Every how many rows one is a query of the batched search, and queries of a block of them.
EVERY, BLOCK = 50, 2000


@query(f"""WITH {E}, p AS (SELECT row_id AS query, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS q FROM e WHERE row_id % {EVERY} = 0),
 s AS (SELECT query, row_id, round(list_inner_product(vec, q), 6) AS score FROM e CROSS JOIN p) SELECT query, row_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, row_id) <= {K}""")
def topk_batch(spark, sf):
    """Every row whose id is divisible by EVERY against all rows, in blocks of BLOCK queries."""
    e = _vectors(spark, sf)
    asked = e.where(F.col("row_id") % EVERY == 0)
    return search.batch_over(e, asked, K, BLOCK)


@query(f"WITH {U} SELECT count(*) AS rows, sum(row_id)::BIGINT AS ids FROM u")
def stream_ingest(spark, sf):
    """The same units by way of a stream of files into a store."""
    from .streaming.ingest import ingest

    store = _store(spark, sf)
    source = f"{store.path}-source"
    _rows(spark, sf).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 4).parquet(source)
    ingest(stream, store, f"{store.path}-progress").awaitTermination()
    return store.units().agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

