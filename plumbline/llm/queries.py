"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(_table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op4_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live or copied for every candidate.  op4_secrets, whose columns its SQL fixes, judges whole runs alone."""
    from .secrets import verdicts

    return verdicts(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identified

    return identified(_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, scored

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import groups

    return groups(_table(spark, sf_dir, "documents"))


#: White space runs as DuckDB's RE2 writes them.
OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_packing, op3_media, op4_secrets, op4_verdicts, op5_language, op6_html, op7_simhash, op8_licences, op9_quality, op10_exact)}


def oracle_sql() -> dict[str, str]:
    from . import licences, secrets

    return {"op4_secrets": secrets.scan_sql(), "op8_licences": licences.scan_sql(), "op10_exact": OP10_SQL}
