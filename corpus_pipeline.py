"""A cleaning pipeline over documents: each stage calls one operator, and reads what the one before it wrote.

Defined results, for every stage: null text counts as empty; rows with a null doc_id are rows like any other and sort
after all others where one of a group stays; extra columns, whatever their names, pass through all stages but the last;
empty tables give empty tables of the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact, packing, quality, secrets, simhash
from plumbline.llm.common import drop_path, new_path, scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Without labels of both classes all share one score: all stay, or none."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, white space aside, the one with the smallest doc_id stays."""
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints of five-word shingles link, the one with the smallest doc_id stays."""
    return simhash.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; live-looking credentials of all kinds in it are blanked.

    Owners are counted over all documents as they came in: the copies that the stages before took away are what tells a
    published example from a credential.  A table without `source` counts as one repository."""
    return secrets.cleaned(docs, corpus=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: A trained classifier and greedy packing have no SQL form; tests/llm/test_pipeline.py holds it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again.

    A stage's input and the tables that it made on the way are removed once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
