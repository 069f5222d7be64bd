"""Operator 10, exact deduplication.

Rows are grouped by a 128-bit hash of the normalised text; within groups of two and more the texts' bytes are compared
(Spark groups them by hash and text), so a collision of the hash parts its texts again.  Of equal texts the row with
the smallest doc_id stays.  Whole texts are shuffled only where their hash may occur twice; all else is small rows.
Groups shrink before each shuffle (partial aggregation), so a third of all rows may be copies of one text.

Defined results: null text counts as empty, runs of ASCII white space as one space.  A null doc_id sorts after all
others (keep_id is null only where all ids of the group are).  Of repeated rows with one doc_id and text exactly one is
kept.  Extra columns are ignored by `groups` and kept by `deduplicated`; an empty table gives an empty table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, empty_if_null, in_buckets, in_files, stored, tie

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits, as binary."""
    return F.unhex(F.md5(text))


def _repeated(keys: DataFrame) -> DataFrame:
    """The hashes that two or more rows have."""
    return keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def _order(doc_id: str = "doc_id") -> list[Column]:
    return [F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id")]


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row.  hash_of is replaced in tests of collisions."""
    texts = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), normalised(empty_if_null(text)).alias("norm"))
    texts = texts.select("doc_id", "norm", hash_of(F.col("norm")).alias("h"))
    rows = stored(texts.select(F.monotonically_increasing_id().alias("serial"), "doc_id", "h", F.sha2("norm", 256).alias("text_sha256")), "digests")
    first = F.min(F.struct(*_order(), F.col("serial"))).alias("first")
    by_hash = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), first), "groups")
    # byte comparison, of the texts whose hash occurs more than once
    maybe, _ = in_buckets(texts, F.col("h"), by_hash.where("group_size > 1").select("h"))
    collided = stored(maybe.groupBy("h", "norm").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("texts")).where("texts > 1").select("h"), "collisions")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if collided.isEmpty():
        return _decided(rows, by_hash, ["h"]).select(columns)
    alone = _decided(rows.join(collided, "h", "left_anti"), by_hash.join(collided, "h", "left_anti"), ["h"])
    parted = stored(texts.join(collided, "h", "left_semi").withColumn("serial", F.monotonically_increasing_id()).withColumn("text_sha256", F.sha2("norm", 256)), "collided")
    by_text = parted.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), first)
    return alone.select(columns).unionByName(_decided(parted, by_text, ["h", "norm"]).select(columns))


def _decided(rows: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(classes, key).withColumn("keep_id", F.col("first.id")).withColumn("kept", F.col("serial") == F.col("first.serial"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """docs without all but one of the rows of equal text, with all its columns.

    Rows whose hash occurs once pass without a shuffle; the others are grouped by hash and bytes, and the least row
    (by doc_id) of each group comes out whole.  Of rows with one doc_id the least hash of text, then of all columns, stays."""
    row = F.struct("*")
    norm = normalised(empty_if_null(text))
    tagged = docs.select(row.alias("row"), docs[f"`{doc_id}`"].cast("long").alias("doc_id"), norm.alias("norm")).withColumn("h", hash_of(F.col("norm")))
    repeated = stored(in_files(_repeated(tagged.select("h")), docs.count()), "repeated")
    maybe, once = in_buckets(tagged, F.col("h"), repeated)
    least = maybe.groupBy("h", "norm").agg(F.min_by("row", F.struct(*_order(), F.xxhash64(F.col(f"row.`{text}`")).alias("text"), tie(docs, "row.").alias("tie"))).alias("row"))
    return once.select("row.*").unionByName(in_files(least.select("row.*"), repeated.count(), TEXT_ROWS))
