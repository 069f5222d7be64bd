"""What the operators of this subpackage share: the shared folder, tables that cut lineage, and shipping the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of an Arrow batch sent to Python.  Texts average a few KB, so a batch stays at a few MB.
ARROW_ROWS = 1000

#: Buckets of the prefilters below, a bit each in pages of 4 KB: SPARE for each key, at least the least and at most the most
#: (2^28 bits are 8192 pages, 32 MB); and the passes over ranges of the hash beyond one such broadcast.
SPARE, LEAST_BUCKETS, MOST_BUCKETS, PAGE, PASSES = 16, 1 << 20, 1 << 28, 1 << 15, 4

#: Small rows, or rows with texts, of a file that a shuffle ends in, and files that a table may have in any case.
SMALL_ROWS, TEXT_ROWS, LEAST_FILES = 50_000, 2000, 24

_own: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Ships the package to the Python workers and bounds their Arrow batches."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _temporary(kind: str) -> str:
    if kind not in _own:
        _own[kind] = tempfile.mkdtemp(prefix=f"plumbline-{kind}-")
        atexit.register(shutil.rmtree, _own[kind], True)
    return _own[kind]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where that is unset and Spark runs on this machine alone, as in tests, a folder of this machine is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{_temporary('shared')}"


_made: list[list[str]] = []


def new_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/plumbline/{kind}-{uuid.uuid4().hex}"
    for paths in _made:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Removes the tables and files that operators make within it.  Their results must be written elsewhere by then."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield
    finally:
        _made.remove(paths)
        for path in paths:
            drop_path(spark, path)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_files(df: DataFrame, rows: int, each: int = SMALL_ROWS) -> DataFrame:
    """df, which ends in a shuffle of some `rows` rows, in as many files as these need rather than one a partition.

    On a local folder without Hadoop's native library each file costs several processes (chmod), started from the
    executor; while one starts it shares the executor's memory, which whoever sums up memory by process counts twice."""
    return df.coalesce(max(LEAST_FILES, -(-rows // each)))


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _pass(df: DataFrame, key: Column, keys: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    bucket = lambda k: F.pmod(F.xxhash64(k), F.lit(buckets))
    own = keys.select(bucket(F.col(f"`{keys.columns[0]}`")).alias("_bucket"))
    own = own.select(F.shiftright("_bucket", 15).alias("_page"), F.pmod("_bucket", F.lit(PAGE)).alias("_place"))
    # all pages, so that the join always finds one
    every = df.sparkSession.range(-(-buckets // PAGE)).select(F.col("id").alias("_page"), F.lit(None).cast("long").alias("_place"))
    own = own.unionByName(every)
    # dealt by page as plain numbers first: a partial bitmap in each task would send 4 KB a page and task
    pages = F.broadcast(own.repartition("_page").groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits")))
    tagged = df.withColumn("_bucket", bucket(key))
    place = F.pmod("_bucket", F.lit(PAGE))
    byte = F.conv(F.hex(F.substring(pages["_bits"], (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)).cast("int"))) != 0
    among = (F.shiftright(tagged["_bucket"], 15) == pages["_page"]) & bit
    return tagged.join(pages, among, "left_semi").drop("_bucket"), tagged.join(pages, among, "left_anti").drop("_bucket")


def in_buckets(df: DataFrame, key: Column, keys: DataFrame, most: int = MOST_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Splits df into rows whose key may be among `keys` (one column, stored) and rows whose key surely is not.

    A bitmap is broadcast, sized by the number of keys and of at most `most` bits.  Where that is too few for SPARE bits a
    key, df is gone over in up to PASSES ranges of the key's hash, each with a bitmap of its own.  With still more keys,
    where most rows are repeated anyhow, bitmaps fill up and more rows than need be count as possible.  The result is
    exact in the end at any size, since possible rows go the exact way."""
    wanted = keys.count() * SPARE
    buckets = LEAST_BUCKETS
    while buckets < min(wanted, most):
        buckets *= 2
    buckets = min(buckets, most)
    passes = min(PASSES, max(1, -(-wanted // buckets)))
    if passes == 1:
        return _pass(df, key, keys, buckets)
    range_of = lambda k: F.pmod(F.xxhash64(k, F.lit(1)), F.lit(passes))
    name = F.col(f"`{keys.columns[0]}`")
    parts = [_pass(df.where(range_of(key) == i), key, keys.where(range_of(name) == i), buckets) for i in range(passes)]
    maybe, surely_not = parts[0]
    for a, b in parts[1:]:
        maybe, surely_not = maybe.unionByName(a), surely_not.unionByName(b)
    return maybe, surely_not


def tie(df: DataFrame, prefix: str = "") -> Column:
    """A hash over all columns of df (maps aside, which have no order), to choose between rows that agree in all else."""
    return F.xxhash64(*[F.col(f"{prefix}`{f.name}`") for f in df.schema.fields if "map" not in f.dataType.simpleString()] or [F.lit(0)])


def empty_if_null(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
