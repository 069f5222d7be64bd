"""Operator 3, media columns: content-addressed payloads in tar shards.

A payload is a text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64, and is kept losslessly as an
8-bit grey PNG, 64 samples wide.  Payloads are addressed by their SHA-256; each address is stored once, as a member of
a tar shard in the shared folder.  An index holds digest, shard, offset and length.  Reads of the members' headers
alone fill the metadata columns (width, height, depth); whole reads give the features.

Tasks write shards and index to names of their own attempt, and only the index of the attempt whose result Spark took is used, so lost
executors and repeated tasks leave at most an unused shard and index.  Media whose digest occurs once are written where they are made; those that
may have copies are dropped within a task, then shuffled by digest, so one that a third of all rows share arrives once
per task.

The Python workers write both, through `pyarrow.fs`: a file that the JVM writes to a local folder costs several processes
(`common.in_files`).  What follows from the index (metadata, features) is no table: each reading of the result computes it from what is stored.

Defined results: null text counts as empty (64 zero bytes).  Rows are independent; repeated rows, null doc_id and extra
columns are harmless; an empty table gives an empty table."""

from __future__ import annotations

import hashlib
import math
import struct
import tarfile
import zlib
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, empty_if_null, in_buckets, in_files, new_path, prepare, stored

WIDTH, BLOCK = 64, 512

#: Bytes after which a task opens another shard.
SHARD_BYTES = 128 << 20

#: Digests that a task remembers to drop copies early; beyond, copies merely travel further.
REMEMBERED = 200_000

SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = len(SIGNATURE) + 25

INDEX = "digest binary, shard string, offset long, length long"
META = "width long, height long, depth int, colour int"
FEATURES = "payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def payload_column(text: Column) -> Column:
    """The payload of a text, in the JVM."""
    data = F.encode(text, "UTF-8")
    size = F.greatest(F.ceil(F.octet_length(data) / F.lit(WIDTH)) * WIDTH, F.lit(WIDTH)).cast("int")
    return F.call_function("rpad", data, size, F.lit(b"\x00"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_media(payload: bytes) -> bytes:
    """The PNG of a payload whose size is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def media_header(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, depth, colour) from a PNG's first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", data[16:26])


def from_media(data: bytes) -> bytes:
    """The payload of a PNG that to_media made, its checksums verified."""
    width, height, depth, colour = media_header(data)
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not an 8-bit grey PNG of the width used here")
    at, parts = len(SIGNATURE), []
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != data[at + 8 + size : at + 12 + size]:
            raise ValueError("a chunk of the PNG is damaged")
        parts += [body] if kind == b"IDAT" else []
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, as text of fixed precision."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, values = len(samples), np.arange(256)
    mean = int((counts * values).sum()) / n
    deviation = math.sqrt(max(0.0, int((counts * values * values).sum()) / n - mean * mean))
    share = counts[counts > 0] / n
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={abs(math.fsum(-share * np.log2(share))):.4f}"


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def payloads(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, payload) of the texts, in the JVM."""
    return docs.select(payload_column(empty_if_null(text)).alias("payload")).select(F.unhex(F.sha2("payload", 256)).alias("digest"), "payload")


def encoded(rows: DataFrame) -> DataFrame:
    """(digest, media) of payloads, copies within a task dropped."""
    prepare(rows.sparkSession)

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            digests, media = [], []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    media.append(to_media(x))
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(media, pa.binary())], ["digest", "media"])

    return rows.mapInArrow(run, "digest binary, media binary")


def write_shards(media: DataFrame, folder: str, deal: bool = True) -> DataFrame:
    """Writes each digest's media once into tar shards under `folder`; the stored index of them.

    deal False says that no digest comes twice: then each task writes what it has, and no media are shuffled.  The driver
    gets one name a task that has media, of its part of the index."""
    schema = pa.schema([("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        from pyarrow.parquet import ParquetWriter
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, out, at, number, last = "", None, 0, 0, None
        listed, index, rows = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.parquet", None, []

        def flushed():
            nonlocal rows
            table, rows = pa.table(list(map(pa.array, zip(*rows), schema.types)), schema), []
            to = index or ParquetWriter(f"{base}/{listed}", schema, filesystem=fs, compression="zstd")
            to.write_table(table)
            return to

        for b in batches:
            for digest, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest == last:
                    continue
                last = digest
                if out is None:
                    name, at = f"shard-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.tar", 0
                    out, number = fs.open_output_stream(f"{base}/{name}"), number + 1
                member = tarfile.TarInfo(f"{digest.hex()}.png")
                member.size = len(data)
                out.write(member.tobuf(tarfile.USTAR_FORMAT))
                out.write(data)
                out.write(b"\0" * (-len(data) % BLOCK))
                rows.append((digest, name, at + BLOCK, len(data)))
                at += BLOCK + len(data) + -len(data) % BLOCK
                if at >= SHARD_BYTES:
                    out.write(b"\0" * (2 * BLOCK))
                    out.close()
                    out = None
            if len(rows) >= SMALL_ROWS:
                index = flushed()
        if out is not None:
            out.write(b"\0" * (2 * BLOCK))
            out.close()
        if rows:
            index = flushed()
        if index is not None:
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([listed])], ["listed"])

    spark = media.sparkSession
    dealt = media.repartition("digest").sortWithinPartitions("digest") if deal else media
    paths = [f"{folder}/{r.listed}" for r in dealt.mapInArrow(run, "listed string").collect()]
    return spark.read.schema(INDEX).parquet(*paths) if paths else spark.createDataFrame([], INDEX)


def _read(index: DataFrame, folder: str, limit: int | None, f, kinds: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """index with what f makes of a member's first `limit` bytes (None: all of them)."""

    def run(batches):
        fs, base = _filesystem(folder)
        name, shard = None, None
        for b in batches:
            rows = []
            get = b.schema.get_field_index
            for s, offset, length in zip(*(b.column(get(c)).to_pylist() for c in ("shard", "offset", "length"))):
                if s != name:
                    if shard is not None:
                        shard.close()
                    name, shard = s, fs.open_input_file(f"{base}/{s}")
                shard.seek(offset)
                rows.append(f(shard.read(min(length, limit or length))))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, (_, k) in zip(columns, kinds))], [*b.schema.names, *(n for n, _ in kinds)])
        if shard is not None:
            shard.close()

    fields = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in index.schema.fields)
    return index.mapInArrow(run, f"{fields}, {schema}")


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """index with width, height, depth and colour, read from the members' headers alone."""
    return _read(index, folder, HEADER, media_header, [("width", pa.int64()), ("height", pa.int64()), ("depth", pa.int32()), ("colour", pa.int32())], META)


def _features(data: bytes) -> tuple:
    payload = from_media(data)
    return len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).digest(), feature(payload)


def with_features(index: DataFrame, folder: str) -> DataFrame:
    """index with sizes, digests and the feature of what is stored, read back whole."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return _read(index, folder, None, _features, list(zip([x.split()[0] for x in FEATURES.split(", ")], kinds)), FEATURES)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's doc_id and n_bytes beside the place, metadata and features of its payload."""
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "media")
    texts = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), empty_if_null(text).alias("text"))
    # not null by its type, too: the join below would else filter by it, and digest each text twice
    digest = F.coalesce(F.unhex(F.sha2(payload_column(F.col("text")), 256)), F.lit(b"")).alias("digest")
    rows = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
    # only media that may come twice are shuffled to meet their copies
    repeated = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    n = docs.count()
    repeated = stored(in_files(repeated, n), "media-repeated")
    maybe, once = in_buckets(payloads(docs, text), F.col("digest"), repeated)
    index = write_shards(encoded(maybe), folder).unionByName(write_shards(encoded(once), folder, deal=False))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ranges of places, not whole shards: shards differ in size
    placed = index.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    read = with_features(with_metadata(placed, folder), folder)
    hexadecimal = lambda c: F.lower(F.hex(c)).alias(c)
    return in_files(rows.join(read, "digest"), n).select(
        "doc_id", "n_bytes", "payload_bytes", hexadecimal("payload_sha256"), "tail_crc32", "media_bytes", hexadecimal("media_sha256"), "feature",
        hexadecimal("digest"), "shard", "offset", "length", "width", "height", "depth",
    )


def members(folder: str, shard: str) -> dict[str, bytes]:
    """The members of a shard, by the tar format's own reader; for tests and repairs."""
    fs, base = _filesystem(folder)
    with fs.open_input_file(f"{base}/{shard}") as f, tarfile.open(fileobj=BytesIO(f.read())) as t:
        return {m.name: t.extractfile(m).read() for m in t.getmembers()}
