"""Operator 7, SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit for each place where over half of its shingles' hashes have one.  Fingerprints
link at RADIUS or fewer differing bits.  Only distinct fingerprints are compared.  A fingerprint is cut into four
blocks of 16 bits; two that link agree in at least two blocks, so each is dealt out under its six pairs of blocks.
Buckets stand one after the other as bit planes, one row of packed words per bit place; each lane is compared with the
lane `shift` further on, for as many shifts as buckets reach, by XOR and carry-save counters that hold 64 distances in
a word, and words are abandoned once all their lanes are beyond the radius.

A bucket links into stars (its own components), so no bucket gives more rows than it has.  Large buckets are dealt
again under pairs of 8-bit parts of the other 32 bits; what shares those too is at most 65536 distinct fingerprints.

`representatives`, the filter, looks for texts alike in at least 0.8 of their five-word shingles.  Those differ in more
bits than RADIUS: of 64, 9.7 on average at 0.8 (the angle whose cosine is 2 x 0.8 / 1.8).  So each text has PRINTS
fingerprints that fail independently; a link is within WIDE_RADIUS on any one of them, and within TOTAL bits on all
together, which is the mean at 0.8 and a standard deviation, and keeps chance links out.  Cut into WIDE_RADIUS + 2
parts, fingerprints that link agree in at least two, so the same scheme finds all links; buckets beyond CHUNKED are
compared in pairs of chunks, so that no task holds more than two chunks.  Candidates grow as PRINTS x n^2 / 2^13 for n
distinct fingerprints: fit for some 10^9; beyond that a lesser radius must do.

Defined results: null text counts as empty; texts without words have fingerprint zero and link like any other.  A
component's id is its smallest doc_id that is not null (null if all are).  Repeated rows and extra columns are harmless;
an empty table gives an empty table."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, empty_if_null, in_buckets, in_files, prepare, stored, tie
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42

#: Fingerprints in a bucket beyond which it is dealt again, and lanes compared at once at least.
LARGE, LANES = 2048, 1 << 15

#: The filter's shingle, how many fingerprints, radius on one of them and on all; distinct fingerprints of a chunk.
WIDE_SHINGLE, PRINTS, WIDE_RADIUS, TOTAL, CHUNKED = 5, 3, 8, 34, 1 << 15

#: Shingles whose hashes are summed at once.
CHUNK = 1 << 16


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of independent hash functions, from the values of the first (k = 0), which stay."""
    if not k:
        return hashes
    # steps and multipliers of the splitmix64 generator (fixed values)
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprints(text: str | None, shingle: int = SHINGLE, count: int = 1) -> list[int]:
    """The first `count` fingerprints of a text as unsigned numbers."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    if not words:
        return [0] * count
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros((count, BITS), np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], np.uint64)
        for k in range(count):
            ones[k] += np.unpackbits(mixed(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(x).tobytes(), "big") for x in ones * 2 > len(starts)]


def fingerprint(text: str | None) -> int:
    return fingerprints(text)[0]


def print_columns(count: int) -> list[str]:
    return [f"p{k}" for k in range(count)]


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = WIDE_SHINGLE, count: int = PRINTS) -> DataFrame:
    """docs with its rows in a struct `row`, beside p0, p1, ..: the first `count` fingerprints as signed longs."""
    prepare(docs.sparkSession)
    names = print_columns(count)

    def run(batches):
        for b in batches:
            found = np.array([fingerprints(x, shingle, count) for x in b.column(1).to_pylist()], np.uint64).reshape(-1, count).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[:, k]) for k in range(count)]], ["row", *names])

    rows = docs.select(F.struct("*").alias("row"), empty_if_null(text).alias("text"))
    schema = rows.select("row").schema
    for name in names:
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Planes:
    """Fingerprints stored vertically: a row of packed words for each bit place, a lane for each fingerprint."""

    def __init__(self, prints: np.ndarray):
        self.words = -(-len(prints) // 64)
        padded = np.zeros((self.words + 2) * 64, ">u8")
        padded[: len(prints)] = prints
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1)
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)

    def near(self, shift: int, alive: np.ndarray, radius: int = RADIUS) -> np.ndarray:
        """The lanes i of `alive` (a mask by lane) whose fingerprint is within the radius of lane i + shift's.

        All lanes of a word are counted at once: `counts` are carry-save counters, one plane per binary digit, and
        `over` holds lanes beyond what they can count.  Words in which no lane is left are abandoned."""
        packed = np.zeros(self.words * 64, np.uint8)
        packed[: len(alive)] = alive
        lanes = np.packbits(packed, bitorder="little").view(np.uint64)
        at = np.flatnonzero(lanes)
        far, q, r = ~lanes[at], shift // 64, np.uint64(shift % 64)
        digits = (radius + 1).bit_length()
        counts = np.zeros((digits, len(at)), np.uint64)
        for p, plane in enumerate(self.planes):
            other = plane[at + q] if not r else plane[at + q] >> r | plane[at + q + 1] << np.uint64(64) - r
            carry = plane[at] ^ other
            for d in range(digits):
                carry, counts[d] = counts[d] & carry, counts[d] ^ carry
            far |= carry
            if p % 8 == 7:
                done = far | _beyond(counts, radius)
                if not (keep := done != ~np.uint64(0)).all():
                    at, far, counts = at[keep], done[keep], counts[:, keep]
                else:
                    far = done
        found = np.zeros(self.words, np.uint64)
        found[at] = ~far
        return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))


def _beyond(counts: np.ndarray, radius: int) -> np.ndarray:
    """The lanes whose counter exceeds the radius, compared digit by digit from the highest."""
    more, same = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for d in reversed(range(len(counts))):
        if radius >> d & 1:
            same &= counts[d]
        else:
            more |= same & counts[d]
            same &= ~counts[d]
    return more


def star_edges(prints: np.ndarray, buckets: np.ndarray, radius: int = RADIUS, others: list[np.ndarray] = (), total: int = 0) -> list[tuple[int, int]]:
    """Edges by position that join all fingerprints (uint64) which stand in one bucket and link within the radius.

    `buckets` numbers the buckets, in runs; with `others`, further fingerprints of the same texts, links must also be
    within `total` on all fingerprints together.  The edges are a tree for each component, not all its pairs."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges, planes = [], Planes(prints)
    alive, shift = buckets[:-1] == buckets[1:], 1
    while alive.any():
        at = planes.near(shift, alive, radius)
        if len(others) and len(at):
            at = at[sum(np.bitwise_count(x[at] ^ x[at + shift]).astype(np.int64) for x in (prints, *others)) <= total]
        for i in at.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((i, i + shift))
        shift += 1
        alive = buckets[:-shift] == buckets[shift:]
    return edges


_BLOCKS = list(combinations(range(4), 2))


def _keys(fp: Column, width: int, shifts: list[int]) -> Column:
    """An array of (pair, key) for the pairs of `width`-bit parts of fp at `shifts`."""
    part = lambda s: F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(k).alias("pair"), F.shiftleft(part(shifts[i]), width).bitwiseOR(part(shifts[j])).alias("key")) for k, (i, j) in enumerate(_BLOCKS)])


def _whole_buckets(batches, by: list[str], prints: list[str]):
    """The columns `prints`, and a number for each bucket, of rows that come bucket by bucket; many buckets to a chunk."""

    def columns(t):
        keys = np.column_stack([t[c].to_numpy() for c in by])
        return [t[c].to_numpy().view(np.uint64) for c in prints], np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= LANES:
            t = pa.Table.from_batches(held).combine_chunks()
            found, buckets = columns(t)
            cut = int(np.searchsorted(buckets, buckets[-1]))
            if cut:
                yield [x[:cut] for x in found], buckets[:cut]
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield columns(pa.Table.from_batches(held).combine_chunks())


def _linked(dealt: DataFrame, by: list[str]) -> DataFrame:
    """Star edges (u, v) of the buckets of `dealt`."""

    def run(batches):
        for (prints,), buckets in _whole_buckets(batches, by, ["fp"]):
            edges = np.array(star_edges(prints, buckets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(prints[edges[:, k]].view(np.int64)) for k in (0, 1)], ["u", "v"])

    return dealt.repartition(*by).sortWithinPartitions(*by, "fp").select("fp", *by).mapInArrow(run, "u long, v long")


def links(prints: DataFrame, large: int = LARGE) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (a column `fp` of longs) that join all which link within RADIUS."""
    dealt = prints.select("fp", F.explode(_keys(F.col("fp"), 16, [0, 16, 32, 48])).alias("k")).select("fp", "k.pair", "k.key")
    sizes = stored(dealt.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    # a bucket of one needs no comparison
    edges = _linked(dealt.join(sizes.where(F.col("n") <= large), ["pair", "key"]), ["pair", "key"])
    crowded = sizes.where(F.col("n") > large)
    if crowded.isEmpty():
        return edges
    rest = F.lit(None).cast("long")
    for k, kept in enumerate(_BLOCKS):
        a, b = [F.shiftrightunsigned("fp", 16 * x).bitwiseAND(F.lit(0xFFFF)) for x in range(4) if x not in kept]
        rest = F.when(F.col("pair") == k, F.shiftleft(b, 16).bitwiseOR(a)).otherwise(rest)
    finer = dealt.join(crowded, ["pair", "key"]).select("fp", "pair", "key", F.explode(_keys(rest, 8, [0, 8, 16, 24])).alias("k"))
    return edges.unionByName(_linked(finer.select("fp", "pair", "key", F.col("k.pair").alias("pair2"), F.col("k.key").alias("key2")), ["pair", "key", "pair2", "key2"]))


def parts_of(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of the radius + 2 parts of a fingerprint, which differ in size by a bit at most."""
    n = radius + 2
    ends = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def wide_links(prints: DataFrame, radius: int = WIDE_RADIUS, total: int = TOTAL, chunk: int = CHUNKED) -> DataFrame:
    """Edges (u, v) over distinct rows of fingerprints (all columns of `prints`) that join all which are within `radius`
    on one of them and within `total` on all.

    u and v are a row's fingerprints as one binary.  There are as many buckets as pairs of parts have values, so their
    sizes are a table of bounded length (356,000 rows a fingerprint at the radius of 8), whatever the number of rows."""
    names, pairs = prints.columns, list(combinations(parts_of(radius), 2))
    part = lambda p: F.shiftrightunsigned("own", p[0]).bitwiseAND(F.lit((1 << p[1]) - 1))
    # the fingerprint and the pair in the upper half, the value in the lower
    keys = [F.shiftleft(F.col("at") * len(pairs) + k, 32).bitwiseOR(F.shiftleft(part(x), y[1])).bitwiseOR(part(y)) for k, (x, y) in enumerate(pairs)]
    each = prints.select(*names, F.posexplode(F.array(*names)).alias("at", "own")).withColumn("at", F.col("at").cast("long"))
    dealt = each.select(*names, F.explode(F.array(*keys)).alias("bucket"))
    crowded = stored(dealt.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks")).where("chunks > 1"), "crowded")
    dealt = dealt.join(F.broadcast(crowded), "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # a chunk meets itself and each other one: in a bucket of c chunks a row goes to c units of work
    own = F.pmod(F.xxhash64(*names), F.col("chunks"))
    units = dealt.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    units = units.select(*names, "bucket", F.shiftleft(F.least("chunk", "other"), 32).bitwiseOR(F.greatest("chunk", "other")).alias("unit"))
    by = ["bucket", "unit"]

    def run(batches):
        for (bucket, *found), buckets in _whole_buckets(batches, by, ["bucket", *names]):
            at = (bucket >> np.uint64(32)) // np.uint64(len(pairs))
            rows = np.column_stack(found).astype(">u8")
            # the fingerprint that a bucket was dealt by, in runs since rows come by bucket
            ends = np.searchsorted(at, np.arange(len(found) + 1))
            for k, (i, j) in enumerate(zip(ends, ends[1:])):
                if j - i > 1:
                    others = [x[i:j] for n, x in enumerate(found) if n != k]
                    edges = i + np.array(star_edges(found[k][i:j], buckets[i:j], radius, others, total), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array([rows[e].tobytes() for e in edges[:, side].tolist()], pa.binary()) for side in (0, 1)], ["u", "v"])

    return units.repartition(*by).sortWithinPartitions(*by).select(*names, *by).mapInArrow(run, "u binary, v binary")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root): each fingerprint that links to another, with the least of its component."""
    return components(links(prints.select("fp").distinct())).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of each row."""
    rows = stored(_slim(docs, doc_id, text), "prints")
    ids = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "ids")
    roots = stored(classes(ids), "roots")
    least = roots.join(ids, "fp").groupBy("root").agg(F.min("id").alias("component_id"))
    joined = ids.join(roots.join(least, "root").select("fp", "component_id"), "fp", "left")
    of_print = stored(joined.select("fp", F.coalesce("component_id", "id").alias("component_id")), "components")
    return rows.join(of_print, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and fp of each row."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            prints = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), empty_if_null(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS, total: int = TOTAL) -> DataFrame:
    """docs with one row of each component of near copies, the one with the smallest doc_id, and all its columns.

    Texts without words are near copies of each other.  Of rows with one doc_id the least hash of text, then of all
    columns, stays.  Rows whose fingerprints are no other row's and link to none pass without a shuffle of their texts; of
    the others the least row of each fingerprint is found first, then the least of each component."""
    rows = stored(with_fingerprints(docs, text, shingle), "printed")
    half = lambda c: F.lpad(F.hex(c), 16, "0")
    names = print_columns(PRINTS)
    fp = F.unhex(F.concat(*[half(c) for c in names]))
    counts = stored(in_files(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), rows.count()), "counts")
    distinct = counts.count()
    linked = components(wide_links(counts.select(*names), radius, total), nodes=distinct)
    roots = stored(in_files(linked.select(F.col("node").alias("fp"), "root"), distinct), "roots")
    joint = counts.where("n > 1").select(fp.alias("fp")).unionByName(roots.select("fp")).distinct()
    joint = stored(in_files(joint, distinct), "joint")
    maybe, alone = in_buckets(rows.withColumn("fp", fp), F.col("fp"), joint)
    order = F.struct(F.col(f"row.`{doc_id}`").isNull(), F.col(f"row.`{doc_id}`"), F.xxhash64(F.col(f"row.`{text}`")), tie(docs, "row."))
    each = maybe.groupBy("fp").agg(F.min_by(F.struct("row", order.alias("order")), order).alias("least"))
    of_root = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of_root.groupBy("root").agg(F.min_by("least.row", "least.order").alias("row"))
    return alone.select("row.*").unionByName(in_files(least.select("row.*"), joint.count(), TEXT_ROWS))
