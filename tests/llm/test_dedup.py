"""Operators 7 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, components, exact, simhash

from .conftest import EDGES

WORDS = [f"w{i}" for i in range(400)]


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(_norm(t), []).append(d)
    out = []
    for d, t in rows:
        ids = [x for x in groups[_norm(t)] if x is not None]
        out.append((d, min(ids) if ids else None, len(groups[_norm(t)]), hashlib.sha256(_norm(t).encode()).hexdigest()))
    return sorted(map(repr, out)), len(groups)


@pytest.mark.parametrize("hash_of", [exact.content_hash, lambda c: F.length(c), lambda c: F.lit(1)])
def test_exact_groups_whatever_the_hash(edges, hash_of):
    rows = exact.groups(edges, hash_of=hash_of).collect()
    want, n = _exact(EDGES)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == want
    assert sum(r.kept for r in rows) == n and all(r.doc_id == r.keep_id for r in rows if r.kept)


@pytest.mark.parametrize("hash_of", [exact.content_hash, lambda c: F.length(c)])
def test_exact_filter_keeps_whole_rows(edges, hash_of):
    kept = exact.deduplicated(edges, hash_of=hash_of)
    assert kept.schema == edges.schema
    rows = kept.collect()
    want = {}
    for d, t in EDGES:
        want[_norm(t)] = min((x for x in (want.get(_norm(t)), d) if x is not None), default=None)
    assert sorted(map(repr, ((r.doc_id, _norm(r.text)) for r in rows))) == sorted(map(repr, ((d, t) for t, d in want.items())))


def test_exact_empty(none):
    assert exact.groups(none).count() == exact.deduplicated(none).count() == 0


def _print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _components(prints):
    left, out = set(range(len(prints))), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            near = {j for j in left if (prints[i] ^ prints[j]).bit_count() <= 2}
            left -= near
            todo += near
        out.update(dict.fromkeys(seen, frozenset(seen)))
    return out


def _corpus():
    rng = random.Random(5)
    texts = [(d, t) for d, t in EDGES]
    for i in range(120):
        words = rng.choices(WORDS, k=rng.choice([2, 3, 30, 400]))
        for j in range(rng.choice([1, 1, 3])):
            own = list(words)
            if j:
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            texts.append((100 + 10 * i + j, " ".join(own)))
    return texts


def test_fingerprints():
    for _, t in _corpus():
        assert simhash.fingerprint(t) == _print(t)


def test_simhash_components(make):
    texts = _corpus()
    rows = simhash.near_duplicates(make(texts)).collect()
    prints = [_print(t) for _, t in texts]
    of = _components(prints)
    want = [(texts[i][0], f"{prints[i]:016x}", min((texts[j][0] for j in of[i] if texts[j][0] is not None), default=None)) for i in range(len(texts))]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def _mixed(x, k):
    if k:
        x = (x + k * 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        x ^= x >> 31
    return x


def _prints(t, shingle=5, count=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    out = []
    for k in range(count):
        h = [_mixed(xxhash.xxh64_intdigest(x.encode(), 42), k) for x in shingles]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    return out


def _alike(p, q):
    bits = [(a ^ b).bit_count() for a, b in zip(p, q)]
    return min(bits) <= 8 and sum(bits) <= 34


def test_representatives(make):
    """One row of each component by all fingerprints, found by comparing all pairs."""
    texts = _corpus()
    prints = [_prints(t) for _, t in texts]
    left, groups = set(range(len(texts))), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            near = {j for j in left if _alike(prints[i], prints[j])}
            left -= near
            todo += near
        groups.append(seen)
    kept = simhash.representatives(make(texts))
    assert kept.columns == make(texts).columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(min((texts[j][0] for j in c if texts[j][0] is not None), default=None)) for c in groups)
    assert any(len({texts[j][1] for j in c}) > 1 for c in groups)


def test_rows_alike_but_for_other_columns_leave_the_same_one(make):
    docs = make([(1, "some words that are here")] * 6, source=[f"s{i}" for i in range(6)])
    for f in (simhash.representatives, exact.deduplicated):
        assert len({f(docs.repartition(n)).collect()[0].source for n in (1, 3, 6)}) == 1


@pytest.mark.parametrize("chunk", [1 << 15, 40])
def test_wide_links_in_chunks(spark, chunk):
    """All links of the radius, be buckets whole or in pairs of chunks."""
    rng = np.random.default_rng(4)
    prints = [(0, 0, 0)]
    while len(prints) < 500:
        p = prints[rng.integers(len(prints))] if rng.random() < 0.7 else [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 3)]
        # some are near on one fingerprint only, some on none, some beyond the total
        flips = rng.integers(0, 20, 3)
        prints.append(tuple((x % 2**64 ^ sum(1 << int(i) for i in rng.choice(64, f, replace=False)) ^ 1 << 63) - 2**63 for x, f in zip(p, flips)))
    prints = sorted(set(prints))
    node = lambda p: b"".join((x % 2**64).to_bytes(8, "big") for x in p)
    unsigned = {p: [x % 2**64 for x in p] for p in prints}
    got = components.components(simhash.wide_links(spark.createDataFrame(prints, "a long, b long, c long"), chunk=chunk)).collect()
    left, want = set(prints), {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            p = todo.pop()
            seen.append(p)
            near = {q for q in left if _alike(unsigned[p], unsigned[q])}
            left -= near
            todo += near
        if len(seen) > 1:
            want |= {node(p): min(map(node, seen)) for p in seen}
    assert {bytes(r.node): bytes(r.root) for r in got} == want and len(set(want.values())) > 1
    assert sum(n for _, n in simhash.parts_of(8)) == 64 and len(simhash.parts_of(8)) == 10


@pytest.mark.parametrize(("most", "passes"), [(2, 4), (1 << 5, 4), (1 << 8, 2), (1 << 20, 1)])
def test_full_bitmaps_lose_nothing(spark, most, passes):
    """Keys for many bitmaps: the split stays sound when it goes in passes, and when even those are full."""
    keys = common.stored(spark.range(0, 32).select((F.col("id") * 7).alias("k")), "keys")
    rows = spark.range(0, 4000).select("id", F.lit("x").alias("_bucket2"))
    maybe, sure = common.in_buckets(rows, F.col("id"), keys, most=most)
    a, b = [sorted(r.id for r in x.collect()) for x in (maybe, sure)]
    assert sorted(a + b) == list(range(4000)) and {7 * i for i in range(32)} <= set(a)
    assert (len(b) > 2000) == (most > 2)


def test_scratch_is_removed(spark):
    with common.scratch(spark):
        kept = common.stored(spark.range(5), "gone")
        path = kept.inputFiles()[0]
        assert kept.count() == 5
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == simhash.representatives(none).count() == 0


def _neighbours(rng, n):
    """Prints in chains of small steps, many in one bucket."""
    out = {int(x) for x in rng.integers(0, 1 << 62, n // 4)}
    base = [int(rng.integers(0, 1 << 62))]
    while len(out) < n:
        x = base[rng.integers(len(base))]
        for _ in range(rng.integers(1, 4)):
            x ^= 1 << int(rng.integers(40))
        out.add(x)
        base.append(x)
    return sorted(out)


def test_star_edges_join_all_within_radius():
    rng = np.random.default_rng(1)
    for n in (2, 65, 300):
        prints = np.array(_neighbours(rng, n), np.uint64)
        buckets = np.sort(rng.integers(0, 3, len(prints)))
        edges = simhash.star_edges(prints, buckets)
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            assert (int(prints[a]) ^ int(prints[b])).bit_count() <= 2 and buckets[a] == buckets[b]
            assert find(a) != find(b)
            root[find(a)] = find(b)
        for a in range(n):
            for b in range(a):
                if buckets[a] == buckets[b] and (int(prints[a]) ^ int(prints[b])).bit_count() <= 2:
                    assert find(a) == find(b)


@pytest.mark.parametrize("large", [1 << 11, 3])
def test_links_lose_none(spark, large):
    prints = _neighbours(np.random.default_rng(2), 400)
    frame = spark.createDataFrame([(x,) for x in prints], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(frame, large)).collect()}
    of = _components(prints)
    for i, x in enumerate(prints):
        assert roots.get(x, x) == min(prints[j] for j in of[i])


def test_components_of_paths_and_stars(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    random.Random(0).shuffle(edges)
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(n + 1), 0), **dict.fromkeys(range(1000, 1050), 1000)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("full", [False, True])
def test_prefilter_misses_no_key(spark, full):
    most = 64 if full else common.MOST_BUCKETS  # few buckets, all taken
    df = spark.range(20000).select(F.when(F.col("id") > 0, F.col("id")).alias("key"), F.lit("x").alias("_page"))
    maybe, surely_not = common.in_buckets(df, F.col("key"), spark.range(0, 20000, 7).select(F.col("id").alias("k")), most=most)
    assert maybe.columns == surely_not.columns == ["key", "_page"]
    found, rest = {r.key for r in maybe.collect()}, {r.key for r in surely_not.collect()}
    assert not found & rest and len(found) + len(rest) == 20000
    assert set(range(7, 20000, 7)) <= found
    assert full == (not rest) and (full or len(found) < 3000)
    nothing, every = common.in_buckets(df, F.col("key"), spark.range(0).select(F.col("id").alias("k")))
    assert nothing.count() == 0 and every.count() == 20000
