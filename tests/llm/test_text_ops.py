"""Operators 1, 2, 3: codecs, packing and media, against the tokenizers library, zlib and tarfile."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, media, packing

from .conftest import EDGES

TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sabtreé ß,.!?09 　aA")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_codec_equals_library(text):
    c = bpe.codec(None)
    ids = c.library.encode(text, add_special_tokens=False).ids
    assert c.encode(text) == ids
    assert c.decode(ids) == c.library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_word_codec_equals_library(text):
    c = packing.codec(None)
    assert c.encode(text) == c.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 500, "ababababa" * 40, "!!?!?!!" * 30, "x <|endoftext|>  y<|startoftext|>", "don't 's !'s", "\n\n  b", "mississippi" * 20])
def test_codecs_on_repeats_and_added_tokens(text):
    for c in (bpe.codec(None), packing.codec(None)):
        assert list(c.encode(text)) == c.library.encode(text, add_special_tokens=False).ids


def test_no_merge_reaches_over_a_cut():
    c = bpe.codec(None)
    inside = {t[i : i + 2] for t in c.token_bytes[:50256] for i in range(len(t) - 1)}
    for text in ("Hello, world's end.  Yes\n\nno é à 12a", "x" * 9 + " y"):
        data = text.encode()
        cuts = c.cuts(data).tolist()
        assert cuts and all(data[i - 1 : i + 1] not in inside for i in cuts)


def test_windows_end_at_cuts(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 64)
    monkeypatch.setattr(packing, "WINDOW", 64)
    text = "some words, and more of them\n\n it's été " * 50 + "z" * 300
    for c in (bpe.codec(None), packing.codec(None)):
        assert list(c.encode(text)) == c.library.encode(text, add_special_tokens=False).ids


def test_round_trip_digests(edges, none):
    rows = bpe.round_trip_digests(edges).collect()
    lib = bpe.codec(None).library
    want = []
    for d, t in EDGES:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert bpe.round_trip_digests(none).count() == 0


def test_encode_decode_columns(edges):
    back = bpe.decode(bpe.encode(edges)).select("doc_id", "text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_first_fit_decreasing_equals_plain_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 200):
        sizes = rng.integers(1, 101, n).tolist()
        room, want = [100] * n, [None] * n
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            b = next(b for b in range(n) if room[b] >= sizes[i])
            want[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == want


def _packed_right(rows, texts, capacity):
    lib = packing.codec(None).library
    have, seqs = {}, {}
    for r in rows:
        have.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    for d in {d for d, _ in texts}:
        want = []
        for t in [t for e, t in texts if e == d]:
            ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            for i in range(0, len(ids), capacity):
                p = ids[i : i + capacity]
                want.append((i, len(p), zlib.crc32(p.tobytes()), len(ids)))
        assert sorted(want) == sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in have[d])
    return sum(n for s in seqs.values() for _, n in s) / (len(seqs) * capacity)


def test_packing(edges, none, make):
    _packed_right(packing.packed_documents(edges, capacity=512, group=4).collect(), EDGES, 512)
    assert packing.packed_documents(none).count() == 0
    texts = [(i, "the cat sat on the mat again " * (1 + i * 7 % 40)) for i in range(300)]
    assert _packed_right(packing.packed_documents(make(texts), capacity=512).collect(), texts, 512) > 0.97


def test_media(edges, none, spark):
    rows = media.media_columns(edges).collect()
    assert len(rows) == len(EDGES)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, t in EDGES:
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        for r in by[d]:
            if r.n_bytes != len(data):
                continue
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            stored = media.to_media(payload)
            assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
            assert (r.width, r.height, r.depth) == (64, len(payload) // 64, 8)
    assert media.media_columns(none).count() == 0


def test_shards_are_tar_files_with_each_payload_once(edges, spark):
    folder = common.new_path(spark, "media")
    index = media.write_shards(media.encoded(media.payloads(edges.unionAll(edges))), folder)
    found = {}
    for s in {r.shard for r in index.collect()}:
        for name, data in media.members(folder, s).items():
            assert name not in found
            found[name] = data
    distinct = {media.to_media((t or "").encode() + b"\0" * (-len((t or "").encode()) % 64 or (0 if t else 64))) for _, t in EDGES}
    assert set(found.values()) == distinct
    assert all(hashlib.sha256(media.from_media(d)).hexdigest() + ".png" == n for n, d in found.items())


def test_media_writes_few_tables(spark, sf, tmp_path, monkeypatch):
    """With 211 partitions that nothing coalesces, the JVM writes a few small files, parts of the index come whole, and the result is the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(100).withColumn("doc_id", F.col("doc_id") + 50_000)).repartition(3)
    rows = lambda df: sorted(map(repr, df.drop("shard", "offset").collect()))
    want = rows(media.media_columns(docs))
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    monkeypatch.setattr(media, "SMALL_ROWS", 2, raising=False)
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        media.media_columns(docs).write.parquet(f"{tmp_path}/shared/plumbline/out")
        got = rows(spark.read.parquet(f"{tmp_path}/shared/plumbline/out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and len(got) == docs.count()
    files = {t.name: len(list(t.glob("part-*"))) for t in (tmp_path / "shared" / "plumbline").iterdir()}
    assert max(files.values()) <= 24 and sum(files.values()) <= 2 * 24, files


def test_index_is_of_taken_tasks_only(spark, edges, tmp_path):
    folder = f"file://{tmp_path}/media"
    first = media.write_shards(media.encoded(media.payloads(edges)), folder).collect()
    again = media.write_shards(media.encoded(media.payloads(edges)), folder)  # what another attempt has left lies beside it
    assert len(first) == again.count() == len({r.digest for r in first})
    assert not {r.shard for r in first} & {r.shard for r in again.collect()}


def test_damaged_media_is_refused():
    data = bytearray(media.to_media(b"a" * 64))
    data[50] ^= 1
    with pytest.raises(ValueError):
        media.from_media(bytes(data))


def test_encode_in_place(make):
    docs = make(["some words", None, ""]).withColumn("text", F.coalesce("text", F.lit("")))
    ids = bpe.encode(docs, "text", "text")
    assert sorted(ids.columns) == sorted(docs.columns)
    back = bpe.decode(ids, "text", "text")
    assert sorted(r.text for r in back.select("text").collect()) == ["", "", "some words"]
