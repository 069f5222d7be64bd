"""The pipeline against the same in plain Python, stage by stage, on a small table with odd rows."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import common, exact, quality, secrets, simhash

from .conftest import EDGES
from .test_dedup import _alike, _norm, _prints
from .test_text_ops import _packed_right

LIVE = "Qx9Qx9Qx9Qx9Qx9Qx9"


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """A folder with documents (odd rows and a clashing column among them) and labels."""
    folder = str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit("x"))
    extra = [*((None if d is None else d + 50_000, t) for d, t in EDGES if d != 4), (60_001, f"token = {LIVE} and prose that is as long as it has to be"), (60_002, f"token = {LIVE} and prose  that is as long as it has to be")]
    more = [(d, t, "en", f"own{i}/x", len(t) if t else None, "x") for i, (d, t) in enumerate(extra)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def _credentials(text):
    """(start, end, value, kind) of a text's candidates, with the module's patterns and plain loops."""
    out = []
    for kind, pattern in secrets.KINDS.items():
        for m in re.finditer(pattern, text, re.A):
            if kind == "live":
                out += [(m.start() + c.start(), m.start() + c.end(), c[0], kind) for c in re.finditer(secrets.CREDENTIAL, m[0], re.A)]
                continue
            value, end = (m[1], m.end()) if kind == "assign" else (m[0], m.end())
            if kind == "assign" and len(value) < 12:
                continue
            bounded = re.sub(r"^=+(?=[^=])|(?<=[^.])\.+$", "", value)
            end -= len(re.search(r"(?<=[^.])(\.+)$", value)[1]) if re.search(r"(?<=[^.])\.+$", value) else 0
            parts = [c[0] for c in re.finditer(secrets.CREDENTIAL, bounded, re.A)]
            own = max(parts, key=lambda p: (len(p), p), default=bounded) if kind == "assign" else value
            out.append((end - len(bounded), end, own, kind))
    return out


def _cleaned(rows, corpus):
    held = {}
    for _, t, source in corpus:
        for _, _, value, _ in _credentials(t or ""):
            held.setdefault(value, set()).add(source or "")
    live = lambda v: len({s.split("/")[0] for s in held[v]}) <= 2 and len(held[v]) <= 3
    out = []
    for d, t, _ in rows:
        places = sorted({(a, b) for a, b, v, k in _credentials(t or "") if live(v) and (k != "live" or re.search(secrets.SHAPE, v, re.A))})
        new, done = "", 0
        for a, b in places:
            if a >= done or not new:
                new += t[done:a] + "[REDACTED]"
            done = max(done, b)
        out.append((d, new + t[done:] if places else t))
    return out


def test_run_equals_plain_python(spark, small):
    every = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    # the classifier itself is held against a plain refit in test_models.py
    model, features = quality.fit(docs, labels), quality.Features()
    rows = [r for r in every if model.score(features(r[1])) >= 0.3]
    last = lambda d: (d is None, d or 0)
    first = {}
    for r in rows:
        k = _norm(r[1])
        first[k] = min(first.get(k, r), r, key=lambda x: last(x[0]))
    rows = list(first.values())
    prints, left, kept = [_prints(t) for _, t, _ in rows], set(range(len(rows))), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i = todo.pop()
            seen.append(i)
            near = {j for j in left if _alike(prints[i], prints[j])}
            left -= near
            todo += near
        kept.append(rows[min(seen, key=lambda i: last(rows[i][0]))])
    texts = _cleaned(kept, every)
    assert any("[REDACTED]" in (t or "") for _, t in texts) and not any(LIVE in (t or "") for _, t in texts)
    got = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in got} == {d for d, _ in texts} and 50 < len(texts) < len(every)
    _packed_right(got, texts, 4096)


def test_stages_keep_columns_and_take_empty_tables(spark, small, sf):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs.limit(0), docs.where("doc_id IS NULL OR doc_id > 50000")):
            out = stage(spark, some, small)
            assert out.count() <= some.count() or name == "packing"
            if name != "packing":
                assert out.schema == docs.schema, name


def test_nothing_stays_behind(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    assert corpus_pipeline.run(spark, small).count() > 0
    assert len(os.listdir(tmp_path / "shared" / "plumbline")) == 1


def test_tables_have_files_by_rows_not_by_partitions(spark, sf, tmp_path, monkeypatch):
    """With 211 partitions that nothing coalesces, small tables still come in few files, and the result is the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 50_000)).cache()
    stages = [lambda d: exact.deduplicated(d), lambda d: simhash.representatives(d, radius=20, total=192), lambda d: secrets.cleaned(d, corpus=d)]
    want = [sorted(map(repr, stage(docs).collect())) for stage in stages]
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = []
        for i, stage in enumerate(stages):
            stage(docs).write.parquet(f"{tmp_path}/out-{i}")
            got.append(sorted(map(repr, spark.read.schema(docs.schema).parquet(f"{tmp_path}/out-{i}").collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        docs.unpersist()
    assert got == want
    tables = [*(tmp_path / "shared" / "plumbline").iterdir(), *tmp_path.glob("out-*")]
    files = {t.name: len(list(t.glob("part-*"))) for t in tables}
    parts = docs.rdd.getNumPartitions()
    assert max(files.values()) <= 24 + parts, files
