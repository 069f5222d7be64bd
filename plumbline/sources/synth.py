"""Seeded corpora for tests and benchmarks: clustered or uniform unit vectors, skewed categories, weighted terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..model import DAY, ScoreSpec

NOW = 1.8e9


def centres(clusters: int, d: int, seed: int) -> np.ndarray:
    c = np.random.default_rng(seed).normal(size=(clusters, d))
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def corpus(spark: SparkSession, n: int = 10_000, d: int = 48, clusters: int = 25, cosine: float | None = 0.85, vocabulary: int = 2000, terms: int = 12, per_doc: int = 8, seed: int = 7) -> DataFrame:
    """n units, each made from its number and the seed alone, on the executors; cosine None gives uniform vectors."""
    middle = centres(clusters, d, seed)

    def make(frames):
        for f in frames:
            out = []
            for i in f["id"]:
                rng = np.random.default_rng((seed, int(i)))
                c = int(rng.integers(clusters))
                v = rng.normal(size=d)
                if cosine is not None:
                    v = middle[c] + v * np.sqrt((1 / cosine**2 - 1) / d)
                v /= np.linalg.norm(v)
                pool = (c * 37 + rng.zipf(1.5, terms)) % vocabulary
                words = {f"t{t}": float(rng.gamma(2, 0.35)) for t in pool}
                age = float(rng.gamma(2, 90)) * DAY
                lang = int(min(3, rng.zipf(2.0) - 1))
                out.append((i, i // per_doc, int(i % per_doc), int(np.clip(rng.normal(90, 22), 24, 220)), NOW - age, v.astype("float32").tolist(), words, f"[doc {i // per_doc} unit {i % per_doc}]", lang, int(i // per_doc % 32), float(rng.beta(5, 2)), c))
            yield pd.DataFrame(out, columns=["row_id", "doc_id", "ordinal", "tokens", "ts", "vec", "terms", "text", "lang", "tenant", "quality", "cluster"])

    schema = "row_id long, doc_id long, ordinal int, tokens int, ts double, vec array<float>, terms map<string,double>, text string, lang int, tenant int, quality double, cluster int"
    return spark.range(n).mapInPandas(make, schema)


def queries(count: int = 10, d: int = 48, clusters: int = 25, alpha: float = 1.0, beta: float = 0.0, gamma: float = 0.0, cosine: float = 0.8, corpus_seed: int = 7, seed: int = 11, vocabulary: int = 2000) -> list[ScoreSpec]:
    """Queries near random centres of the corpus with that seed."""
    middle, out = centres(clusters, d, corpus_seed), []
    for i in range(count):
        rng = np.random.default_rng((seed, i))
        c = int(rng.integers(clusters))
        v = middle[c] + rng.normal(size=d) * np.sqrt((1 / cosine**2 - 1) / d)
        words = {f"t{t}": float(rng.gamma(2, 0.4)) for t in (c * 37 + rng.zipf(1.5, 6)) % vocabulary} if beta else {}
        out.append(ScoreSpec(tuple(v), words, alpha, beta, gamma, NOW).bound())
    return out
