"""Sign codes: a random rotation, a bit per dimension, and a factor that corrects the length.

An estimate's error is bounded by a high quantile of a sample's, so the answer after the exact second look is marked
probabilistic.  Every row within twice that error of the k-th estimate is looked at again; none is capped."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import fused
from ..model import ScoreSpec
from ..shipping import ship
from .search import top_k

#: Vectors of the sample that codes are made of, vectors that ask, and the quantile of their errors.
CODED, ASKING, SURE = 3000, 300, 0.999


def rotation(d: int, seed: int) -> np.ndarray:
    """A random rotation of d dimensions, the same for the same seed."""
    return np.linalg.qr(np.random.default_rng((seed, d)).standard_normal((d, d)))[0]


def signs(vecs: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of unit vectors after the turn, and the scale at which a vector's code gives 1 against itself (0 for a zero vector)."""
    turned = vecs @ turn
    reach = np.abs(turned).sum(axis=1)
    return turned >= 0, np.divide(1.0, reach, out=np.zeros_like(reach), where=reach > 1e-9)


def estimate(bits: np.ndarray, scale: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Inner products with turned queries (a row each): the sum over set bits less that over the others, scaled."""
    return ((bits @ (2.0 * asked.T)) - asked.sum(axis=1)) * scale[:, None]


@dataclass(frozen=True)
class Quantizer:
    """A rotation, given by its size and seed, and the error that estimates stay within but for a share of 1 - SURE."""

    d: int
    eps: float
    seed: int = 0

    @staticmethod
    def fit(units: DataFrame, seed: int = 0, quantile: float = SURE) -> Quantizer:
        """From a bounded sample, the vectors with the least hashes: some ask, and the others are coded."""
        h = F.xxhash64("vec", F.lit(seed))
        rows = units.select("vec", h.alias("h")).orderBy("h").limit(CODED + ASKING).toPandas()["vec"]
        vecs = np.stack(rows.to_numpy()).astype(np.float64)
        asking = vecs[:: max(1, len(vecs) // ASKING)]
        turn = rotation(vecs.shape[1], seed)
        found = estimate(*signs(vecs, turn), asking @ turn)
        return Quantizer(vecs.shape[1], float(np.quantile(np.abs(found - vecs @ asking.T), quantile)), seed)

    @property
    def bytes_per_vector(self) -> int:
        return self.d // 8 + 2

    def with_codes(self, units: DataFrame) -> DataFrame:
        """units with `_code`, packed bits, and `_scale`."""
        ship(units.sparkSession)
        d, seed = self.d, self.seed

        @F.pandas_udf("struct<code: binary, scale: float>")
        def code(vec: pd.Series) -> pd.DataFrame:
            bits, scale = signs(np.stack(vec.to_numpy()).astype(np.float64), rotation(d, seed))
            return pd.DataFrame({"code": [x.tobytes() for x in np.packbits(bits, axis=1)], "scale": scale.astype(np.float32)})

        coded = units.withColumn("_c", code("vec"))
        return coded.select(*units.columns, F.col("_c.code").alias("_code"), F.col("_c.scale").alias("_scale"))

    def estimated(self, spec: ScoreSpec) -> Column:
        """The estimate of the inner product with the query, of rows with codes; their vectors are not read."""
        asked, d = np.asarray(spec.dense)[None, :] @ rotation(self.d, self.seed), self.d

        @F.pandas_udf("double")
        def guess(code: pd.Series, scale: pd.Series) -> pd.Series:
            bits = np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1), axis=1)[:, :d]
            return pd.Series(estimate(bits, scale.to_numpy(np.float64), asked)[:, 0])

        return guess("_code", "_scale")

    def candidates(self, coded: DataFrame, spec: ScoreSpec, k: int, least: float = float("-inf")) -> tuple[DataFrame, float]:
        """The rows that may be among the k best, and the k-th estimate of all seen so far, of which `least` is the last.

        The estimate stands in for the dense part of the score; all else of it is exact."""
        ship(coded.sparkSession)
        rest = ScoreSpec(None, spec.sparse, 0.0, spec.beta, spec.gamma, spec.now, spec.half_life)
        guess = F.lit(spec.alpha) * self.estimated(spec) + fused(rest)
        best = coded.select(guess.alias("_e")).orderBy(F.desc("_e")).limit(k).collect()
        least = max(least, best[-1]["_e"]) if len(best) >= k else least
        return coded.withColumn("_e", guess).where(F.col("_e") >= least - 2 * spec.alpha * self.eps).drop("_e"), least

    def top_k(self, coded: DataFrame, spec: ScoreSpec, k: int, digits: int | None = None) -> DataFrame:
        """Estimates first, then the exact score of every row that may be among the k best."""
        return top_k(self.candidates(coded, spec, k)[0], spec, k, digits=digits)
