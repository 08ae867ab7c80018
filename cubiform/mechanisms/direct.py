"""One-shot mechanisms: measure a workload, weighted or not, and fit with approximate inference."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fit import approximate, mirror_descent
from ..functions.losses import Measurement
from ..functions.privacy import laplace_scale
from ..model import Model
from ..operators.cubes import schema_of
from ..plans.cliques import Clique
from .base import Answers, Mechanism


class GaussianApproximate(Mechanism):
    """Gaussian noise on the whole workload; the region-graph oracle fits cliques of any width."""

    def run(self, df: DataFrame, workload: Sequence[Clique], weights: Sequence[float] | None = None, stepsize: float = 5e-4) -> Model:
        schema = schema_of(df)
        answers = Answers(df, workload)
        self.measure(answers, answers.cliques, 1 / math.sqrt(2 * self.ledger.rho), weights)
        return mirror_descent(schema, self.measurements, stateful=approximate, stepsize=stepsize, iters=self.iters)


class WeightedApproximate(Mechanism):
    """Laplace or Gaussian noise shared out by a strategy's weights (by default all one)."""

    def run(self, df: DataFrame, workload: Sequence[Clique], weights: Sequence[float] | None = None, noise: str = "gaussian", stepsize: float = 5e-4) -> Model:
        schema = schema_of(df)
        answers = Answers(df, workload)
        w = np.ones(len(answers.cliques)) if weights is None else np.asarray(weights, float)
        if noise == "gaussian":
            self.measure(answers, answers.cliques, 1 / math.sqrt(2 * self.ledger.rho), w)
        else:
            b = laplace_scale(self.epsilon, float(np.abs(w).sum()))
            for c, x in zip(answers.cliques, w, strict=True):
                y = answers[c] + self.rng.laplace(0, b / x, len(answers[c]))
                self.measurements.append(Measurement(y, c, math.sqrt(2) * b / x))
        return mirror_descent(schema, self.measurements, stateful=approximate, stepsize=stepsize, iters=self.iters)


def save_strategy(spark: SparkSession, path: str, cliques: Sequence[Clique], weights: Sequence[float]) -> None:
    text = json.dumps([{"clique": list(c), "weight": float(w)} for c, w in zip(cliques, weights, strict=True)])
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_strategy(spark: SparkSession, path: str) -> tuple[list[Clique], list[float]]:
    rows = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    return [tuple(r["clique"]) for r in rows], [r["weight"] for r in rows]
