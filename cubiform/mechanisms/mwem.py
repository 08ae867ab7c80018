"""Multiplicative weights with a graphical model: in each round select the worst answered marginal and measure it."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions.kernels import Cliques
from ..functions.losses import Measurement
from ..functions.privacy import exponential_mechanism, laplace_scale
from ..model import Model
from ..operators.cubes import schema_of
from ..plans.cliques import Clique
from .base import Answers, Mechanism


class MWEM(Mechanism):
    """``noise`` is gaussian (zCDP) or laplace (pure); ``bounded`` counts neighbours that change a row, not add one."""

    def __init__(self, *args, rounds: int | None = None, noise: str = "gaussian", bounded: bool = False, alpha: float = 0.9, **kwargs):
        super().__init__(*args, **kwargs)
        self.rounds, self.noise, self.bounded, self.alpha = rounds, noise, bounded, alpha

    def run(self, df: DataFrame, workload: Sequence[Clique], rows: int | None = None) -> tuple[Model, DataFrame]:
        schema = schema_of(df)
        workload = [tuple(c) for c in workload]
        rounds = self.rounds or len(schema)
        answers = Answers(df, [*workload, ()])
        size = 2.0 if self.bounded else 1.0
        total = float(answers[()].sum()) if self.bounded else None
        if self.noise == "gaussian":
            rho = self.ledger.rho / rounds
            sigma = math.sqrt(2 if self.bounded else 1) * math.sqrt(0.5 / (self.alpha * rho))
            eps = math.sqrt(8 * (1 - self.alpha) * rho)
        else:
            share = self.epsilon / rounds
            sigma, eps = laplace_scale(self.alpha * share, 1.0, self.bounded), (1 - self.alpha) * share
        model = self._start(schema, total)
        for k in range(1, rounds + 1):
            held = list(model.potentials) if k > 1 else []
            limit = self.max_model_mb * k / rounds
            fit_in = [c for c in workload if c in held or self.within(schema, model, c, limit)] or workload
            miss = {c: float(np.abs(answers[c] - model.project(c).datavector()).sum()) - schema.size(c) for c in fit_in}
            clique = exponential_mechanism(miss, eps, size, self.rng)
            if self.noise == "gaussian":
                self.ledger.selection(eps, "candidate")
                self.ledger.gaussian(sigma, math.sqrt(2) if self.bounded else 1.0, "marginal")
                y, std = self.gaussian(answers[clique], sigma), sigma
            else:
                y, std = answers[clique] + self.rng.laplace(0, sigma, len(answers[clique])), sigma * math.sqrt(2)
            self.measurements.append(Measurement(y, clique, std))
            cliques = list(dict.fromkeys(m.clique for m in self.measurements))
            start = model.potentials.expand(cliques) if k > 1 else None
            model = self.fitted(schema, start, total=total)
            self.log.append({"round": k, "clique": ",".join(clique)})
        return model, model.synthetic(df.sparkSession, rows)

    def _start(self, schema, total: float | None) -> Model:
        """Uniform: nothing measured yet."""
        singles = [(a,) for a in schema]
        theta = Cliques.zeros(schema, singles)
        n = total or 1.0
        mu = theta.map(lambda f: f.exp().normalize(n))
        return Model(schema, theta, mu, n)


def laplace_baseline(df: DataFrame, workload: Sequence[Clique], epsilon: float, seed: int | None = None) -> list[np.ndarray]:
    """The workload's marginals with Laplace noise alone, for comparison."""
    answers, rng = Answers(df, workload), np.random.default_rng(seed)
    return [answers[c] + rng.laplace(0, len(workload) / epsilon, len(answers[c])) for c in answers.cliques]


