"""Joint selection: noisy marginals of private records compete with exact marginals of public ones."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions.losses import Measurement
from ..functions.privacy import exponential_mechanism
from ..model import Model
from ..operators.cubes import schema_of
from ..plans.cliques import Clique
from ..plans.cliques import model_size_mb as size_mb
from .aim import closure_weights
from .base import Answers, Mechanism, expected_l1

#: Bounded neighbours change one row: L2 norm of a marginal's change, and L1 norm of a score's.
L2_CHANGE, SCORE_CHANGE = math.sqrt(2.0), 2.0


class JAM(Mechanism):
    """Each round spends ``alpha`` of its share on choosing a marginal and its source; public ones cost no measurement."""

    def __init__(self, *args, rounds: int | None = None, alpha: float = 0.1, **kwargs):
        super().__init__(*args, **kwargs)
        self.rounds, self.alpha = rounds, alpha

    def run(self, private: DataFrame, public: DataFrame, workload: Mapping[Clique, float] | Sequence[Clique], rows: int | None = None) -> tuple[Model, DataFrame]:
        schema = schema_of(private)
        workload = dict(workload) if isinstance(workload, Mapping) else {tuple(c): 1.0 for c in workload}
        candidates = self.possible(schema, closure_weights(workload))
        own, other = Answers(private, [*candidates, ()]), Answers(public, [*candidates, ()])
        n, m = float(own[()].sum()), float(other[()].sum())
        scaled = {c: other[c] * (n / m) for c in candidates}
        gap = {c: float(np.abs(own[c] - scaled[c]).sum()) for c in candidates}
        rounds = self.rounds or 2 * len(schema)
        model: Model | None = None
        for k in range(rounds):
            share = self.ledger.left / (rounds - k)
            eps, sigma = math.sqrt(8 * share * self.alpha), L2_CHANGE / math.sqrt(2 * share * (1 - self.alpha))
            used = max(self.ledger.used / self.ledger.rho, 1 / rounds)
            held = list(dict.fromkeys(x.clique for x in self.measurements))
            fit_in = [c for c in candidates if c in held or size_mb(schema, [*held, c]) <= used * self.max_model_mb]
            miss = {c: float(np.abs(own[c] - model.project(c).datavector()).sum()) if model else 0.0 for c in fit_in}
            scores = {(c, "private"): miss[c] - expected_l1(sigma, schema.size(c)) for c in fit_in}
            scores |= {(c, "public"): miss[c] - gap[c] for c in fit_in}
            self.ledger.selection(eps, "candidate")
            clique, source = exponential_mechanism(scores, eps, SCORE_CHANGE, self.rng)
            if source == "private":
                self.ledger.gaussian(sigma, L2_CHANGE, "marginal")
                self.measurements.append(Measurement(self.gaussian(own[clique], sigma), clique, sigma))
            else:
                self.measurements.append(Measurement(scaled[clique], clique, 1.0))
            cliques = list(dict.fromkeys(x.clique for x in self.measurements))
            model = self.fitted(schema, model.potentials.expand(cliques) if model else None, total=n)
            self.log.append({"round": k + 1, "clique": ",".join(clique), "source": source, "rho_used": self.ledger.used})
        return model, model.synthetic(private.sparkSession, int(n) if rows is None else rows)


def errors(a: DataFrame, b: DataFrame, cliques: Sequence[Clique]) -> tuple[float, float]:
    """Mean and largest absolute error of marginals, relative to the first table's rows."""
    x, y = Answers(a, cliques), Answers(b, cliques)
    gaps = [float(np.abs(x[c] - y[c]).sum()) / max(1.0, float(x[c].sum())) for c in x.cliques]
    return float(np.mean(gaps)), float(np.max(gaps))
