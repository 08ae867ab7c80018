"""Adaptive measurement: each round measures the marginal that the model answers worst for its size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions.privacy import exponential_mechanism
from ..model import Model
from ..operators.cubes import schema_of
from ..plans.cliques import Clique, downward_closure
from .base import Answers, Mechanism, expected_l1


def closure_weights(workload: Mapping[Clique, float]) -> dict[Clique, float]:
    """All subsets of the workload's cliques, weighted by their overlap with it."""
    return {c: sum(w * len(set(c) & set(q)) for q, w in workload.items()) for c in downward_closure(workload)}


class AIM(Mechanism):
    """Nine tenths of a round's budget measure, one tenth selects; noise halves when a round taught nothing."""

    def __init__(self, *args, rounds: int | None = None, **kwargs):
        super().__init__(*args, **kwargs)
        self.rounds = rounds

    def pick(self, candidates: Mapping[Clique, float], answers: Answers, model: Model, eps: float, sigma: float) -> Clique:
        scores = {}
        for c, w in candidates.items():
            miss = np.abs(answers[c] - model.project(c).datavector()).sum()
            scores[c] = w * (miss - expected_l1(sigma, answers.schema.size(c)))
        self.ledger.selection(eps, "candidate")
        return exponential_mechanism(scores, eps, max(candidates.values()), self.rng)

    def run(self, df: DataFrame, workload: Mapping[Clique, float] | Sequence[Clique], rows: int | None = None, initial: Sequence[Clique] | None = None) -> tuple[Model, DataFrame]:
        schema = schema_of(df)
        workload = dict(workload) if isinstance(workload, Mapping) else {tuple(c): 1.0 for c in workload}
        weights = closure_weights(workload)
        candidates = {c: weights[c] for c in self.possible(schema, weights)}
        initial = [c for c in candidates if len(c) == 1] if initial is None else [tuple(c) for c in initial]
        answers = Answers(df, [*candidates, *initial])
        rho, rounds = self.ledger.rho, self.rounds or 16 * len(schema)
        sigma, eps = math.sqrt(rounds / (2 * 0.9 * rho)), math.sqrt(8 * 0.1 * rho / rounds)
        for c in initial:
            self.measure(answers, [c], sigma)
        model, last = self.fitted(schema), False
        while not last:
            left = self.ledger.left
            if left < 2 * (0.5 / sigma**2 + eps**2 / 8):  # what remains is one round's
                sigma, eps, last = math.sqrt(1 / (2 * 0.9 * left)), math.sqrt(8 * 0.1 * left), True
            limit = self.max_model_mb * (self.ledger.used + 0.5 / sigma**2 + eps**2 / 8) / rho
            held = set(model.potentials)
            fit_in = {c: w for c, w in candidates.items() if c in held or self.within(schema, model, c, limit)}
            clique = self.pick(fit_in or {c: w for c, w in candidates.items() if len(c) == 1}, answers, model, eps, sigma)
            before = model.project(clique).datavector()
            self.measure(answers, [clique], sigma)
            cliques = list(dict.fromkeys(m.clique for m in self.measurements))
            model = self.fitted(schema, model.potentials.expand(cliques))
            change = float(np.abs(model.project(clique).datavector() - before).sum())
            self.log.append({"clique": ",".join(clique), "sigma": sigma, "epsilon": eps, "rho_used": self.ledger.used})
            if change <= expected_l1(sigma, schema.size(clique)):
                sigma, eps = sigma / 2, eps * 2
        return model, model.synthetic(df.sparkSession, rows)
