"""What the mechanisms share: exact answers counted in one job, noise, a ledger, and repeated fits."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions import fit
from ..functions.kernels import Cliques
from ..functions.losses import Measurement
from ..functions.privacy import Ledger, rho_of
from ..model import Model
from ..operators.cubes import multi, schema_of, vectors
from ..plans.cliques import Clique, model_size_mb
from ..plans.schema import Schema


#: Cells of all marginals together that the driver holds, as doubles.
MAX_CELLS = 1 << 27


class Answers:
    """Exact marginals of a table for a fixed list of cliques, counted in one pass over the data.

    More than ``MAX_CELLS`` cells are an error before anything is counted.

    They are as private as the data: only noisy functions of them may leave a mechanism.
    """

    def __init__(self, df: DataFrame, cliques: Iterable[Clique], weight: str | None = None):
        self.schema: Schema = schema_of(df)
        self.cliques = [tuple(c) for c in dict.fromkeys(cliques)]
        if (cells := sum(map(self.schema.size, self.cliques))) > MAX_CELLS:
            raise ValueError(f"the marginals have {cells} cells; {MAX_CELLS} are the most")
        got = vectors(multi(df, self.cliques, weight, self.schema), self.cliques, self.schema)
        self.of = dict(zip(self.cliques, got, strict=True))

    def __getitem__(self, clique: Clique) -> np.ndarray:
        return self.of[tuple(clique)]


class Mechanism:
    """A run's budget, randomness and measurements.

    ``seed=None`` draws from the operating system; a known seed is for tests and gives no privacy.
    """

    def __init__(self, epsilon: float, delta: float, seed: int | None = None, iters: int = 1000, max_model_mb: float = 80.0):
        self.epsilon, self.delta, self.iters, self.max_model_mb = epsilon, delta, iters, max_model_mb
        self.ledger = Ledger(rho_of(epsilon, delta) if delta > 0 else epsilon**2 / 2)
        self.rng = np.random.default_rng(seed)
        self.measurements: list[Measurement] = []
        self.log: list[dict] = []

    def gaussian(self, values: np.ndarray, sigma: float) -> np.ndarray:
        return values + self.rng.normal(0, sigma, len(values))

    def measure(self, answers: Answers, cliques: Sequence[Clique], sigma: float, weights: Sequence[float] | None = None, sensitivity: float = 1.0) -> None:
        """Noisy marginals, charged to the ledger; weights are scaled to unit length and divide the noise."""
        w = np.ones(len(cliques)) if weights is None else np.asarray(weights, float)
        w = w / np.linalg.norm(w)
        self.ledger.gaussian(sigma, sensitivity, f"measure {len(cliques)} marginals")
        for c, x in zip(cliques, w, strict=True):
            self.measurements.append(Measurement(self.gaussian(answers[c], sigma / x), tuple(c), sigma / x))

    def fitted(self, schema: Schema, potentials: Cliques | None = None, iters: int | None = None, total: float | None = None) -> Model:
        return fit.mirror_descent(schema, self.measurements, known_total=total, potentials=potentials, iters=iters or self.iters)

    def possible(self, schema: Schema, cliques: Iterable[Clique]) -> list[Clique]:
        """Cliques that some model within the size limit can hold, and single attributes; others can never be chosen."""
        return [c for c in cliques if len(c) < 2 or model_size_mb(schema, [c]) <= self.max_model_mb]

    def within(self, schema: Schema, model: Model, clique: Clique, limit_mb: float) -> bool:
        return model_size_mb(schema, [*model.potentials, tuple(clique)]) <= limit_mb


def expected_l1(sigma: float, cells: int) -> float:
    """Expected L1 norm of Gaussian noise."""
    return math.sqrt(2 / math.pi) * sigma * cells
