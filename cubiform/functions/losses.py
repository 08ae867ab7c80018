"""Losses of marginals against measurements, with hand-written gradients, and totals from measurements."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cliques import Clique, maximal_subset
from ..plans.schema import Schema
from .kernels import Cliques, Factor


@dataclass(frozen=True)
class Measurement:
    """A noisy vector ``y`` of a linear query of one clique's marginal; ``matrix`` None is the marginal itself."""

    y: np.ndarray
    clique: Clique
    stddev: float = 1.0
    matrix: np.ndarray | None = None

    def __post_init__(self):
        object.__setattr__(self, "y", np.asarray(self.y, float).ravel())
        object.__setattr__(self, "clique", tuple(self.clique))

    def answer(self, marginal: Factor) -> np.ndarray:
        v = marginal.values.ravel()
        return v if self.matrix is None else self.matrix @ v

    def back(self, answers: np.ndarray) -> np.ndarray:
        return answers if self.matrix is None else self.matrix.T @ answers


@dataclass(frozen=True)
class Loss:
    """A loss over the marginals of ``cliques``; ``of`` gives its value and gradient."""

    cliques: list[Clique]
    of: Callable[[Cliques], tuple[float, Cliques]]
    lipschitz: float | None = None
    measurements: Sequence[Measurement] = field(default=())

    def __call__(self, marginals: Cliques) -> float:
        return self.of(marginals)[0]


def _lift(gradient: np.ndarray, clique: Clique, home: Schema) -> np.ndarray:
    """A gradient on a clique, as values to add on its home clique."""
    return Factor(home.project(clique), gradient)._spread(home)


def linear_loss(measurements: Sequence[Measurement], schema: Schema | None = None, norm: str = "l2", normalize: bool = False) -> Loss:
    """L2: sum of squared errors over twice the standard deviation; L1: absolute errors over it.

    ``normalize`` divides by the number of measurements and the marginals' total, and takes the root for L2.
    """
    if norm not in ("l1", "l2"):
        raise ValueError(f"unknown norm {norm}")
    cliques = maximal_subset([m.clique for m in measurements])
    homes = [next(c for c in cliques if set(m.clique) <= set(c)) for m in measurements]

    def of(marginals: Cliques) -> tuple[float, Cliques]:
        value, total = 0.0, 1.0
        grad = {c: np.zeros(marginals[c].values.shape) for c in marginals}
        if normalize and measurements:
            total = float(marginals[next(iter(marginals))].values.sum())
        for m, home in zip(measurements, homes, strict=True):
            owner = home if home in marginals else marginals.parent(home)
            off = m.answer(marginals[owner].project(m.clique)) - m.y
            if norm == "l2":
                value += float(off @ off) / (2 * m.stddev)
                d = off / m.stddev
            else:
                value += float(np.abs(off).sum()) / m.stddev
                d = np.sign(off) / m.stddev
            grad[owner] = grad[owner] + _lift(m.back(d), m.clique, marginals[owner].schema)
        scale = 1.0
        if normalize and measurements:
            value, scale = value / (len(measurements) * total), 1 / (len(measurements) * total)
            if norm == "l2":
                value = float(np.sqrt(value))
                scale = scale / (2 * value) if value > 0 else 0.0
        return value, Cliques(marginals.schema, {c: Factor(marginals[c].schema, g * scale) for c, g in grad.items()})

    bound = None
    if norm == "l2" and not normalize and schema is not None and measurements:
        bound = l2_lipschitz(measurements, cliques, homes, schema)
    return Loss(cliques, of, bound, tuple(measurements))


def l2_lipschitz(measurements: Sequence[Measurement], cliques: Sequence[Clique], homes: Sequence[Clique], schema: Schema, steps: int = 50) -> float:
    """Largest eigenvalue of the L2 loss's Hessian, by power iteration."""
    v = Cliques.ones(schema, cliques)
    v = v * (1 / np.sqrt(v.dot(v)))
    size = 0.0
    for _ in range(steps):
        out = {c: np.zeros(v[c].values.shape) for c in v}
        for m, home in zip(measurements, homes, strict=True):
            answer = m.answer(v[home].project(m.clique))
            out[home] = out[home] + _lift(m.back(answer) / m.stddev, m.clique, v[home].schema)
        v = Cliques(schema, {c: Factor(v[c].schema, x) for c, x in out.items()})
        size = float(np.sqrt(v.dot(v)))
        v = v * (1 / size)
    return size


def primal_feasibility(marginals: Cliques) -> float:
    """Mean disagreement of pairs of cliques on what they share: L1 over the mean of their totals."""
    gaps, cliques = [], list(marginals)
    for i, a in enumerate(cliques):
        for b in cliques[i + 1 :]:
            shared = tuple(x for x in a if x in b)
            if shared:
                x, y = marginals[a].project(shared).values, marginals[b].project(shared).values
                gaps.append(np.abs(x - y).sum() / (0.5 * x.sum() + 0.5 * y.sum()))
    return float(np.mean(gaps)) if gaps else 0.0


def estimated_total(measurements: Sequence[Measurement]) -> float:
    """Inverse-variance mean of the totals that measurements tell, at least 1.

    A query tells the total if some weights of its rows add up to one for every cell: for a marginal itself, one for
    each cell; else the shortest such weights, by least squares.
    """
    told, precision = 0.0, 0.0
    for m in measurements:
        rows = np.ones(len(m.y))
        if m.matrix is not None and not np.allclose(m.matrix.sum(axis=0), 1):
            rows = np.linalg.lstsq(m.matrix.T, np.ones(m.matrix.shape[1]), rcond=None)[0]
            if not np.allclose(m.matrix.T @ rows, 1):
                continue
        spread = m.stddev**2 * float(rows @ rows)
        if spread > 0:
            told, precision = told + float(rows @ m.y) / spread, precision + 1 / spread
    return max(1.0, told / precision) if precision else 1.0


def total_estimate(answers: DataFrame, headers: DataFrame) -> DataFrame:
    """The same on tables: ``answers (m_id, i, y)`` and ``headers (m_id, stddev)`` of identity measurements."""
    each = answers.groupBy("m_id").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    weighed = each.join(headers, "m_id").withColumn("w", 1 / (F.col("stddev") ** 2 * F.col("n")))
    return weighed.agg(F.greatest(F.lit(1.0), F.coalesce(F.sum(F.col("w") * F.col("s")) / F.sum("w"), F.lit(1.0))).alias("total"))


def l2_term(stddev: Column) -> Column:
    """One cell's share of the L2 loss, over columns ``value`` and ``y``."""
    return (F.col("value") - F.col("y")) ** 2 / (2 * stddev)


def l1_term(stddev: Column) -> Column:
    return F.abs(F.col("value") - F.col("y")) / stddev
