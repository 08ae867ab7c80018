"""Privacy accounting and private selection, on the driver and as queries."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .noise import exponential, gumbel

# -- zero-concentrated differential privacy -------------------------------------------------------------


def delta_standard(rho: float, eps: float) -> float:
    """The usual tail bound of rho-zCDP; nothing leaks at rho 0."""
    if rho <= 0:
        return 0.0
    return math.exp(-((eps - rho) ** 2) / (4 * rho)) if eps > rho else 1.0


def best_order(rho: float, eps: float) -> tuple[float, float]:
    """The Renyi order a with the least bound on delta, as a - 1, and the logarithm of that bound.

    The bound's logarithm is (a - 1)(a rho - eps) + a log(1 - 1/a) - log(a - 1). Its slope
    (2a - 1) rho - eps + log(1 - 1/a) rises and is concave, so Newton steps from below never pass the root.
    Replacing log(1 - 1/a) by -1/a, which is larger, gives a quadratic whose root lies below.
    """
    linear = 3 * rho - eps
    u = (math.sqrt(linear**2 + 8 * rho * max(0.0, eps + 1 - rho)) - linear) / (4 * rho)
    u = max(u, 1e-12)
    for _ in range(200):
        slope = (2 * u + 1) * rho - eps - math.log1p(1 / u)
        step = -slope / (2 * rho + 1 / (u * (u + 1)))
        if not u + step > u:
            break
        u += step
    return u, u * ((u + 1) * rho - eps) - (u + 1) * math.log1p(1 / u) - math.log(u)


def delta_of(rho: float, eps: float) -> float:
    """Smallest delta that the best Renyi order gives rho-zCDP at ``eps``."""
    return 0.0 if rho <= 0 else min(1.0, math.exp(min(0.0, best_order(rho, eps)[1])))


def eps_of(rho: float, delta: float) -> float:
    """Smallest epsilon of rho-zCDP at ``delta``.

    The logarithm of delta is a least of lines in epsilon, of slopes 1 - a, so it is concave: Newton steps from the
    tail bound's epsilon, which is enough, go down and stay enough.
    """
    if delta >= 1 or rho <= 0:
        return 0.0
    goal, eps = math.log(delta), rho + 2 * math.sqrt(-rho * math.log(delta))
    for _ in range(200):
        u, log_delta = best_order(rho, eps)
        lower = eps - (goal - log_delta) / u
        if lower <= 0:
            return 0.0
        if not lower < eps:
            break
        eps = lower
    return eps


def rho_of(eps: float, delta: float) -> float:
    """Largest rho whose zCDP implies (eps, delta).

    In rho the logarithm of delta is a least of lines of slopes a (a - 1): Newton steps from the tail bound's rho,
    which is allowed, go up and stay allowed.
    """
    if delta >= 1 or eps <= 0:
        return 0.0
    goal = math.log(delta)
    rho = (math.sqrt(eps - goal) - math.sqrt(-goal)) ** 2
    for _ in range(200):
        u, log_delta = best_order(rho, eps)
        higher = rho + (goal - log_delta) / (u * (u + 1))
        if not higher > rho:
            break
        rho = higher
    return rho


class Ledger:
    """A zCDP budget that refuses to be overspent."""

    def __init__(self, rho: float):
        self.rho, self.used, self.entries = float(rho), 0.0, []

    @property
    def left(self) -> float:
        return max(0.0, self.rho - self.used)

    def spend(self, rho: float, what: str) -> None:
        if self.used + rho > self.rho * (1 + 1e-9):
            raise ValueError(f"{what} would spend {rho:g} of {self.left:g} left")
        self.used += rho
        self.entries.append((what, rho))

    def gaussian(self, sigma: float, sensitivity: float = 1.0, what: str = "gaussian") -> None:
        self.spend(sensitivity**2 / (2 * sigma**2), what)

    def selection(self, eps: float, what: str = "selection") -> None:
        self.spend(eps**2 / 8, what)


# -- noise scales ------------------------------------------------------------------------------------------


def laplace_scale(eps: float, l1_sensitivity: float, bounded: bool = False) -> float:
    return l1_sensitivity * (2 if bounded else 1) / eps


def gaussian_scale(eps: float, delta: float, l2_sensitivity: float, bounded: bool = False) -> float:
    """Smallest standard deviation that is (eps, delta)-private, by the exact Gaussian trade-off."""
    size = l2_sensitivity * (math.sqrt(2) if bounded else 1)
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))

    def loose(sigma: float) -> bool:
        a, b = size / (2 * sigma), eps * sigma / size
        tail = math.exp(eps) * phi(-a - b) if eps < 700 else 0.0
        return phi(a - b) - tail > delta

    high = size
    while loose(high):
        high *= 2
    low = high * 1e-9
    while low < (mid := (low + high) / 2) < high:
        low, high = (mid, high) if loose(mid) else (low, mid)
    return high


def best_noise(eps: float, delta: float, l1: float, l2: float, bounded: bool = False) -> tuple[str, float]:
    """The distribution of lower variance and its scale."""
    b = laplace_scale(eps, l1, bounded)
    if delta <= 0:
        return "laplace", b
    sigma = gaussian_scale(eps, delta, l2, bounded)
    return ("laplace", b) if 2 * b * b < sigma * sigma else ("gaussian", sigma)


# -- selection on the driver -----------------------------------------------------------------------------------


def _scored(qualities: Mapping | Sequence[float]) -> tuple[list, np.ndarray]:
    if isinstance(qualities, Mapping):
        return list(qualities), np.array([qualities[k] for k in qualities], float)
    return list(range(len(qualities))), np.asarray(qualities, float)


def exponential_mechanism(qualities: Mapping | Sequence[float], eps: float, sensitivity: float, rng: np.random.Generator, base: Mapping | None = None, monotonic: bool = False):
    """A key drawn in proportion to exp(quality * eps / (2 * sensitivity)) times the base measure.

    An infinite ``eps`` takes the best; a monotonic quality needs no factor of two.
    """
    keys, q = _scored(qualities)
    if math.isinf(eps):
        return keys[int(q.argmax())]
    s = (1.0 if monotonic else 0.5) * eps / sensitivity * (q - q.max())
    if base is not None:
        s = s + np.log([base[k] for k in keys])
    return keys[int((s + rng.gumbel(size=len(s))).argmax())]


def permute_and_flip(qualities: Mapping | Sequence[float], eps: float, sensitivity: float, rng: np.random.Generator):
    """Report the noisy maximum with exponential noise, which is the same distribution."""
    keys, q = _scored(qualities)
    return keys[int((0.5 * eps / sensitivity * q + rng.exponential(size=len(q))).argmax())]


def skyline(qualities: Sequence[float], sensitivities: Sequence[float]) -> list[int]:
    """Candidates that no other matches in both a quality as high and a sensitivity as low."""
    order = sorted(range(len(qualities)), key=lambda k: (sensitivities[k], -qualities[k], k))
    kept, best = [], -math.inf
    for k in order:
        if qualities[k] > best:
            kept.append(k)
            best = qualities[k]
    return sorted(kept)


def generalized_scores(qualities: Sequence[float], sensitivities: Sequence[float], t: float) -> np.ndarray:
    """Scores of sensitivity one for candidates of unequal sensitivities: how far each falls short of the skyline."""
    q, d = np.asarray(qualities, float), np.asarray(sensitivities, float)
    r = t * d - q
    rivals = skyline(q, d)
    return -((r[:, None] - r[rivals][None, :]) / (d[:, None] + d[rivals][None, :])).max(axis=1)


def generalized_exponential_mechanism(qualities: Mapping[object, float], sensitivities: Mapping[object, float], eps: float, rng: np.random.Generator, t: float | None = None, base: Mapping | None = None):
    keys = list(qualities)
    t = 2 * math.log(len(keys) / 0.5) / eps if t is None else t
    scores = generalized_scores([qualities[k] for k in keys], [sensitivities[k] for k in keys], t)
    return exponential_mechanism(dict(zip(keys, scores, strict=True)), eps, 1.0, rng, base)


# -- selection as queries ---------------------------------------------------------------------------------------


def select_one(candidates: DataFrame, key: str, quality: str, eps: float, sensitivity: float, seed: str, how: str = "gumbel") -> DataFrame:
    """One row: the key of the noisy maximum; an aggregate, so any number of candidates is one pass."""
    noise = {"gumbel": gumbel, "exponential": exponential}[how](seed, F.col(key))
    scored = candidates.withColumn("noisy", 0.5 * eps / sensitivity * F.col(quality) + noise)
    return scored.agg(F.max_by(key, "noisy").alias(key), F.max("noisy").alias("noisy"))


def select_top(candidates: DataFrame, key: str, quality: str, k: int, eps: float, sensitivity: float, seed: str) -> DataFrame:
    """The ``k`` largest noisy qualities."""
    return candidates.withColumn("noisy", 0.5 * eps / sensitivity * F.col(quality) + gumbel(seed, F.col(key))).orderBy(F.desc("noisy"), key).limit(k)


def skyline_rows(candidates: DataFrame, quality: str = "quality", sensitivity: str = "sensitivity") -> DataFrame:
    """Rows that no row beats: the best quality of each sensitivity, kept where it exceeds all lower sensitivities' best.

    Rows are first reduced to one per sensitivity, and the running best goes over those alone.
    """
    from pyspark.sql import Window

    best = candidates.groupBy(sensitivity).agg(F.max(quality).alias("__best"))
    below = Window.orderBy(sensitivity).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("__below", F.max("__best").over(below)).where(F.col("__below").isNull() | (F.col("__best") > F.col("__below")))
    kept = kept.select(F.col(sensitivity).alias("__s"), "__best")
    return candidates.join(F.broadcast(kept), (F.col(sensitivity) == F.col("__s")) & (F.col(quality) == F.col("__best")), "left_semi")
