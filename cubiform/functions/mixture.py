"""A mixture of product distributions fitted to a loss by Adam, with its analytic gradient."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import Attrs, Schema, names
from .kernels import Cliques, Factor
from .losses import Loss
from .noise import uniform


@dataclass
class Mixture:
    """``tables[attr]`` holds a distribution over codes for each component."""

    schema: Schema
    tables: dict[str, np.ndarray]
    total: float

    @property
    def components(self) -> int:
        return len(next(iter(self.tables.values())))

    def supports(self, attrs: Attrs) -> bool:
        return self.schema.supports(attrs)

    def project(self, attrs: Attrs) -> Factor:
        attrs = names(attrs)
        made = np.full((self.components, 1), self.total / self.components)
        for a in attrs:
            made = (made[:, :, None] * self.tables[a][:, None, :]).reshape(self.components, -1)
        return Factor(self.schema.project(attrs), made.sum(axis=0))

    def datavector(self) -> np.ndarray:
        return self.project(self.schema.attrs).datavector()

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(component, attr, code, p)``."""
        rows = [(k, a, c, float(p)) for a, t in self.tables.items() for k in range(len(t)) for c, p in enumerate(t[k])]
        return spark.createDataFrame(rows, "component int, attr string, code int, p double")

    def synthetic(self, spark: SparkSession, rows: int | None = None, seed: str = "mixture") -> DataFrame:
        """Rows dealt to components in turn; columns independent given the component."""
        n = max(1, int(self.total if rows is None else rows))
        df = spark.range(n).withColumn("component", (F.col("id") % self.components).cast("int"))
        for a, t in self.tables.items():
            cum = pa.table({"component": np.arange(len(t), dtype=np.int32), "ends": pa.array(np.cumsum(t, axis=1).tolist())})
            df = df.join(F.broadcast(spark.createDataFrame(cum)), "component")  # a row per component
            u = uniform(f"{seed}:{a}", F.col("id"))
            code = F.least(F.size(F.filter("ends", lambda e: e <= u)), F.lit(self.schema[a] - 1))  # noqa: B023
            df = df.withColumn(a, code.cast("int")).drop("ends")
        return df.select(*[F.col(f"`{a}`").alias(a, metadata={"cardinality": s}) for a, s in self.schema.config.items()])


def fit_mixture(schema: Schema, loss: Loss, known_total: float, components: int = 100, iters: int = 2500, rate: float = 1.0, seed: int = 0) -> Mixture:
    rng = np.random.default_rng(seed)
    theta = {a: rng.normal(0, 0.25, (components, n)) for a, n in schema.config.items()}
    first = {a: np.zeros_like(t) for a, t in theta.items()}
    second = {a: np.zeros_like(t) for a, t in theta.items()}

    def soft(t: np.ndarray) -> np.ndarray:
        e = np.exp(t - t.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for step in range(1, iters + 1):
        m = Mixture(schema, {a: soft(t) for a, t in theta.items()}, known_total)
        _, g = loss.of(Cliques(schema, {c: m.project(c) for c in loss.cliques}))
        back = {a: np.zeros_like(t) for a, t in theta.items()}
        for c, f in g.items():
            for k, a in enumerate(c):
                v = f.values[None] * (known_total / components)
                for j in reversed(range(len(c))):
                    if j != k:
                        w = m.tables[c[j]].reshape(components, *[len(m.tables[c[j]][0]) if i == j else 1 for i in range(j + 1)])
                        rest = [1] * (v.ndim - 1 - (j + 1))
                        v = (v * w.reshape(*w.shape, *rest)).sum(axis=j + 1, keepdims=True)
                back[a] += v.reshape(components, -1)
        for a, t in theta.items():
            p = m.tables[a]
            d = p * (back[a] - (p * back[a]).sum(axis=1, keepdims=True))
            first[a] = 0.9 * first[a] + 0.1 * d
            second[a] = 0.999 * second[a] + 0.001 * d * d
            theta[a] = t - rate * (first[a] / (1 - 0.9**step)) / (np.sqrt(second[a] / (1 - 0.999**step)) + 1e-8)
    return Mixture(schema, {a: soft(t) for a, t in theta.items()}, known_total)
