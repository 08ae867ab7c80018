"""Public rows re-weighted so that their weighted marginals fit measurements: mirror descent on rows.

Each step is one distributed job: the rows' weighted marginals are counted in one pass, the loss's gradient
on those cells is worked out on the driver (a table of the model's size) and broadcast, and every row's weight is
multiplied by the exponential of the summed gradient at its own cells. Rows never leave the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Cliques, Factor
from ..functions.losses import Loss
from ..storage import stored
from .cubes import cell, col, multi, schema_of, vectors


def weighted_marginals(rows: DataFrame, cliques: list, weight: str = "weight") -> Cliques:
    schema = schema_of(rows)
    got = vectors(multi(rows, cliques, weight, schema), cliques, schema)
    return Cliques(schema, {c: Factor(schema.project(c), v) for c, v in zip(cliques, got, strict=True)})


def shifted(rows: DataFrame, gradient: Cliques, step: float, weight: str = "weight") -> DataFrame:
    """``rows`` with ``log_weight`` moved against the gradient at each row's cells."""
    schema = schema_of(rows)
    move = F.lit(0.0)
    for c, f in gradient.items():
        table = F.array(*[F.lit(float(x)) for x in f.values.ravel()]) if f.values.size <= 64 else None
        if table is not None:
            move = move + F.get(table, cell(schema, c).cast("int"))
        else:
            values = rows.sparkSession.createDataFrame(_table(f.values.ravel()))
            key = f"__g{abs(hash(c))}"
            rows = rows.withColumn(key, cell(schema, c)).join(F.broadcast(values.select(F.col("cell").alias(key), F.col("g").alias(f"{key}v"))), key)
            move = move + F.col(f"{key}v")
    keep = [*schema.attrs, "log_weight"]
    return rows.withColumn("log_weight", F.col("log_weight") - step * move).select(*map(col, keep))


def _table(values: np.ndarray):
    import pyarrow as pa

    return pa.table({"cell": np.arange(len(values)), "g": values})


def _normalized(rows: DataFrame, total: float) -> DataFrame:
    top = rows.agg(F.max("log_weight")).first()[0]
    mass = rows.agg(F.sum(F.exp(F.col("log_weight") - top))).first()[0]
    return rows.withColumn("weight", F.exp(F.col("log_weight") - top) * (total / mass))


def public_support(public: DataFrame, loss: Loss, total: float, iters: int = 250, every: int = 10) -> DataFrame:
    """``public`` with a ``weight`` that sums to ``total``; step sizes double until one fails and halve whenever one does."""
    schema = schema_of(public)
    rows = public.select(*[col(a).alias(a, metadata={"cardinality": n}) for a, n in schema.config.items()], F.lit(0.0).alias("log_weight"))
    rows = stored(rows, "public")
    rows = rows.select(*[col(a).alias(a, metadata={"cardinality": n}) for a, n in schema.config.items()], "log_weight")
    now = _normalized(rows, total)
    mu = weighted_marginals(now, loss.cliques)
    value, gradient = loss.of(mu)
    step, growing, taken = 1.0 / total, True, 0
    for _ in range(iters):
        tried = shifted(rows, gradient, step)
        tried = tried.select(*[col(a).alias(a, metadata={"cardinality": n}) for a, n in schema.config.items()], "log_weight")
        new = _normalized(tried, total)
        new_mu = weighted_marginals(new, loss.cliques)
        new_value, new_gradient = loss.of(new_mu)
        if value - new_value >= 0.5 * gradient.dot(mu - new_mu):
            rows, mu, value, gradient = tried, new_mu, new_value, new_gradient
            step *= 2 if growing else 1.0
            taken += 1
            if taken % every == 0:
                rows = stored(rows, "public")
                rows = rows.select(*[col(a).alias(a, metadata={"cardinality": n}) for a, n in schema.config.items()], "log_weight")
        else:
            step, growing = step * 0.5, False
    out = _normalized(rows, total)
    return out.select(*[col(a).alias(a, metadata={"cardinality": n}) for a, n in schema.config.items()], "weight")
