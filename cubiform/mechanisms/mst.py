"""Spanning-tree mechanism: one-way marginals, a private spanning tree of pairs, and those pairs' marginals."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fit import mirror_descent
from ..functions.losses import Measurement
from ..functions.noise import uniform
from ..functions.privacy import exponential_mechanism
from ..model import Model
from ..operators.cubes import col, schema_of
from ..plans.cliques import Clique
from ..plans.schema import Schema
from .base import Answers, Mechanism


class Compression:
    """Rare codes of each attribute merged into one last code, from noisy one-way counts."""

    def __init__(self, schema: Schema, measurements: list[Measurement], sigmas: float = 3.0):
        self.full = schema
        self.kept: dict[str, np.ndarray] = {}
        for m in measurements:
            (a,) = m.clique
            self.kept[a] = np.flatnonzero(m.y >= sigmas * m.stddev)
        sizes = {a: len(self.kept[a]) + (len(self.kept[a]) < n) if a in self.kept else n for a, n in schema.config.items()}
        self.schema = Schema.of(sizes)

    def table(self, attr: str) -> list[int]:
        """Old code -> new code."""
        kept = self.kept.get(attr)
        if kept is None:
            return list(range(self.full[attr]))
        to = np.full(self.full[attr], len(kept))
        to[kept] = np.arange(len(kept))
        return to.tolist()

    def measurement(self, m: Measurement) -> Measurement:
        """One-way measurement on the merged codes; the tail is summed and weighted to keep its noise."""
        (a,) = m.clique
        kept = self.kept[a]
        tail = np.setdiff1d(np.arange(len(m.y)), kept)
        if not len(tail):
            return Measurement(m.y[kept], m.clique, m.stddev)
        scale = 1 / math.sqrt(len(tail))
        matrix = np.eye(len(kept) + 1)
        matrix[-1, -1] = scale
        return Measurement(np.append(m.y[kept], m.y[tail].sum() * scale), m.clique, m.stddev, matrix)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.get(F.array(*map(F.lit, self.table(a))), col(a)).cast("int").alias(a, metadata={"cardinality": n}) for a, n in self.schema.config.items()])

    def undo(self, df: DataFrame, seed: str = "undo") -> DataFrame:
        """Original codes; a merged code becomes one of its members at random. Needs no other column than the attributes."""
        df = df.withColumn("__row", F.monotonically_increasing_id())
        out = []
        for a, n in self.full.config.items():
            kept = self.kept.get(a)
            if kept is None:
                out.append(col(a).alias(a, metadata={"cardinality": n}))
                continue
            tail = [int(x) for x in np.setdiff1d(np.arange(n), kept)]
            own = F.get(F.array(*map(F.lit, [int(x) for x in kept] or [0])), col(a))
            if tail:
                pick = F.get(F.array(*map(F.lit, tail)), F.floor(uniform(f"{seed}:{a}", F.col("__row")) * len(tail)).cast("int"))
                own = F.when(col(a) >= len(kept), pick).otherwise(own)
            out.append(own.cast("int").alias(a, metadata={"cardinality": n}))
        return df.select(*out)


class MST(Mechanism):
    """A third of the budget each for one-way marginals, the tree and the pairs."""

    def select(self, answers: Answers, model: Model, rho: float, attrs: list[str]) -> list[Clique]:
        """A spanning tree drawn edge by edge, preferring pairs the model answers worst."""
        pairs = {c: float(np.abs(answers[c] - model.project(c).datavector()).sum()) for c in combinations(attrs, 2)}
        group = {a: a for a in attrs}
        picked: list[Clique] = []
        if len(attrs) < 2:
            return picked
        eps = math.sqrt(8 * rho / (len(attrs) - 1))
        while len(picked) < len(attrs) - 1:
            open_ = {c: v for c, v in pairs.items() if group[c[0]] != group[c[1]]}
            self.ledger.selection(eps, "tree edge")
            a, b = exponential_mechanism(open_, eps, 1.0, self.rng)
            picked.append((a, b))
            old, new = group[a], group[b]
            group = {k: new if v == old else v for k, v in group.items()}
        return picked

    def run(self, df: DataFrame, rows: int | None = None) -> tuple[Model, DataFrame]:
        """The fitted model on merged codes, and synthetic rows with the original ones."""
        schema = schema_of(df)
        rho = self.ledger.rho
        sigma = math.sqrt(3 / (2 * rho))
        singles = [(a,) for a in schema]
        self.measure(Answers(df, singles), singles, sigma)
        merged = Compression(schema, self.measurements)
        self.measurements = [merged.measurement(m) for m in self.measurements]
        small = merged.apply(df)
        pairs = list(combinations(merged.schema.attrs, 2))
        answers = Answers(small, pairs)
        first = mirror_descent(merged.schema, self.measurements, iters=self.iters)
        tree = self.select(answers, first, rho / 3, list(merged.schema.attrs))
        if tree:
            self.measure(answers, tree, sigma)
        model = self.fitted(merged.schema)
        return model, merged.undo(model.synthetic(df.sparkSession, rows))
