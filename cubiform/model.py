"""A fitted model: answers any marginal, many at once on the cluster, and is kept as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.kernels import Cliques, Factor, variable_elimination
from .operators.cubes import codes
from .plans.cliques import Clique
from .plans.schema import Attrs, Schema, names


def factor_frame(spark: SparkSession, factor: Factor) -> DataFrame:
    """A dense factor as a wide table."""
    table = pa.table({"cell": np.arange(factor.values.size), "value": factor.values.ravel()})
    return spark.createDataFrame(table).select(*codes(factor.schema, factor.schema.attrs), "value")


def long_frame(spark: SparkSession, factors: Cliques) -> DataFrame:
    """``(clique_id, cell, value)`` of a vector of factors, cliques numbered in order."""
    sizes = [f.values.size for f in factors.values()]
    table = pa.table({
        "clique_id": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes),
        "cell": np.concatenate([np.arange(n) for n in sizes]) if sizes else np.empty(0, np.int64),
        "value": np.concatenate([f.values.ravel() for f in factors.values()]) if sizes else np.empty(0),
    })
    return spark.createDataFrame(table, "clique_id int, cell long, value double")


@dataclass
class Model:
    """Potentials and marginals by clique, and a total."""

    schema: Schema
    potentials: Cliques
    marginals: Cliques
    total: float

    def supports(self, attrs: Attrs) -> bool:
        return self.schema.supports(attrs)

    def project(self, attrs: Attrs) -> Factor:
        """From a stored marginal where one holds the attributes, else by elimination."""
        attrs = names(attrs)
        if attrs and self.marginals.supports(attrs):
            return self.marginals.project(attrs)
        return variable_elimination(self.potentials, attrs, self.total)

    factor = project

    def datavector(self, attrs: Attrs | None = None) -> np.ndarray:
        return self.project(self.schema.attrs if attrs is None else attrs).datavector()

    def frame(self, spark: SparkSession, attrs: Attrs) -> DataFrame:
        return factor_frame(spark, self.project(attrs))

    def bulk(self, spark: SparkSession, cliques: Sequence[Clique]) -> DataFrame:
        """``(clique_id, cell, value)`` of many marginals, answered on the executors from the broadcast model."""
        cliques = [names(c) for c in cliques]
        sent = spark.sparkContext.broadcast((self, cliques))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, cliques = sent.value
            for b in batches:
                for k in b.column(0).to_pylist():
                    v = model.project(cliques[k]).datavector()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v))), pa.array(v)], names=["clique_id", "cell", "value"])

        parts = max(1, min(len(cliques), spark.sparkContext.defaultParallelism))
        return spark.range(0, len(cliques), 1, parts).mapInArrow(run, "clique_id int, cell long, value double")

    def synthetic(self, spark: SparkSession, rows: int | None = None, method: str = "round", seed: str = "synth") -> DataFrame:
        from .operators.synth import synthesize

        return synthesize(spark, self, rows, method, seed)

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"schema": self.schema.config, "cliques": [list(c) for c in self.potentials], "marginals": [list(c) for c in self.marginals], "total": self.total}
        long_frame(spark, self.potentials).write.mode("overwrite").parquet(f"{path}/potentials")
        long_frame(spark, self.marginals).write.mode("overwrite").parquet(f"{path}/marginals")
        spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        from .operators.cubes import vectors

        meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/meta", wholetext=True).collect()))
        schema = Schema.of(meta["schema"])

        def read(name: str, cliques: list[list[str]]) -> Cliques:
            cliques = [tuple(c) for c in cliques]
            got = vectors(spark.read.parquet(f"{path}/{name}"), cliques, schema)
            return Cliques(schema, {c: Factor(schema.project(c), v) for c, v in zip(cliques, got, strict=True)})

        return cls(schema, read("potentials", meta["cliques"]), read("marginals", meta["marginals"]), meta["total"])
