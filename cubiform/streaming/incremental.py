"""Marginals kept up to date over a stream of encoded records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cubes import cell, schema_of
from ..plans.cliques import Clique
from ..plans.schema import Schema


def running_marginals(stream: DataFrame, cliques: Sequence[Clique], schema: Schema | None = None) -> DataFrame:
    """``(clique_id, cell, value)`` of all rows so far; for output modes complete and update."""
    schema = schema or schema_of(stream)
    rows = F.array(*[F.struct(F.lit(k).alias("clique_id"), cell(schema, c).alias("cell")) for k, c in enumerate(cliques)])
    return stream.select(F.explode(rows).alias("r")).groupBy("r.clique_id", "r.cell").agg(F.count(F.lit(1)).cast("double").alias("value"))


def windowed_marginals(stream: DataFrame, clique: Clique, time: str, width: str, late: str, schema: Schema | None = None) -> DataFrame:
    """``(start, cell, value)`` per tumbling window; rows later than ``late`` are left out, as the watermark does."""
    schema = schema or schema_of(stream)
    rows = stream.withWatermark(time, late).select(F.col(time), cell(schema, clique).alias("cell"))
    counted = rows.groupBy(F.window(time, width), "cell").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "cell", "value")
