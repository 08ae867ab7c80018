"""Vectors of factors by clique as one long table ``(clique_id, cell, value)``: a vector space on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.noise import uniform
from ..plans.cliques import Clique
from ..plans.schema import Attrs, Schema, names
from ..storage import stored
from .cubes import filled, multi, schema_of
from .factors import NEG_INF, Frame, guarded_log

KEY = ["clique_id", "cell"]


def remapped(schema: Schema, source: Clique, target: Clique) -> Column:
    """The cell of ``target``, a part of ``source``, from ``cell`` of ``source``."""
    part = schema.project(source)
    strides = dict(zip(source, part.strides(), strict=True))
    number = F.lit(0).cast("long")
    for a, stride in zip(target, schema.strides(target), strict=True):
        number = number + F.floor(F.col("cell") / strides[a]) % schema[a] * stride
    return number.cast("long")


@dataclass(frozen=True)
class Long:
    """Cliques in order, numbered by place, and their cells."""

    schema: Schema
    cliques: tuple[Clique, ...]
    df: DataFrame

    def __post_init__(self):
        object.__setattr__(self, "cliques", tuple(names(c) for c in self.cliques))
        if len(set(self.cliques)) != len(self.cliques):
            raise ValueError("cliques must be unique")

    @classmethod
    def measured(cls, records: DataFrame, cliques: Sequence[Clique], weight: str | None = None) -> Long:
        schema = schema_of(records)
        return cls(schema, tuple(cliques), filled(multi(records, cliques, weight), cliques, schema))

    @classmethod
    def constant(cls, like: DataFrame, schema: Schema, cliques: Sequence[Clique], value: float = 0.0) -> Long:
        none = like.sparkSession.createDataFrame([], "clique_id int, cell long, value double")
        return cls(schema, tuple(cliques), filled(none, cliques, schema).withColumn("value", F.lit(float(value))))

    @classmethod
    def random(cls, like: DataFrame, schema: Schema, cliques: Sequence[Clique], seed: str = "vector") -> Long:
        key = F.concat_ws(":", F.col("clique_id").cast("string"), F.col("cell").cast("string"))
        return cls.constant(like, schema, cliques)._map(uniform(seed, key))

    def stored(self) -> Long:
        """The same collection as a table in the shared folder, so that its factors read cells, not what was counted."""
        return Long(self.schema, self.cliques, stored(self.df, "cells"))

    def _map(self, value: Column) -> Long:
        return Long(self.schema, self.cliques, self.df.select(*KEY, value.alias("value")))

    @property
    def active(self) -> Schema:
        return self.schema.project(self.schema.canonical({a for c in self.cliques for a in c}))

    def cells(self) -> int:
        return sum(self.schema.size(c) for c in self.cliques)

    def parent(self, clique: Clique) -> int | None:
        return next((k for k, c in enumerate(self.cliques) if set(clique) <= set(c)), None)

    def supports(self, clique: Clique) -> bool:
        return self.parent(names(clique)) is not None

    def factor(self, k: int) -> Frame:
        """One clique's cube, wide."""
        from .cubes import codes

        c = self.cliques[k]
        return Frame(self.schema.project(c), self.df.where(F.col("clique_id") == k).select(*codes(self.schema, c), "value"))

    def replaced(self, k: int, frame: Frame) -> Long:
        from .cubes import cell

        new = frame.df.select(F.lit(k).alias("clique_id"), cell(self.schema, self.cliques[k]).alias("cell"), "value")
        return Long(self.schema, self.cliques, self.df.where(F.col("clique_id") != k).unionByName(new))

    def project(self, clique: Attrs, log: bool = False) -> Frame:
        clique = names(clique)
        home = self.parent(clique)
        if home is None:
            raise ValueError(f"{clique} is inside no clique")
        return self.factor(home).project(clique, log)

    def _moved(self, pairs: list[tuple[int, int, Clique, Clique]]) -> DataFrame:
        """Rows of clique ``a`` as cells of clique ``b`` for pairs ``(a, b, source, target)`` where target is in source."""
        rows = [F.when(F.col("clique_id") == a, F.struct(F.lit(b).alias("clique_id"), remapped(self.schema, s, t).alias("cell"))) for a, b, s, t in pairs]
        listed = F.filter(F.array(*rows), lambda r: r.isNotNull())
        return self.df.select(F.explode(listed).alias("r"), "value").select("r.clique_id", "r.cell", "value")

    def contract(self, cliques: Sequence[Clique], log: bool = False) -> Long:
        """Many parts in one pass, each from the first clique that holds it."""
        cliques = [names(c) for c in cliques]
        pairs = []
        for b, c in enumerate(cliques):
            a = self.parent(c)
            if a is None:
                raise ValueError(f"{c} is inside no clique")
            pairs.append((a, b, self.cliques[a], c))
        moved = self._moved(pairs)
        if not log:
            return Long(self.schema, tuple(cliques), moved.groupBy(*KEY).agg(F.sum("value").alias("value")))
        top = F.max("value").over(Window.partitionBy(*KEY))
        shifted = moved.withColumn("top", top).withColumn("e", F.when(F.col("top") == NEG_INF, 0.0).otherwise(F.exp(F.col("value") - F.col("top"))))
        out = shifted.groupBy(*KEY, "top").agg(F.sum("e").alias("e"))
        value = F.when(F.col("top") == NEG_INF, F.lit(NEG_INF)).otherwise(F.col("top") + F.log("e"))
        return Long(self.schema, tuple(cliques), out.select(*KEY, value.alias("value")))

    def expand(self, cliques: Sequence[Clique]) -> Long:
        """Each factor added to the first new clique that contains it; factors that none contains are dropped."""
        cliques = [names(c) for c in cliques]
        base = Long.constant(self.df, self.schema, cliques).df
        spread = None
        for a, c in enumerate(self.cliques):
            home = next((b for b, m in enumerate(cliques) if set(c) <= set(m)), None)
            if home is None:
                continue
            target = base.where(F.col("clique_id") == home).select("clique_id", "cell", F.lit(a).alias("__from"), remapped(self.schema, cliques[home], c).alias("__cell"))
            spread = target if spread is None else spread.unionByName(target)
        if spread is None:
            return Long(self.schema, tuple(cliques), base)
        own = self.df.select(F.col("clique_id").alias("__from"), F.col("cell").alias("__cell"), "value")
        added = spread.join(own, ["__from", "__cell"]).groupBy(*KEY).agg(F.sum("value").alias("v"))
        return Long(self.schema, tuple(cliques), base.join(added, KEY, "left").select(*KEY, F.coalesce("v", "value").alias("value")))

    def normalize(self, total: float = 1.0, log: bool = True) -> Long:
        group = Window.partitionBy("clique_id")
        if not log:
            return self._map(F.col("value") * total / F.sum("value").over(group))
        top = F.max("value").over(group)
        shifted = self.df.withColumn("top", top).withColumn("lse", F.log(F.sum(F.exp(F.col("value") - F.col("top"))).over(group)) + F.col("top"))
        return Long(self.schema, self.cliques, shifted.select(*KEY, (F.col("value") + F.log(F.lit(total)) - F.col("lse")).alias("value")))

    def exp(self) -> Long:
        return self._map(F.exp("value"))

    def log(self) -> Long:
        return self._map(guarded_log(F.col("value")))

    def _with(self, other: Long | float, how: Callable[[Column, Column], Column]) -> Long:
        if not isinstance(other, Long):
            return self._map(how(F.col("value"), F.lit(float(other))))
        if self.cliques != other.cliques:
            raise ValueError("clique lists differ")
        joined = self.df.join(other.df.withColumnRenamed("value", "__other"), KEY)
        return Long(self.schema, self.cliques, joined.select(*KEY, how(F.col("value"), F.col("__other")).alias("value")))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other: float):
        return self._with(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def dot(self, other: Long) -> DataFrame:
        return self._with(other, lambda a, b: a * b).df.agg(F.sum("value").alias("value"))

    def placed(self) -> Long:
        return Long(self.schema, self.cliques, self.df.repartition("clique_id"))


def feasibility(vector: Long) -> DataFrame:
    """Mean disagreement of pairs of cliques on what they share, as one row."""
    pairs = []
    for i, a in enumerate(vector.cliques):
        for b in vector.cliques[i + 1 :]:
            shared = tuple(x for x in a if x in b)
            if shared:
                pairs.append((i, vector.cliques.index(b), a, b, shared))
    if not pairs:
        return vector.df.sparkSession.range(1).select(F.lit(0.0).alias("value"))
    left = vector._moved([(i, k, a, s) for k, (i, _, a, _, s) in enumerate(pairs)]).groupBy(*KEY).agg(F.sum("value").alias("x"))
    right = vector._moved([(j, k, b, s) for k, (_, j, _, b, s) in enumerate(pairs)]).groupBy(*KEY).agg(F.sum("value").alias("y"))
    gap = left.join(right, KEY).groupBy("clique_id").agg((F.sum(F.abs(F.col("x") - F.col("y"))) / (0.5 * F.sum("x") + 0.5 * F.sum("y"))).alias("g"))
    return gap.agg(F.avg("g").alias("value"))
