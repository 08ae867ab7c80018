"""Factor algebra on DataFrames: products are joins, reductions are aggregates.

A ``Frame`` is a wide DataFrame (integer attribute columns and ``value``) with its schema. Inputs are dense, so
products are inner equi-joins on the shared attributes, or outer products where nothing is shared (both
sides being model-sized cubes, whose cells the schema bounds before any job runs).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.noise import uniform
from ..plans.cliques import greedy_order, junction_tree
from ..plans.schema import Attrs, Schema, names
from ..storage import stored
from .cubes import cell, col, grid

NEG_INF = float("-inf")
#: Cells up to which a side of a product is broadcast.
SMALL = 1_000_000


def guarded_log(v: Column) -> Column:
    """Natural logarithm with log(0) = -inf."""
    return F.when(v > 0, F.log(v)).otherwise(F.lit(NEG_INF))


@dataclass(frozen=True)
class Frame:
    schema: Schema
    df: DataFrame

    @classmethod
    def constant(cls, like: DataFrame, schema: Schema, value: float) -> Frame:
        return cls(schema, grid(like, schema).select(*map(col, schema), F.lit(float(value)).alias("value")))

    @classmethod
    def random(cls, like: DataFrame, schema: Schema, seed: str = "factor") -> Frame:
        return cls(schema, grid(like, schema).select(*map(col, schema), uniform(seed, F.col("cell")).alias("value")))

    def _map(self, value: Column) -> Frame:
        return Frame(self.schema, self.df.select(*map(col, self.schema), value.alias("value")))

    # -- shape

    def transpose(self, attrs: Attrs) -> Frame:
        attrs = names(attrs)
        if sorted(attrs) != sorted(self.schema.attrs):
            raise ValueError("attributes must be a permutation of the factor's own")
        return Frame(self.schema.project(attrs), self.df.select(*map(col, attrs), "value"))

    def expand(self, schema: Schema) -> Frame:
        if not schema.contains(self.schema):
            raise ValueError("the new schema must hold all attributes")
        new = schema.marginalize(self.schema.attrs)
        out = self.df
        for a, n in new.config.items():  # a row per code, without a join
            out = out.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return Frame(schema, out.select(*map(col, schema), "value"))

    # -- reductions

    def reduce(self, how: Column, attrs: Attrs | None = None) -> Frame:
        rest = self.schema.marginalize(self.schema.attrs if attrs is None else attrs)
        return Frame(rest, self.df.groupBy(*map(col, rest)).agg(how.alias("value")))

    def sum(self, attrs: Attrs | None = None) -> Frame:
        return self.reduce(F.sum("value"), attrs)

    def max(self, attrs: Attrs | None = None) -> Frame:
        return self.reduce(F.max("value"), attrs)

    def logsumexp(self, attrs: Attrs | None = None) -> Frame:
        """Shifted by the largest value of each group; a group of -inf alone stays -inf."""
        rest = self.schema.marginalize(self.schema.attrs if attrs is None else attrs)
        top = F.max("value").over(Window.partitionBy(*map(col, rest)) if len(rest) else Window.partitionBy(F.lit(0)))
        shifted = self.df.withColumn("top", top).withColumn("e", F.when(F.col("top") == NEG_INF, 0.0).otherwise(F.exp(F.col("value") - F.col("top"))))
        out = shifted.groupBy(*map(col, rest), "top").agg(F.sum("e").alias("e"))
        return Frame(rest, out.select(*map(col, rest), F.when(F.col("top") == NEG_INF, F.lit(NEG_INF)).otherwise(F.col("top") + F.log("e")).alias("value")))

    def project(self, attrs: Attrs, log: bool = False) -> Frame:
        gone = self.schema.invert(self.schema.project(attrs).attrs)
        return (self.logsumexp(gone) if log else self.sum(gone)).transpose(attrs)

    # -- elementwise

    def exp(self) -> Frame:
        return self._map(F.exp("value"))

    def log(self) -> Frame:
        return self._map(guarded_log(F.col("value")))

    def normalize(self, total: float = 1.0, log: bool = False) -> Frame:
        one = (self.logsumexp() if log else self.sum()).df.withColumnRenamed("value", "whole")
        joined = self.df.join(F.broadcast(one))  # one row
        value = F.col("value") + F.log(F.lit(total)) - F.col("whole") if log else F.col("value") * total / F.col("whole")
        return Frame(self.schema, joined.select(*map(col, self.schema), value.alias("value")))

    # -- products

    def combine(self, other: Frame | float, how: Callable[[Column, Column], Column]) -> Frame:
        if not isinstance(other, Frame):
            return self._map(how(F.col("value"), F.lit(float(other))))
        both = self.schema.merge(other.schema)
        shared = list(self.schema.intersect(other.schema))
        right = other.df.withColumnRenamed("value", "__other")
        if other.schema.size() <= SMALL:
            right = F.broadcast(right)
        joined = self.df.join(right, shared) if shared else self.df.crossJoin(right)
        return Frame(both, joined.select(*map(col, both), how(F.col("value"), F.col("__other")).alias("value")))

    def __add__(self, other):
        return self.combine(other, lambda x, y: x + y)

    def __sub__(self, other):
        return self.combine(other, lambda x, y: x - y)

    def __mul__(self, other):
        return self.combine(other, lambda x, y: x * y)

    def __truediv__(self, other):
        """Zero where the divisor is zero."""
        return self.combine(other, lambda x, y: F.when(y != 0, F.try_divide(x, y)).otherwise(0.0))

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other: float) -> Frame:
        return self._map(F.lit(float(other)) - F.col("value"))

    def dot(self, other: Frame) -> DataFrame:
        if self.schema != other.schema:
            raise ValueError("schemas differ")
        return (self * other).df.agg(F.sum("value").alias("value"))

    # -- out

    def datavector(self) -> DataFrame:
        return self.df.select(cell(self.schema, self.schema.attrs).alias("cell"), "value").orderBy("cell")

    def supports(self, attrs: Attrs) -> bool:
        return self.schema.supports(attrs)

    def copy(self) -> Frame:
        return Frame(self.schema, self.df)

    def placed(self, *attrs: str) -> Frame:
        """Rows dealt by attributes, so that joins and aggregates on them need no further shuffle."""
        return Frame(self.schema, self.df.repartition(*map(col, attrs)))

    def __float__(self) -> float:
        if len(self.schema):
            raise ValueError("only a factor without attributes is a number")
        return float(self.df.first()["value"])


#: Semirings by name: how values combine in a product, and how they reduce when an attribute goes.
SEMIRINGS: Mapping[str, tuple[Callable, Callable]] = {
    "sum-product": (lambda x, y: x * y, lambda f, a: f.sum(a)),
    "max-plus": (lambda x, y: x + y, lambda f, a: f.max(a)),
    "min-max": (F.greatest, lambda f, a: f.reduce(F.min("value"), a)),
    "max-min": (F.least, lambda f, a: f.max(a)),
    "log-sum-exp": (lambda x, y: x + y, lambda f, a: f.logsumexp(a)),
}


def contraction(factors: Sequence[Frame], keep: Attrs, semiring: str = "sum-product") -> Frame:
    """Product of factors reduced onto ``keep``: joins in elimination order, each attribute aggregated away at once."""
    combine, reduce = SEMIRINGS[semiring]
    keep = names(keep)
    whole = factors[0].schema
    for f in factors[1:]:
        whole = whole.merge(f.schema)
    order, _ = greedy_order(whole, [f.schema.attrs for f in factors], eliminate=whole.invert(keep))
    pool = list(factors)
    for a in order:
        mine, pool = [f for f in pool if a in f.schema], [f for f in pool if a not in f.schema]
        made = mine[0]
        for f in mine[1:]:
            made = made.combine(f, combine)
        pool.append(reduce(made, [a]))
    out = pool[0]
    for f in pool[1:]:
        out = out.combine(f, combine)
    return out.transpose(keep)


def einsum(formula: str, *factors: Frame, semiring: str = "sum-product") -> Frame:
    """``'ab,bc->ac'``: letters rename the factors' attributes in order."""
    inputs, _, output = formula.replace(" ", "").partition("->")
    renamed = []
    for letters, f in zip(inputs.split(","), factors, strict=True):
        df = f.df.select(*[col(a).alias(x) for a, x in zip(f.schema.attrs, letters, strict=True)], "value")
        renamed.append(Frame(Schema(tuple(letters), f.schema.sizes), df))
    return contraction(renamed, tuple(output), semiring)


def belief_propagation(factors: Sequence[Frame], total: float = 1.0) -> list[Frame]:
    """Marginals on each factor's attributes of the product of exponentials, as join-aggregate plans.

    A message goes each way along every edge of a junction tree, a table in the shared folder, so no plan holds
    another message's plan. Factors are read once a message: take them from a stored collection of cells.
    """
    whole = Schema((), ())
    for f in factors:
        whole = whole.merge(f.schema)
    tree = junction_tree(whole, [f.schema.attrs for f in factors])
    cliques = tree.cliques or [()]
    held: list[list[Frame]] = [[] for _ in cliques]
    homes = [next(k for k, c in enumerate(cliques) if set(f.schema.attrs) <= set(c)) for f in factors]
    for home, f in zip(homes, factors, strict=True):
        held[home].append(f)
    sent: dict[tuple[int, int], Frame] = {}

    def pool(at: int, but: int | None = None) -> list[Frame]:
        return held[at] + [m for (a, b), m in sent.items() if b == at and a != but]

    for a, b in tree.messages:
        if known := pool(a, but=b):
            keep = [x for x in tree.separator(a, b) if any(x in f.schema for f in known)]
            m = contraction(known, keep, "log-sum-exp")
            sent[a, b] = Frame(m.schema, stored(m.df, "message"))
    return [contraction(pool(home), f.schema.attrs, "log-sum-exp").normalize(total, log=True).exp() for home, f in zip(homes, factors, strict=True)]
