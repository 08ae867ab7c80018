"""Contingency tables (cubes) of encoded records: one job for any number of marginals.

Long form of a collection: ``(clique_id, cell, value)``, the cell being the row-major number over the
clique's attributes in the clique's own order. Wide form of one cube: a column per attribute and ``value``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cliques import Clique
from ..plans.schema import Attrs, Schema, names

#: Cells up to which each task counts into a dense array of its own.
DENSE_CELLS = 4_000_000


def col(attr: str) -> Column:
    return F.col(f"`{attr}`")


def schema_of(df: DataFrame) -> Schema:
    return Schema.from_struct(df.schema)


def cell(schema: Schema, attrs: Attrs) -> Column:
    """Row-major cell number over ``attrs``."""
    number = F.lit(0).cast("long")
    for a, stride in zip(names(attrs), schema.strides(attrs), strict=True):
        number = number + col(a).cast("long") * stride
    return number


def codes(schema: Schema, attrs: Attrs, number: str = "cell") -> list[Column]:
    """Attribute columns back from a cell number."""
    part = schema.project(attrs)
    return [(F.floor(F.col(number) / stride) % n).cast("int").alias(a) for a, n, stride in zip(part.attrs, part.sizes, part.strides(), strict=True)]


def sparse(df: DataFrame, attrs: Attrs, weight: str | None = None, schema: Schema | None = None) -> DataFrame:
    """Non-empty cells of one marginal, wide."""
    attrs = names(attrs)
    (schema or schema_of(df)).project(attrs)
    value = F.sum(F.col(weight)) if weight else F.count(F.lit(1)).cast("double")
    return df.groupBy(*map(col, attrs)).agg(value.alias("value"))


def grid(df: DataFrame, schema: Schema) -> DataFrame:
    """All cells of a schema, wide; made from one range, without joins."""
    return df.sparkSession.range(schema.size()).withColumnRenamed("id", "cell").select(*codes(schema, schema.attrs), "cell")


def dense(df: DataFrame, attrs: Attrs, weight: str | None = None, schema: Schema | None = None) -> DataFrame:
    """One marginal with all its cells, absent ones 0; no attributes give the one total."""
    attrs = names(attrs)
    whole = schema or schema_of(df)
    part = whole.project(attrs)
    counted = df.groupBy(cell(whole, attrs).alias("cell")).agg((F.sum(F.col(weight)) if weight else F.count(F.lit(1)).cast("double")).alias("value"))
    if not attrs:
        return df.agg(F.coalesce(F.sum(F.col(weight)) if weight else F.count(F.lit(1)).cast("double"), F.lit(0.0)).alias("value"))
    return grid(df, part).join(counted, "cell", "left").select(*map(col, attrs), F.coalesce("value", F.lit(0.0)).alias("value"))


def datavector(df: DataFrame, attrs: Attrs | None = None, weight: str | None = None) -> DataFrame:
    """``(cell, value)`` of all cells in row-major order."""
    schema = schema_of(df)
    attrs = schema.attrs if attrs is None else names(attrs)
    full = dense(df, attrs, weight)
    return full.select(cell(schema, attrs).alias("cell"), "value").orderBy("cell")


def dropped(df: DataFrame, attrs: Attrs, weight: str | None = None) -> DataFrame:
    """The marginal on all other attributes."""
    return dense(df, schema_of(df).invert(attrs), weight)


def records(df: DataFrame) -> int:
    return df.count()


def multi(df: DataFrame, cliques: Sequence[Clique], weight: str | None = None, schema: Schema | None = None, how: str | None = None) -> DataFrame:
    """Non-empty cells ``(clique_id, cell, value)`` of many marginals in one job.

    ``how='sets'`` counts distinct rows and then all grouping sets over them; ``'dense'`` counts in each task into
    arrays of all cells and adds those up. By default the second is taken while the cells fit into a task.
    """
    schema = schema or schema_of(df)
    cliques = [names(c) for c in cliques]
    total = sum(schema.size(c) for c in cliques)
    how = how or ("dense" if total <= DENSE_CELLS else "sets")
    if not cliques:
        return df.sparkSession.createDataFrame([], "clique_id int, cell long, value double")
    return _by_arrays(df, cliques, weight, schema) if how == "dense" else _by_sets(df, cliques, weight, schema)


def _by_sets(df: DataFrame, cliques: list[Clique], weight: str | None, schema: Schema) -> DataFrame:
    used = [a for a in schema if any(a in c for c in cliques)]
    once = df.groupBy(*map(col, used)).agg((F.sum(F.col(weight)) if weight else F.count(F.lit(1)).cast("double")).alias("value"))
    sets = sorted({schema.canonical(c) for c in cliques})
    quoted = [f"`{a}`" for a in used]
    view = once
    grouped = view.groupingSets([[col(a) for a in s] for s in sets], *[F.col(q) for q in quoted]) if used else None
    if grouped is None:
        return once.select(F.explode(F.array(*[F.lit(k) for k in range(len(cliques))])).alias("clique_id"), F.lit(0).cast("long").alias("cell"), "value")
    counted = grouped.agg(F.sum("value").alias("value"), F.grouping_id(*[F.col(q) for q in quoted]).alias("set"))
    bit = {a: 1 << (len(used) - 1 - k) for k, a in enumerate(used)}
    mask = {s: sum(b for a, b in bit.items() if a not in s) for s in sets}
    rows = []
    for k, c in enumerate(cliques):
        rows.append(F.when(F.col("set") == mask[schema.canonical(c)], F.struct(F.lit(k).alias("clique_id"), cell(schema, c).alias("cell"))))
    listed = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return counted.select(F.explode(listed).alias("r"), "value").select("r.clique_id", "r.cell", "value")


def _by_arrays(df: DataFrame, cliques: list[Clique], weight: str | None, schema: Schema) -> DataFrame:
    used = [a for a in schema if any(a in c for c in cliques)]
    plan = [([used.index(a) for a in c], schema.strides(c), schema.size(c)) for c in cliques]
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in plan])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(starts[-1])
        for b in batches:
            columns = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(used))]
            w = b.column(len(used)).to_numpy(zero_copy_only=False) if weight else None
            for (places, strides, n), at in zip(plan, starts, strict=False):
                where = sum((columns[p] * s for p, s in zip(places, strides, strict=True)), np.zeros(b.num_rows, np.int64))
                total[at : at + n] += np.bincount(where, weights=w, minlength=n)[:n]
        some = np.flatnonzero(total)
        clique = np.searchsorted(starts, some, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(clique.astype(np.int32)), pa.array(some - starts[clique]), pa.array(total[some])], names=["clique_id", "cell", "value"])

    narrow = df.select(*map(col, used), *([F.col(weight)] if weight else [])) if used or weight else df.select(F.lit(0).alias("__none"))
    return narrow.mapInArrow(count, "clique_id int, cell long, value double").groupBy("clique_id", "cell").agg(F.sum("value").alias("value"))


def filled(long: DataFrame, cliques: Sequence[Clique], schema: Schema) -> DataFrame:
    """A long collection with every cell of every clique, absent ones 0."""
    sizes = F.array(*[F.lit(schema.size(c)) for c in cliques])
    ids = long.sparkSession.range(len(cliques)).select(F.col("id").cast("int").alias("clique_id"), F.get(sizes, F.col("id").cast("int")).alias("n"))
    cells = ids.select("clique_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("cell"))
    return cells.join(long, ["clique_id", "cell"], "left").select("clique_id", "cell", F.coalesce("value", F.lit(0.0)).alias("value"))


def vectors(long: DataFrame, cliques: Sequence[Clique], schema: Schema) -> list[np.ndarray]:
    """The dense vectors of a long collection on the driver; callers bound the cells (models are megabytes)."""
    out = [np.zeros(schema.size(c)) for c in cliques]
    got = long.select("clique_id", "cell", "value").toArrow()
    k, at, v = (got[c].to_numpy() for c in ("clique_id", "cell", "value"))
    for i in range(len(cliques)):
        out[i][at[k == i]] = v[k == i]
    return out


def closure_cube(df: DataFrame, attrs: Attrs, weight: str | None = None) -> DataFrame:
    """All marginals below a clique at once: attribute columns are null where summed out, with the grouping number."""
    attrs = names(attrs)
    value = F.sum(F.col(weight)) if weight else F.count(F.lit(1)).cast("double")
    return df.cube(*map(col, attrs)).agg(value.alias("value"), F.grouping_id(*map(col, attrs)).cast("int").alias("set"))


def workload_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per clique half the L1 distance of normalised cubes, the absolute error over the first total, and the largest gap."""
    total = lambda d, n: d.groupBy("clique_id").agg(F.sum("value").alias(n))
    both = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["clique_id", "cell"], "full_outer")
    both = both.select("clique_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    both = both.join(F.broadcast(total(a, "tx")), "clique_id").join(F.broadcast(total(b, "ty")), "clique_id")  # a row per clique
    gap = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("clique_id").agg(
        (0.5 * F.sum(F.abs(F.col("x") / F.col("tx") - F.col("y") / F.col("ty")))).alias("half_l1"),
        (F.sum(gap) / F.first("tx")).alias("relative_l1"),
        F.max(gap).alias("largest"),
    )


