"""Rows drawn from a model, column by column, as DataFrame plans without Python functions.

Each column is generated given the columns before it that share a clique with it. ``round`` gives each parent
group counts that differ from the model's by less than one; ``sample`` draws independently. Rows of a group are
ranked by hash: first in buckets of the hash range, then within a bucket, with the buckets' sizes added
up in a small table. So no task sorts a whole group, however few groups there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.noise import uniform
from ..plans.cliques import junction_tree
from ..storage import stored
from .cubes import col

#: Rows that a bucket of ranks is meant to hold, and columns between tables.
BUCKET_ROWS, COLUMNS_PER_TABLE = 500_000, 5


def plan(model) -> list[tuple[str, tuple[str, ...]]]:
    """Columns in the order they are generated, each with its parents: reverse elimination order."""
    tree = junction_tree(model.schema, list(model.potentials))
    done: list[str] = []
    out = []
    for a in reversed(tree.order):
        near = {x for c in tree.cliques if a in c for x in c}
        out.append((a, tuple(x for x in done if x in near)))
        done.append(a)
    return out


def conditional(spark: SparkSession, model, attr: str, parents: tuple[str, ...]) -> DataFrame:
    """``(parents..., code, p)``: positive cells of a column given its parents; uniform where a group has no mass."""
    f = model.project((*parents, attr))
    n = f.schema[attr]
    v = np.maximum(f.values.reshape(-1, n), 0)
    mass = v.sum(axis=1, keepdims=True)
    p = np.where(mass > 0, v / np.where(mass > 0, mass, 1), 1 / n)
    group, code = np.nonzero(p > 0)
    columns = {}
    for a, stride in zip(parents, f.schema.project(parents).strides(), strict=True):
        columns[a] = pa.array(((group // stride) % f.schema[a]).astype(np.int32))
    columns |= {"code": pa.array(code.astype(np.int32)), "p": pa.array(p[group, code])}
    return spark.createDataFrame(pa.table(columns))


def ranked(df: DataFrame, keys: list[str], seed: str, buckets: int) -> DataFrame:
    """``df`` with ``rank`` from 1 in each group of ``keys``, in the order of a hash of ``id``."""
    df = df.withColumn("__u", uniform(seed, F.col("id"))).withColumn("__bucket", F.floor(F.col("__u") * buckets).cast("int"))
    inner = Window.partitionBy(*map(col, keys), "__bucket").orderBy("__u", "id")
    if buckets == 1:
        return df.withColumn("rank", F.row_number().over(inner).cast("long")).drop("__u", "__bucket")
    # as many rows as groups times buckets, which grow with the rows: no broadcast, the window has dealt df by these keys
    sizes = df.groupBy(*map(col, keys), "__bucket").agg(F.count(F.lit(1)).alias("__n"))  # a row per group and bucket
    before = Window.partitionBy(*(map(col, keys) if keys else [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return df.withColumn("__r", F.row_number().over(inner)).join(starts, [*keys, "__bucket"]).withColumn("rank", F.col("__start") + F.col("__r")).drop("__u", "__bucket", "__start", "__r")


def allocated(counts: DataFrame, table: DataFrame, parents: tuple[str, ...], seed: str) -> DataFrame:
    """``(parents..., ends, codes)``: of each group, which ranks up to ``ends[k]`` take ``codes[k]``.

    Whole parts of the expected counts first; the units left go to distinct codes drawn by their fractions.
    """
    keys = [col(a) for a in parents]
    both = counts.join(F.broadcast(table), list(parents)) if parents else counts.crossJoin(F.broadcast(table))  # one row of counts
    both = both.withColumn("x", F.col("n") * F.col("p")).withColumn("whole", F.floor("x")).withColumn("frac", F.col("x") - F.col("whole"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    key = F.concat_ws(":", *[k.cast("string") for k in keys], F.col("code").cast("string"))
    both = both.withColumn("left", F.col("n") - F.sum("whole").over(group))
    race = F.when(F.col("frac") > 0, F.try_divide(-F.log(uniform(f"{seed}:extra", key)), F.col("frac")))
    both = both.withColumn("place", F.row_number().over(group.orderBy(race.asc_nulls_last(), "code")))
    both = both.withColumn("take", F.col("whole") + (F.col("place") <= F.col("left")).cast("long"))
    both = both.withColumn("end", F.sum("take").over(group.orderBy("code")))
    rows = F.sort_array(F.collect_list(F.when(F.col("take") > 0, F.struct("end", "code"))))
    out = both.groupBy(*keys).agg(rows.alias("rows"))
    return out.select(*keys, F.transform("rows", lambda r: r["end"]).alias("ends"), F.transform("rows", lambda r: r["code"]).alias("codes"))


def round_column(df: DataFrame, table: DataFrame, attr: str, parents: tuple[str, ...], seed: str, buckets: int = 1) -> DataFrame:
    """``df`` (with ``id``) plus the column; see ``allocated``."""
    keys = list(parents)
    counts = df.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("n"))
    spans = F.broadcast(allocated(counts, table, parents, seed))  # a row per parent group of the model
    numbered = ranked(df, keys, f"{seed}:rank", buckets)
    joined = numbered.join(spans, keys) if keys else numbered.crossJoin(spans)
    place = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    return joined.select(*map(col, df.columns), F.get("codes", place).cast("int").alias(attr))


def sample_column(df: DataFrame, table: DataFrame, attr: str, parents: tuple[str, ...], seed: str) -> DataFrame:
    """``df`` (with ``id``) plus the column, drawn from its conditional distribution for each row apart."""
    keys = list(parents)
    group = Window.partitionBy(*(map(col, keys) if keys else [F.lit(0)]))
    cum = table.withColumn("end", F.sum("p").over(group.orderBy("code")))
    lists = cum.groupBy(*map(col, keys)).agg(F.sort_array(F.collect_list(F.struct("code", "end"))).alias("rows"))
    drawn = df.withColumn("__u", uniform(f"{seed}:draw", F.col("id")))
    joined = drawn.join(F.broadcast(lists), keys) if keys else drawn.crossJoin(F.broadcast(lists))
    place = F.least(F.size(F.filter("rows", lambda r: r["end"] <= F.col("__u"))), F.size("rows") - 1)
    return joined.select(*map(col, df.columns), F.get("rows", place)["code"].cast("int").alias(attr))


def synthesize(spark: SparkSession, model, rows: int | None = None, method: str = "round", seed: str = "synth") -> DataFrame:
    """``rows`` (by default the model's total, at least 1) records of the model's schema."""
    if method not in ("round", "sample"):
        raise ValueError("method must be round or sample")
    n = max(1, int(model.total if rows is None else rows))
    df = spark.range(n)
    buckets = max(1, -(-n // BUCKET_ROWS))
    for k, (attr, parents) in enumerate(plan(model)):
        table = conditional(spark, model, attr, parents)
        if method == "round":
            df = round_column(df, table, attr, parents, f"{seed}:{attr}", buckets)
        else:
            df = sample_column(df, table, attr, parents, f"{seed}:{attr}")
        if k % COLUMNS_PER_TABLE == COLUMNS_PER_TABLE - 1 and k + 1 < len(model.schema):
            df = stored(df, "synth")
    fields = [col(a).alias(a, metadata={"cardinality": size}) for a, size in model.schema.config.items()]
    return df.select(*fields)
