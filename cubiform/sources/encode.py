"""Raw tables to integer codes and back: dictionaries, buckets, validation; reading and writing.

An encoded table has an integer column per attribute whose field metadata carries its cardinality, so the
schema travels with the DataFrame; an optional weight column stays beside them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.noise import uniform
from ..plans.schema import Schema


@dataclass(frozen=True)
class Levels:
    """A dictionary: a value's code is its place; nulls get a code of their own after the last if asked."""

    values: tuple
    null_level: bool = False

    @property
    def size(self) -> int:
        return len(self.values) + self.null_level

    def code(self, column: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, self.values)), column)
        code = F.when(place > 0, place.cast("int") - 1)
        return F.when(column.isNull(), F.lit(len(self.values))).otherwise(code) if self.null_level else code

    def label(self, code: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.values)), code)


@dataclass(frozen=True)
class Buckets:
    """Equal steps from ``low``: code = floor((value - low) / step), rounded to whole steps if ``exact``."""

    low: float
    step: float
    size: int
    exact: bool = False

    def code(self, column: Column) -> Column:
        place = (column.cast("double") - self.low) / self.step
        return (F.round(place) if self.exact else F.floor(place)).cast("int")

    def label(self, code: Column) -> Column:
        return code * self.step + self.low


@dataclass(frozen=True)
class Edges:
    """Buckets between sorted edges: code = number of edges at or below the value, less one."""

    edges: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(self.edges) - 1

    def code(self, column: Column) -> Column:
        value = column.cast("double")
        return F.size(F.filter(F.array(*map(F.lit, self.edges)), lambda e: e <= value)) - 1

    def label(self, code: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.edges)), code)


@dataclass
class Encoder:
    """Encodings of raw columns, by attribute name."""

    columns: Mapping[str, tuple[str, Levels | Buckets | Edges]]
    schema: Schema = field(init=False)

    def __post_init__(self):
        self.schema = Schema.of({a: e.size for a, (_, e) in self.columns.items()})

    def encode(self, raw: DataFrame, weight: str | None = None, on_invalid: str = "raise") -> DataFrame:
        """Codes in schema order; see ``checked`` for ``on_invalid``."""
        coded = raw.select(*[e.code(F.col(c)).alias(a) for a, (c, e) in self.columns.items()], *([weight] if weight else []))
        return checked(coded, self.schema, weight, on_invalid)

    def decode(self, coded: DataFrame) -> DataFrame:
        return coded.select(*[e.label(F.col(a)).alias(a) for a, (_, e) in self.columns.items()])

    @classmethod
    def learned(cls, raw: DataFrame, columns: Iterable[str], most: int = 10_000) -> Encoder:
        """Sorted distinct values of low-cardinality columns, read in one job of partial aggregates."""
        found = {}
        columns = list(columns)
        sets = raw.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns], *[F.max(F.col(c).isNull().cast("int")).alias(f"__null_{c}") for c in columns]).first()
        for c in columns:
            if len(sets[c]) > most:
                raise ValueError(f"{c} has more than {most} levels")
            found[c] = (c, Levels(tuple(sets[c]), bool(sets[f"__null_{c}"])))
        return cls(found)


def checked(coded: DataFrame, schema: Schema, weight: str | None = None, on_invalid: str = "raise") -> DataFrame:
    """The schema's columns, in order, with metadata; codes outside ``0..n-1`` raise, or their rows go (``drop``)."""
    inside = F.lit(True)
    for a, n in schema.config.items():
        inside = inside & F.col(f"`{a}`").isNotNull() & F.col(f"`{a}`").between(0, n - 1)
    if on_invalid == "drop":
        coded = coded.where(inside)
    elif on_invalid == "raise":
        first = next(iter(schema), None)
        if first is not None:
            good = F.when(inside, F.col(f"`{first}`")).otherwise(F.raise_error(F.lit("a code is null or outside its attribute's range")))
            coded = coded.withColumn(first, good)
    elif on_invalid != "trust":
        raise ValueError("on_invalid must be raise, drop or trust")
    fields = [F.col(f"`{a}`").cast("int").alias(a, metadata={"cardinality": n}) for a, n in schema.config.items()]
    return coded.select(*fields, *([F.col(weight).cast("double").alias(weight)] if weight else []))


def load(spark: SparkSession, path: str, domain: str, fmt: str = "csv", weight: str | None = None, on_invalid: str = "raise") -> DataFrame:
    """Coded records with a JSON file of ``{"attribute": cardinality}``; columns outside it are never parsed into rows."""
    text = "\n".join(r.value for r in spark.read.text(domain, wholetext=True).collect())
    schema = Schema.from_json(text)
    if fmt == "csv":
        rows = spark.read.option("header", True).csv(path)
        rows = rows.select(*[F.col(f"`{a}`").cast("int").alias(a) for a in schema], *([F.col(weight).cast("double").alias(weight)] if weight else []))
    else:
        rows = spark.read.format(fmt).load(path)
    return checked(rows, schema, weight, on_invalid)


def save(coded: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Write records; CSV gets a header line in each part."""
    writer = coded.write.mode(mode)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def save_domain(schema: Schema, spark: SparkSession, path: str) -> None:
    spark.range(1).select(F.lit(schema.to_json()).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_log(spark: SparkSession, rows: Sequence[Mapping], path: str) -> None:
    """Add error-log rows to a table."""
    spark.createDataFrame([dict(r) for r in rows]).write.mode("append").parquet(path)


def random_records(spark: SparkSession, schema: Schema, n: int, seed: str = "records") -> DataFrame:
    """``n`` rows of independent uniform codes, the same under any partitioning."""
    rows = spark.range(n)
    fields = [F.floor(uniform(f"{seed}:{a}", F.col("id")) * size).cast("int").alias(a, metadata={"cardinality": size}) for a, size in schema.config.items()]
    return rows.select(*fields)


def from_rows(spark: SparkSession, rows: Iterable[Sequence[int]], schema: Schema, weights: Sequence[float] | None = None, on_invalid: str = "raise") -> DataFrame:
    """In-memory records."""
    rows = [list(map(int, r)) for r in rows]
    if weights is not None:
        if len(weights) != len(rows):
            raise ValueError("rows and weights differ in number")
        rows = [r + [float(w)] for r, w in zip(rows, weights, strict=True)]
    struct = T.StructType([T.StructField(a, T.IntegerType()) for a in schema] + ([T.StructField("weight", T.DoubleType())] if weights is not None else []))
    return checked(spark.createDataFrame(rows, struct), schema, "weight" if weights is not None else None, on_invalid)


