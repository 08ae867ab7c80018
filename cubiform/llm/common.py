"""Helpers the training-data operators share: shared storage, bounded broadcasts, byte columns."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast; beyond, a shuffled join is planned.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Whether Spark removes a query's shuffle files when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that open ``passing`` blocks remove at their ends, innermost last.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Only on one machine, and where that is unset, a folder of our own is set; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cubiform-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting that holds inside alone."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside, but for those that stay, are removed at the end."""
    paths: list[str] = []
    token = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str, by: str | None = None, stays: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet, a folder a value of ``by``, and read it back: lineage ends at files all executors share.

    What was shuffled for it goes as soon as it is written. In a ``passing`` block the table goes with the block, or if it
    ``stays`` with the block around that one.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    for paths in _PASSING.get()[::-1][int(stays) : int(stays) + 1]:
        paths.append(path)
    writer = df.write.option("compression", "zstd")
    with setting(spark, FREED, "true"):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, columns: int = 4, more: Column | None = None) -> DataFrame:
    """Hint a broadcast only after measuring: rows of about ``columns`` short values and ``more`` bytes each."""
    n, extra = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if more is None else more), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and n * columns * 16 + extra <= BROADCAST_BYTES else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone: ASCII texts take the fast built-in, others a character map."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """An Arrow string column as Python bytes (no decoding)."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def give_back() -> None:
    """Let a Python worker, which serves one task after another, return the memory that no object uses any more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)
