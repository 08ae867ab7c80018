"""SimHash near-duplicates: 64-bit fingerprints, compared exactly in tiles with exclusive-or and bit counts.

A fingerprint is cut into four 16-bit parts; the four population counts name its cell. Two fingerprints
within ``radius`` bits differ by at most ``radius`` in the sum of their parts' population counts, so only
cells that close are compared: all other tile pairs are skipped, and none of them can hold a link.
A cell with many fingerprints is cut into tiles of bounded size. A tile pair returns a spanning forest of
its links, so a group of near copies costs rows in proportion to its size.

For links that only a wide radius shows, few cells could be skipped. There tiles are dealt by the size of the hashed sets,
as sets that differ much in size are not similar, blocks of a tile pair are skipped by population counts, and every
fingerprint names one near fingerprint of each tile that it meets: ``nearest``, for a caller that checks what it names.

Defined cases: a null or empty text, or one of white space, has no words and fingerprint zero; a text of
one or two words is one shingle; exact copies share a fingerprint and are compared once; a null id never
names a group unless all its members' ids are null; rows that repeat an id are all returned. Columns other
than the id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, stored
from .components import components

#: Shingles hashed at a time, and fingerprints in a tile.
CHUNK, TILE = 1 << 17, 2048
#: Of ``nearest``: fingerprints in a tile at least, tiles at about which they grow instead, and pairs compared at a time.
LEAST, TILES, BLOCK = 1024, 64, 1 << 17


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text: bit set if set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()  # bytes: A-Z alone is lowered, only ASCII white space splits
    if not found:
        return 0
    last = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, CHUNK):
        part = found[at : min(at + CHUNK, last) + words - 1]
        shingles = zip(*(part[k:] for k in range(words)), strict=False) if len(found) >= words else [tuple(part)]
        ones += _ones(np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(seed)), np.uint64))
    return _majority(ones, last)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of some hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_of(h: np.ndarray) -> int:
    """The fingerprint of a text whose shingles' 64-bit hashes are known."""
    return _majority(sum((_ones(h[at : at + CHUNK]) for at in range(0, len(h), CHUNK)), np.zeros(64, np.int64)), len(h))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed 64-bit number, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t, words) for t in byte_values(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, out)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable over links ``i - j`` among ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[np.ndarray] = []
        for x, y in zip(b.column(0), b.column(1), strict=True):
            p, q = (v.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64) for v in (x, y))
            i, j = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= radius)
            if len(i):
                nodes, at = np.unique(np.concatenate([p[i], q[j]]), return_inverse=True)
                label = forest(at[: len(i)], at[len(i) :], len(nodes))
                tied = label != np.arange(len(nodes))
                out.append(np.stack([nodes[tied], nodes[label[tied]]], axis=1))
        links = np.concatenate(out).view(np.int64) if out else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def _cell(fp: str):
    """Population counts of the four parts as one number, base 32."""
    parts = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    code = F.lit(0)
    for p in parts:
        code = code * 32 + p
    return code.cast("int")


def offsets(radius: int, parts: int = 4) -> list[int]:
    """Differences of cell numbers within ``radius``, each unordered pair of cells once (0 included)."""
    near = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return sorted({d[0] * 32768 + d[1] * 1024 + d[2] * 32 + d[3] for d in near if d >= (0,) * parts})


def near_links(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` at ``radius`` or fewer bits, as spanning forests."""
    cells = fps.select("fp").distinct().withColumn("cell", _cell("fp"))
    cells = stored(cells, "cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n"))  # 17^4 rows at most
    tiles = (
        cells.join(F.broadcast(sizes), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), "n").cast("int").alias("tile"))
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    tiles = stored(tiles, "tiles")
    near = F.explode(F.array(*[F.lit(d) for d in offsets(radius)]))
    left = tiles.select(F.col("cell").alias("home"), F.col("tile").alias("ta"), F.col("fps").alias("x"), near.alias("step"))
    left = left.withColumn("cell", F.col("home") + F.col("step"))
    right = tiles.select("cell", F.col("tile").alias("tb"), F.col("fps").alias("y"))
    pairs = left.join(right, "cell").where((F.col("step") != 0) | (F.col("ta") <= F.col("tb"))).select("x", "y")
    return pairs.mapInArrow(lambda b: _tile_links(b, radius), "a long, b long")


def _near(p: np.ndarray, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of fingerprints ``p`` one place in ``q``, and for each of ``q`` one in ``p``, of another within ``radius`` bits; -1 for none.

    Where ``q`` is ``p``, a fingerprint is not compared with itself.
    """
    same, mine, theirs = p is q, np.full(len(p), -1), np.full(len(q), -1)
    order_p, order_q = (np.argsort(np.bitwise_count(x), kind="stable") for x in (p, q))
    p, q = p[order_p], q[order_q]
    count_p, count_q = np.bitwise_count(p).astype(np.int16), np.bitwise_count(q).astype(np.int16)
    rows = max(1, BLOCK // len(q))
    for s in range(0, len(p), rows):
        some = slice(s, min(s + rows, len(p)))
        lo = s if same else np.searchsorted(count_q, count_p[some][0] - radius)
        hi = np.searchsorted(count_q, count_p[some][-1] + radius, side="right")
        i, j = np.nonzero(np.bitwise_count(p[some, None] ^ q[None, lo:hi]) <= radius)
        i, j = i + s, j + lo
        if same:
            i, j = i[i < j], j[i < j]
        a, b = order_p[i], order_q[j]
        new = theirs[b] < 0  # the first found stays, the same one for many
        b_new, first = np.unique(b[new], return_index=True)
        theirs[b_new] = a[new][first]
        a_new, first = np.unique(a, return_index=True)
        mine[a_new] = b[first]
    return mine, theirs


def _nearest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [np.empty((0, 2), np.int64)]
        for k in range(b.num_rows):
            x, y = (b.column(c)[k].values.flatten() for c in (1, 2))
            (p, u), (q, v) = ((f.to_numpy().view(np.uint64), n.to_numpy()) for f, n in (x, y))
            mine, theirs = _near(p, p if b.column(0)[k].as_py() else q, radius)
            out += [np.stack([u[mine >= 0], v[mine[mine >= 0]]], axis=1), np.stack([v[theirs >= 0], u[theirs[theirs >= 0]]], axis=1)]
        links = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def nearest(fps: DataFrame, ratio: float, radius: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of ``fps (node, fp, n)``, sets of n, whose fingerprints differ in ``radius`` bits or fewer.

    All fingerprints of sets whose sizes have ``ratio`` to each other, or a nearer one, are compared. From each tile that a
    node meets it names one near node, if there is any, so rows don't grow with the square of a group.
    """
    band = F.floor(F.coalesce(F.log("n"), F.lit(0.0)) / -math.log(ratio) + 1e-9).cast("int")
    fps = stored(fps.select("node", "fp", band.alias("band")), "bands")
    sizes = fps.groupBy("band").count().orderBy("band").collect()  # a row a power of 1 / ratio
    most = max(LEAST, sum(r["count"] for r in sizes) // TILES)
    first, tiles = 0, []
    for r in sizes:
        tiles.append((r.band, first, -(-r["count"] // most)))
        first += tiles[-1][2]
    spark = fps.sparkSession
    places = spark.createDataFrame(tiles, "band int, first int, tiles int")
    band_of = [k for k, _, n in tiles for _ in range(n)]
    pairs = [(i, j) for i in range(first) for j in range(i, first) if band_of[j] - band_of[i] <= 1]
    pairs = spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate(pairs)], "pair int, i int, j int")
    held = fps.join(F.broadcast(places), "band").groupBy((F.col("first") + F.pmod(F.xxhash64("node"), "tiles")).cast("int").alias("tile"))
    held = stored(held.agg(F.sort_array(F.collect_list(F.struct("fp", "node"))).alias("held")), "tiles")
    left, right = (held.join(F.broadcast(pairs), F.col("tile") == F.col(end)).select("pair", (F.col("i") == F.col("j")).alias("own"), F.col("held").alias(name)) for end, name in (("i", "x"), ("j", "y")))
    met = left.join(right.drop("own"), "pair").select("own", "x", "y")
    return met.mapInArrow(lambda b: _nearest(b, radius), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id reachable over links of ``radius`` or fewer bits."""
    fps = stored(fingerprints(docs, doc_id, text, words), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    tied = stored(components(near_links(fps, radius)), "components")
    group = first.join(tied, first.fp == tied.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    group = stored(group, "groups")
    least = group.groupBy("component").agg(F.min("first").alias("component_id"))
    named = group.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
