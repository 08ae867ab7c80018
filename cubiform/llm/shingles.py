"""Near copies by SimHash, checked by exact word-shingle similarity and made whole by prefix filtering.

A text is the set of its shingles of ``WORDS`` words, as 64-bit hashes. Two texts are linked at a Jaccard
similarity of 4/5 or more.

First SimHash names near copies: fingerprints of 64 bits, a bit set if over half of a set's hashes have it, are compared
exactly in tiles (``simhash.nearest``) with exclusive-or and bit counts, at ``RADIUS`` bits. Sets of similarity 4/5 differ
in about 10 bits on average, closer ones in fewer, others in about 32. What fingerprints name is checked in full.

Fingerprints cannot promise a similarity, so sets that are apart after that are searched by prefixes. In any one order of all shingles, linked sets of n shingles share one of their first
n - ceil(4n/5) + 1, so only sets that meet in such a prefix are compared and no link is lost. Shingles that a
sample shows to be common come last in the order: that keeps the meeting places small and changes no result.

Each set has a sketch of ``BITS`` bits, bit k being the parity of its shingles that hash to k. Two sketches differ
in no more bits than their sets differ in shingles, so an exclusive-or and a bit count rule out most pairs that
are not linked, and never one that is. So does what two prefixes share. The others are compared in full.

The shingles of all texts are not stored, as they need more space than the texts: a table has prefixes and sketches, and the sets
that are compared in full are made anew from their texts. Tables on the way are removed when they are no longer needed.

Candidates are compared in rounds. After SimHash, ``ROUNDS`` times every set with one set of each meeting place, in
proportion to the prefixes, which ties large groups of near copies together. Then, where sets of a meeting place are still
apart, those that are apart are compared within the join: what it returns are the pairs that sizes and sketches
leave, of which the prefixes' common shingles rule out more.

Defined cases: tokens are runs of bytes between ASCII white space, A-Z lowered; a text of fewer words than
``WORDS`` is one shingle; texts without words are one group; equal sets are one set; columns other than the id
and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FREED, byte_values, maybe_broadcast, passing, setting, stored
from .components import components
from .simhash import fingerprint_of, nearest

#: Words in a shingle, one set in so many sampled for the order, shingles that the order knows as common, rounds.
WORDS, SAMPLED, COMMON, ROUNDS = 5, 16, 1 << 20, 1
#: Bits in which fingerprints of candidates differ at most.
RADIUS = 12
#: Bits of a sketch, a power of two of at least 64.
BITS = 256


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of one UTF-8 text in rising order."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    parts = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)] if found else []
    return np.unique(np.fromiter(map(xxh64_intdigest, parts), np.uint64).view(np.int64))


def sketches(owner: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
    """``(n, BITS / 64)`` words: bit k of a row is the parity of its shingles whose leading hash bits are k."""
    at = (flat.view(np.uint64) >> np.uint64(65 - BITS.bit_length())).astype(np.int64)
    odd = np.bincount(owner * BITS + at, minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _late(flat: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which shingles are among the ``common`` ones, in rising order."""
    return np.append(common, np.iinfo(np.int64).max)[np.searchsorted(common, flat)] == flat


def _first(sets: list[np.ndarray], common: np.ndarray) -> pa.ListArray:
    """The first n - ceil(4n/5) + 1 of each set's n shingles, common ones last."""
    n, flat = np.fromiter(map(len, sets), np.int64, len(sets)), np.concatenate(sets)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(owner * 2 + _late(flat, common), kind="stable")
    most = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(most)).astype(np.int32)), pa.array(flat[order[rank < most[owner]]]))


def _keyed(docs: DataFrame, text: str) -> list[Column]:
    whole = F.col(text).cast("string")
    return [F.xxhash64(whole).alias("text_key"), whole.alias("text")]


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets)).view(np.int64)


def common_shingles(docs: DataFrame, text: str = "text", words: int = WORDS) -> np.ndarray:
    """Up to ``COMMON`` shingles, in rising order, that most of a sample of the texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                found = [shingles(t, words) for t in byte_values(b.column(0).slice(s, 1024))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["shingle"])

    some = docs.select(*_keyed(docs, text)).where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "shingle long")
    often = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON)
    with setting(docs.sparkSession, FREED, "true"):
        return np.sort(often.select("shingle").toArrow()["shingle"].to_numpy())


def sets_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, text_key, node, fp, n, prefix, bits)``: a row per row of ``docs``; equal sets, of n shingles, have one node.

    The shingles are not kept, as they need more space than the texts do; ``held_sets`` makes those anew that are compared.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                sets = [shingles(t, words) for t in byte_values(part.column(2))]
                fps = np.fromiter(map(fingerprint_of, sets), np.uint64, len(sets)).view(np.int64)
                n = np.fromiter(map(len, sets), np.int32, len(sets))
                words_of = sketches(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), len(sets)).ravel()
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)), pa.array(words_of))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_nodes(sets)), pa.array(fps), pa.array(n), _first(sets, sent.value), bits], names=out.names)

    long = T.LongType()
    plain = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("text_key", long), T.StructField("node", long), T.StructField("fp", long), T.StructField("n", T.IntegerType())]
    out = T.StructType([*plain, *(T.StructField(c, T.ArrayType(long)) for c in ("prefix", "bits"))])
    return docs.select(F.col(doc_id).alias("doc_id"), *_keyed(docs, text)).mapInArrow(run, out)


def held_sets(docs: DataFrame, keys: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``(node, shingles)`` of the texts of ``docs`` that ``keys (text_key)`` names, a row for each different set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                sets = [shingles(t, words) for t in byte_values(b.column(0).slice(s, 1024))]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    asked = docs.select(*_keyed(docs, text)).join(keys, "text_key", "left_semi").select("text")
    return asked.mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def prefixes(sets: DataFrame) -> DataFrame:
    """``(shingle, node, n)``: the prefixes of ``sets (node, n, prefix)``, a row per node."""
    return sets.select(F.explode("prefix").alias("shingle"), "node", "n")


def _sketched(x: Column | str, y: Column | str, n: str, m: str) -> Column:
    """Whether sets of n and m shingles with sketches x and y can be linked: linked ones differ in (n + m) / 9 at most."""
    differ = sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(1, BITS // 64)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))
    return 9 * differ <= F.col(n) + F.col(m)


def _both(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """``pairs (a, b, ...)`` with ``x`` and ``y``, what ``held (node, column)`` has of either end."""
    x, y = (held.select(F.col("node").alias(end), F.col(column).alias(name)) for end, name in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text: str = "text") -> DataFrame:
    """A stored table ``(a, b)`` of those of ``pairs (a, b, n, m)``, sets of n and m shingles, that have similarity 4/5 or more."""
    with passing(docs.sparkSession):
        pairs = stored(pairs, "pairs")
        used = maybe_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 1)
        keys = stored(sets.join(used, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key")).select("text_key"), "asked")
        held = stored(held_sets(docs, maybe_broadcast(keys, 1), text), "held")
        shared = F.size(F.array_intersect("x", "y"))
        return stored(_both(pairs, held, "shingles").where(9 * shared >= 4 * (F.col("n") + F.col("m"))).select("a", "b"), "near", stays=True)


def _hopeful(pairs: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b, n, m, c)``, with ``c`` shingles in both prefixes, that can still be linked.

    Up to where the shorter-reaching prefix ends, all that two sets share is counted; of the rest they share at
    most what the larger has beyond its prefix.
    """
    rest = F.ceil(4 * F.greatest("n", "m") / 5) - 1
    return pairs.where(9 * (F.col("c") + rest) >= 4 * (F.col("n") + F.col("m"))).select("a", "b", "n", "m")


def _close(n: str, m: str) -> Column:
    return (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n))


def _tied(links: DataFrame) -> DataFrame:
    """The stored groups ``(node, component)`` of links."""
    with passing(links.sparkSession):
        return stored(components(links), "tied", stays=True)


def _checked(pairs: DataFrame, drawn: DataFrame, docs: DataFrame, sets: DataFrame, text: str) -> DataFrame:
    """A stored table of those of ``pairs (a, b, n, m)`` that are linked: by sketches and prefixes, then in full."""
    with passing(docs.sparkSession):
        kept = _both(stored(pairs, "candidates"), drawn, "bits").where(_sketched("x", "y", "n", "m")).select("a", "b", "n", "m")
        met = _both(stored(kept, "sketched"), drawn, "prefix").withColumn("c", F.size(F.array_intersect("x", "y")))
        return stored(verified(_hopeful(met), docs, sets, text), "linked", stays=True)


def _apart(met: DataFrame, links: DataFrame) -> DataFrame:
    """A stored table of the ``met (shingle, node, n, group)`` of meeting places with sets in several groups of ``links``."""
    with passing(met.sparkSession):
        tied = maybe_broadcast(_tied(links), 2)
        named = met.select("shingle", "node", "n").join(tied, "node", "left").select("shingle", "node", "n", F.coalesce("component", "node").alias("group"))
        apart = named.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("shingle")
        return stored(named.join(stored(apart, "places"), "shingle", "left_semi"), "apart", stays=True)


def near_links(sets: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Links ``(a, b)`` between nodes that leave the same groups as all links of similarity 4/5 or more.

    ``sets`` is what ``sets_of`` makes of ``docs``, stored.
    """
    firsts = [F.first(c).alias(c) for c in ("bits", "fp", "n", "prefix")]
    drawn = stored(sets.groupBy("node").agg(*firsts), "sketches")
    sized = [drawn.select(F.col("node").alias(end), F.col("n").alias(size)) for end, size in (("a", "n"), ("b", "m"))]
    named = nearest(drawn, 0.8, RADIUS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _checked(named.join(sized[0], "a").join(sized[1], "b").where(_close("n", "m")), drawn, docs, sets, text)
    met = _apart(prefixes(drawn), links)
    for k in range(ROUNDS):
        rank = F.xxhash64("node") if k == 0 else F.xxhash64(F.lit(k), "shingle", "node")  # first the same set in many places
        centre = met.groupBy("shingle").agg(F.min_by(F.struct("node", "n", "group"), rank).alias("o"))
        found = met.join(centre, "shingle").where((F.col("group") != F.col("o.group")) & _close("n", "o.n"))
        found = found.select(F.col("node").alias("a"), F.col("o.node").alias("b"), "n", F.col("o.n").alias("m")).distinct()
        links = links.unionByName(_checked(found, drawn, docs, sets, text))
        met = _apart(met, links)
    met = stored(met.join(drawn.select("node", "bits"), "node").withColumnRenamed("node", "a"), "sketched").alias("l")
    other = met.select(F.col("shingle").alias("at"), F.col("a").alias("b"), F.col("n").alias("m"), F.col("group").alias("others"), F.col("bits").alias("y"))
    able = (F.col("a") < F.col("b")) & (F.col("group") != F.col("others")) & _close("n", "m") & _sketched("bits", "y", "n", "m")
    pairs = met.join(other, (F.col("shingle") == F.col("at")) & able)
    pairs = pairs.groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    return links.unionByName(verified(_hopeful(pairs), docs, sets, text))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: that of the smallest id, null ids last, then of the smallest text hash."""
    with passing(docs.sparkSession):
        sets = stored(sets_of(docs, doc_id, text), "sets")
        tied = maybe_broadcast(_tied(near_links(sets, docs, text)), 2)
        rows = sets.select("doc_id", "text_key", "node").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return survivors(docs, rows, doc_id, text)


def survivors(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``rows (doc_id, text_key, component)``, named by id and text hash."""
    at = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")
    one = rows.groupBy("component").agg(F.min(at).alias("one")).select(F.col("one.doc_id").alias("__id"), F.col("one.text_key").alias("__key"))
    one = stored(one, "survivors", stays=True)
    same = lambda key, value: F.col("__id").eqNullSafe(F.col(key)) & (F.col("__key") == value)
    repeated = rows.join(one, same("doc_id", F.col("text_key")), "left_semi").groupBy("doc_id", "text_key").count().where("count > 1")
    kept = docs.join(one, same(doc_id, F.xxhash64(F.col(text).cast("string"))), "left_semi")
    if repeated.limit(1).count():
        kept = kept.withColumn("__text_key", F.xxhash64(F.col(text).cast("string"))).dropDuplicates([doc_id, "__text_key"]).drop("__text_key")
    return kept
