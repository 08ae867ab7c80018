"""Line dedup by distinct-site spread, in DataFrame functions alone.

Lines are named by 128 bits of hash. One HyperLogLog sketch of sites per line hash is built on the map side
and merged by aggregation, so a line in a third of all rows crosses the shuffle once per task. Lines whose
estimate clears the threshold by more than the sketch's error are boilerplate, those below it by more are
not, and the lines in between get an exact distinct count. A boilerplate line stays where it comes first
(smallest id, then place) and goes everywhere else, so no text is lost from the corpus as a whole.

A line counts without the white space at its ends; lines shorter than ``MIN_CHARS`` are never boilerplate
(short lines meet by chance). Defined cases: null texts stay null and have no lines; a null site is a site
of its own, named by the empty text; a null id comes after all others; rows that repeat an id are kept
apart by their text, equal rows lose the same lines; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

#: Sites on which a line counts as boilerplate, its least characters, and the sketch's log2 of registers.
MIN_SITES, MIN_CHARS, LG_K = 3, 20, 12
KEY = ["h1", "h2"]
ROW = ["doc_id", "text_key"]


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, text_key, site, place, h1, h2)`` of the lines long enough to count."""
    cut = docs.select(
        F.col(doc_id).alias("doc_id"),
        text_key(F.col(text)).alias("text_key"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)).alias("place", "raw"),
    )
    line = cut.withColumn("line", F.btrim("raw", F.lit(" \t\r\f\v"))).where(F.char_length("line") >= min_chars)
    return line.select(*ROW, "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``(h1, h2)`` of lines on ``min_sites`` distinct sites or more; exact near the threshold."""
    sketched = lines.groupBy(*KEY).agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    spread = stored(sketched.select(*KEY, F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") > 1), "spread")
    margin = max(1.0, 5 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    sure = spread.where(F.col("sites") > min_sites + margin).select(*KEY)
    unsure = spread.where(F.col("sites").between(min_sites - margin, min_sites + margin)).select(*KEY)
    counted = lines.join(maybe_broadcast(unsure, 2), KEY, "left_semi").select(*KEY, "site").distinct()
    exact = counted.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select(*KEY)
    return sure.unionByName(exact)


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, text_key, places)``: the places of the lines that go, for documents that lose any."""
    lines = lines_of(docs, doc_id, text, site, min_chars)
    found = maybe_broadcast(stored(boilerplate(lines, min_sites), "boilerplate"), 2)
    held = stored(lines.join(found, KEY).select(*ROW, "place", *KEY), "held")
    at = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("place"), F.col("text_key"))
    first = maybe_broadcast(held.groupBy(*KEY).agg(F.min(at).alias("first")), 6)
    gone = held.join(first, KEY).where(~F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("place"), F.col("text_key")).eqNullSafe(F.col("first")))
    return gone.groupBy(*ROW).agg(F.sort_array(F.collect_set("place")).alias("places"))


def without_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text rewritten, plus ``n_lines`` and ``n_removed`` (columns of those names are replaced); rows without removals keep their text byte for byte."""
    gone = stored(removals(docs, doc_id, text, site, min_sites, min_chars), "removals")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("places").alias("__places"))
    docs = docs.drop("n_lines", "n_removed")
    keyed = docs.withColumn("__row", text_key(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key"))
    cut = F.split(F.col(text).cast("string"), "\n", -1)
    kept = F.filter(cut, lambda _, k: ~F.array_contains(F.col("__places"), k))
    new = F.when(F.col("__places").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    joined = keyed.join(maybe_broadcast(gone, 4, F.size("__places") * 4), same, "left")
    n_lines, n_gone = F.coalesce(F.size(cut), F.lit(0)), F.coalesce(F.size("__places"), F.lit(0))
    return joined.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns], F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("__places").isNull(), 0).otherwise(n_gone).cast("long").alias("n_removed"))
