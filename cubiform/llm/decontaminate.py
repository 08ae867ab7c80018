"""Benchmark decontamination with a positional inverted index, in DataFrame functions alone.

``build_index`` reads the training texts once and stores a posting ``(document, position, term)`` for each
token whose term the test vocabulary holds (all other postings can never be asked for), plus one marker
row per document with its word count. Test windows then start from their rarest term by corpus frequency:
its postings, shifted by the term's offset, are candidate positions; they are intersected with the shifted
postings of the second rarest term, and what is left with all other terms of the item. Runs of matched
consecutive positions that are at least a window long are exact phrase matches. ``proximity_matches``
allows each term to stand up to ``slop`` positions off its place.

Skew: a very frequent term is counted with map-side aggregation and is only ever joined as a rarest term
if all terms of its window are as frequent; the joins that follow are on (document, position, term), so a
hot term or passage spreads over its documents.

Defined cases: null, empty and wordless texts have no words and no hits; an item without words is left
out, one shorter than a window is one window; a document is an id with its text, so rows that repeat an id
with other texts are kept apart, repeated rows each get a result, and a null id counts as an id; items
that repeat an id count once; a null item id is written ``null``. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, maybe_broadcast, stored

#: A run of word characters, after lower-casing A-Z: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc_key", "text_key"]


def words(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


@dataclass
class Index:
    """``postings (doc_key, text_key, pos, term)``, ``marks`` one row per document, ``terms (word, term)``."""

    postings: DataFrame
    marks: DataFrame
    terms: DataFrame


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, item_key, ipos, word, n_item)``; ``item_key`` tells items apart that share an id."""
    listed = items.select(F.col(item_id).alias("item"), F.xxhash64(F.col(text).cast("string")).alias("h"), words(F.col(text)).alias("w"))
    return listed.select(
        "item",
        F.concat_ws("/", F.coalesce(F.col("item").cast("string"), F.lit("null")), F.col("h").cast("string")).alias("item_key"),
        F.posexplode("w").alias("ipos", "word"),
        F.size("w").alias("n_item"),
    ).distinct()


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, doc_key, text_key, n_words, pos, word)``: each text's words at places from 1, and at place 0 an empty one for the document."""
    # A text after a space is split into an empty string, whose place 0 marks the document itself, its words, and an empty one if it ends between words.
    found = F.split(F.concat(F.lit(" "), lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit("")))), BETWEEN)
    n_words = F.size("w") - 1 - (F.element_at("w", -1) == "").cast("int")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("doc_key"),
        F.xxhash64(F.col(text).cast("string")).alias("text_key"),
        found.alias("w"),
    ).select("doc_id", "doc_key", "text_key", n_words.cast("long").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))  # none is empty; else a filter would split texts twice
    return rows.where((F.col("pos") == 0) | (F.col("word") != ""))


def build_index(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Store postings of ``docs`` for the words of ``vocabulary (word)``, in one pass over the texts."""
    distinct = vocabulary.select("word").where(F.col("word") != "").distinct()
    terms = stored(distinct.withColumn("term", F.monotonically_increasing_id() + 1), "terms")  # fixed once written
    asked = terms.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).cast("long").alias("term")))
    rows = tokens(docs, doc_id, text)
    kept = rows.join(maybe_broadcast(asked, 2, F.octet_length("word")), "word").select("doc_id", "doc_key", "text_key", "n_words", "pos", "term")
    saved = stored(kept, "postings")
    return Index(saved.where("term > 0").select(*DOC, "pos", "term"), saved.where("term = 0").select("doc_id", *DOC, "n_words"), terms)


def ranked_windows(index: Index, item_terms: DataFrame, window: int) -> DataFrame:
    """``(item_key, n_item, t1, o1, t2, o2)``: of each window that may occur, its two rarest terms and their places."""
    counts = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    listed = item_terms.join(counts, "term", "left").select("item_key", "n_item", "ipos", "term", F.coalesce("n", F.lit(0)).alias("n"))
    first = F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - (window - 1)), F.least(F.col("ipos"), F.greatest(F.lit(0), F.col("n_item") - window))))
    spread = listed.select("item_key", "n_item", F.struct("n", "ipos", "term").alias("t"), first.alias("start"))
    by = spread.groupBy("item_key", "n_item", "start").agg(F.slice(F.sort_array(F.collect_list("t")), 1, 2).alias("rare"))  # a window's terms
    by = by.where(F.col("rare")[0]["n"] > 0)
    a, b = F.col("rare")[0], F.coalesce(F.try_element_at("rare", F.lit(2)), F.col("rare")[0])
    return by.select("item_key", "n_item", "start", a["term"].alias("t1"), a["ipos"].alias("o1"), b["term"].alias("t2"), b["ipos"].alias("o2"))


def _item_terms(index: Index, items: DataFrame) -> DataFrame:
    return stored(items.join(index.terms, "word").select("item_key", "item", "ipos", "term", "n_item"), "item-terms")


def phrase_matches(index: Index, items: DataFrame, window: int = 10) -> DataFrame:
    """``(doc_key, text_key, item_key, item, first, last)``: maximal runs of document positions, from 1, that hold windows.

    ``items`` is what ``item_words`` returns.
    """
    item_terms = _item_terms(index, items)
    pairs = ranked_windows(index, item_terms, window).select("item_key", "t1", "o1", "t2", "o2").distinct()
    pairs = stored(pairs, "rarest")
    asked = maybe_broadcast(pairs, 5, F.octet_length("item_key"))
    start = index.postings.join(asked, F.col("term") == F.col("t1")).select(*DOC, "item_key", (F.col("pos") - F.col("o1")).alias("shift"), "t2", "o2")
    start = start.select(*DOC, "item_key", "shift", (F.col("shift") + F.col("o2")).alias("pos"), F.col("t2").alias("term"))
    second = index.postings.join(maybe_broadcast(pairs.select(F.col("t2").alias("term")).distinct(), 1), "term", "left_semi")
    both = start.join(second, [*DOC, "pos", "term"]).select(*DOC, "item_key", "shift").distinct()
    both = stored(both, "candidates")
    wanted = both.join(maybe_broadcast(item_terms, 5, F.octet_length("item_key")), "item_key").select(*DOC, "item_key", "item", "n_item", "shift", "ipos", (F.col("shift") + F.col("ipos")).alias("pos"), "term")
    near = index.postings.join(both.select(*DOC).distinct(), DOC, "left_semi")
    met = wanted.join(near, [*DOC, "pos", "term"]).select(*DOC, "item_key", "item", "n_item", "shift", "ipos", "pos").distinct()
    order = Window.partitionBy(*DOC, "item_key", "shift").orderBy("ipos")
    runs = met.withColumn("run", F.col("ipos") - F.row_number().over(order))
    runs = runs.groupBy(*DOC, "item_key", "item", "n_item", "shift", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.lit(window), F.col("n_item"))).select(*DOC, "item_key", "item", "first", "last")


def proximity_matches(index: Index, items: DataFrame, window: int = 10, slop: int = 2) -> DataFrame:
    """``(doc_key, text_key, item_key, start, at)``: windows all of whose terms stand within ``slop`` of their places.

    Places are counted from the occurrence ``at`` of the window's rarest term.
    """
    item_terms = _item_terms(index, items)
    ranked = ranked_windows(index, item_terms, window).select("item_key", "n_item", "start", "t1", "o1")
    at = index.postings.join(maybe_broadcast(ranked, 5, F.octet_length("item_key")), F.col("term") == F.col("t1"))
    at = at.select(*DOC, "item_key", "n_item", "start", F.col("pos").alias("at"), "o1")
    terms = item_terms.select("item_key", "ipos", "term")
    inside = (F.col("ipos") >= F.col("start")) & (F.col("ipos") < F.col("start") + window)
    offs = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    wanted = at.join(terms, "item_key").where(inside).select(*DOC, "item_key", "n_item", "start", "at", "ipos", "term", (F.col("at") - F.col("o1") + F.col("ipos")).alias("place"), offs.alias("off"))
    wanted = wanted.withColumn("pos", F.col("place") + F.col("off"))
    met = wanted.join(index.postings, [*DOC, "pos", "term"])
    met = met.groupBy(*DOC, "item_key", "n_item", "start", "at").agg(F.countDistinct("ipos").alias("n"))
    return met.where(F.col("n") == F.least(F.lit(window), F.col("n_item"))).select(*DOC, "item_key", "start", "at")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated)``, a row per row of ``docs``."""
    listed = stored(item_words(items), "items")
    index = build_index(docs, listed.select("word"), doc_id, text)
    runs = stored(phrase_matches(index, listed, window), "matches")
    hit = runs.select(*DOC, F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    ids = F.sort_array(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("null"))))
    which = runs.groupBy(*DOC).agg(ids.alias("ids"))
    found = hit.join(which, DOC)
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return index.marks.join(found, DOC, "left").select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, columns as they were."""
    bad = contamination(docs, items, window, doc_id, text).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    bad = stored(bad, "contaminated")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__key"))
    return docs.join(maybe_broadcast(bad, 2), same, "left_anti")
