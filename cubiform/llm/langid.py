"""Language ID: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams (1 to ``ORDERS`` characters, hashed to ``BUCKETS``) of labelled texts, by language, on
the executors; the log-probability matrix (buckets x languages, a bound that no input size moves) is
broadcast and whole texts are scored in numpy by gathering its rows and summing them per text.

The classifier is fitted on a bounded sample of the labelled rows: at most about ``MAX_DOCS`` texts of each
language, taken by a hash of the text, so the choice does not depend on partitions. Prediction reads the
text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language first
in sorted order; with no labelled text at all every text is ``und``; very long texts are scored whole, in
slices; repeated rows are scored alike; columns other than those named are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

#: Hash buckets, longest n-gram, most labelled texts of a language that are fitted on, characters in a slice, rows held as Python objects.
BUCKETS, ORDERS, MAX_DOCS, SLICE, ROWS = 1 << 16, 3, 2000, 1 << 18, 512


def grams(points: np.ndarray, orders: int = ORDERS, buckets: int = BUCKETS) -> list[np.ndarray]:
    """Buckets of all n-grams of code points, one array for each order; place i starts at character i."""
    out, h = [], np.zeros(len(points), np.uint32)
    for n in range(1, orders + 1):
        h = h[: len(points) - n + 1] * np.uint32(16777619) + points[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2654435761 + 2 * n)
        out.append((mixed >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64))
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _slices(points: np.ndarray) -> Iterator[np.ndarray]:
    """n-gram buckets of a text; slices overlap so that each n-gram comes once."""
    for at in range(0, max(1, len(points)), SLICE):
        part = points[at : at + SLICE + ORDERS - 1]
        for n, g in enumerate(grams(part)):
            yield g[: max(0, min(SLICE, len(points) - at - n))]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of ``ROWS`` rows; a worker's unused memory goes back before and after."""
    give_back()
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)
    give_back()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, alpha: float = 0.1) -> dict:
    """``{"langs": [...], "table": float32 (BUCKETS, languages), "prior": (languages)}`` from rows with text and label."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "prior": np.zeros(0)}
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    bound = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs / sizes[k]))])
    where = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(where), BUCKETS), np.int64)
        for b in _cut(batches):
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for g in _slices(_points(t)):
                    total[where[k]] += np.bincount(g, minlength=BUCKETS)
        k, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(total[k, g])], names=["k", "g", "n"])

    part = rows.where(share < bound[F.col("lang")]).mapInArrow(count, "k int, g int, n long")
    got = part.groupBy("k", "g").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS x languages rows at most
    n = np.zeros((len(langs), BUCKETS))
    n[got["k"].to_numpy(), got["g"].to_numpy()] = got["n"].to_numpy()
    table = np.log(n + alpha) - np.log(n.sum(axis=1, keepdims=True) + alpha * BUCKETS)
    fitted = np.array([min(sizes[k], max_docs) for k in langs], float)
    return {"langs": langs, "table": np.ascontiguousarray(table.T.astype(np.float32)), "prior": np.log(fitted / fitted.sum())}


def posterior(text: str, model: dict) -> np.ndarray:
    """Probability of each language of a whole text."""
    score = model["prior"].astype(np.float64).copy()
    for g in _slices(_points(text)):
        score += model["table"][g].sum(axis=0, dtype=np.float64)
    score = np.exp(score - score.max())
    return score / score.sum()


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of those names are replaced)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [*docs.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in _cut(batches):
            langs, scores = [], []
            for t, letter in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if letter and m["langs"]:
                    p = posterior(t, m)
                    langs.append(m["langs"][int(p.argmax())])
                    scores.append(float(p.max()))
                else:
                    langs.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    whole = F.col(text).cast("string")
    return docs.select("*", whole.alias("__text"), F.coalesce(whole.rlike(r"\p{L}"), F.lit(False)).alias("__letter")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", min_score: float = 0.5) -> DataFrame:
    """Fit on the rows' own labels and keep the rows with a language of posterior ``min_score`` or more."""
    model = fit(docs, text, lang)
    found = predict(docs.withColumn("__row", F.lit(1)), model, text)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*docs.columns)
