"""The registered queries of this subpackage: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, embeddup, langid, linededup, lmscore, pieces, sharding, simhash, tokenfiles, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(docs.where("NOT held_out").select("text", "lang"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.fit_and_score(table(spark, sf_dir, "documents"))


def op4_embeddup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)
    return found.select("vec_id", "n_links", "component_id", "kept")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_ids", F.when(F.col("ids").isNotNull(), F.xxhash64("ids")).alias("ids_hash"), "round_trip")


def encoded_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, ids, n_ids, round_trip)``: piece ids of whole texts, and whether they decode to the text."""
    model = pieces.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    found = pieces.encode(docs.select("doc_id", "text"), model, verify=True)
    return found.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "round_trip")


def op6_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfiles.write_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=2)
    return tokenfiles.read_files(spark, path)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.without_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.reconstruct(spark, path).select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_decontaminate": op2_decontaminate,
    "op3_lmscore": op3_lmscore,
    "op4_embeddup": op4_embeddup,
    "op5_pieces": op5_pieces,
    "op6_tokenfiles": op6_tokenfiles,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_linededup": op9_linededup,
    "op10_simhash": op10_simhash,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
        s AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM s),
        sizes AS (SELECT DISTINCT n FROM iw),
        dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
        dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM dp),
        m AS (SELECT DISTINCT doc_id, n, s, item_id FROM dw JOIN iw USING (n, win)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op4_embeddup": """
        WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) > 0),
        s AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
        r(a, b) AS (SELECT vec_id, vec_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.low, vec_id) AS component_id, vec_id = coalesce(c.low, vec_id) AS kept
        FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "op9_linededup": """
        WITH c AS (SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, site, unnest(ls) AS raw, generate_subscripts(ls, 1) AS place FROM c),
        t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
        b AS (SELECT line, min({'d': doc_id, 'p': place}) AS keep FROM t WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT site) >= 3),
        g AS (SELECT t.*, b.line IS NOT NULL AND keep <> {'d': doc_id, 'p': place} AS gone FROM t LEFT JOIN b USING (line)),
        r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                     coalesce(array_to_string(list(raw ORDER BY place) FILTER (WHERE NOT gone), chr(10)), '') AS kept FROM g GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               CASE WHEN d.text IS NOT NULL THEN md5(kept) END AS text_md5
        FROM documents d LEFT JOIN r USING (doc_id)
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> owner THEN owner END AS refers_to
        FROM q
    """,
}
