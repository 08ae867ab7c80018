"""WARC archives, embeddings, components, the pipeline's stages and the registry."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cubiform.llm import embeddup, queries, warc
from cubiform.llm.components import components

from .fixtures import DOCS, docs

BIG = "<p>" + "payload " * 200 + "</p>"
PAGES = [(1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, BIG), (4, "http://x/\r\nInjected: 1", "small"), (5, "http://c/", "small"), (6, "http://d/", None), (7, "http://e/", ""), (None, "http://n/", BIG), (8, "http://ü/", "é" * 600), (8, "http://ü/", "é" * 600)]


def pages(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(PAGES if rows is None else rows, "page_id long, url string, html string")
    return df.withColumns({"digest": F.lit("clash"), "payload": F.lit("clash"), "length": F.lit(1)})


def test_archive_round_trips(spark):
    path = warc.write_archive(pages(spark))
    got = warc.reconstruct(spark, path).collect()
    assert len(got) == len(PAGES)
    assert spark.read.parquet(f"{path}/payloads").count() == len({p[2] or "" for p in PAGES})
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in got:
        body = html[r.page_id]
        assert (bytes(r.payload), r.payload_bytes, r.sha1) == (body, len(body), hashlib.sha1(body).hexdigest()) and r.header_sha1 == r.sha1
        twin = body == BIG.encode() and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if twin else ("response", None))
        record = bytes(r.record)
        head, _, block = record.partition(b"\r\n\r\n")
        lines = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\n") and b"Injected" not in lines
        assert int(lines[b"Content-Length"]) == len(block) - 4
        assert (block[:-4].partition(b"\r\n\r\n")[2] == body) == (r.record_type == "response" or body == b"")
    assert warc.reconstruct(spark, warc.write_archive(pages(spark).limit(0))).count() == 0


def test_damage_is_noticed(spark):
    from pyspark.sql import functions as F

    path = warc.write_archive(pages(spark))
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{path}-bad/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_payloads(spark, f"{path}-bad").select("sha1").collect()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, None), (7, 7)]
    group = {}

    def top(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = top(a), top(b)
            group[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in group}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "SHARD", 150)
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 16)))]
    centre = rng.normal(size=16)
    rows += [(1000 + k, (centre + rng.normal(size=16) * 0.1).tolist()) for k in range(120)]
    rows += [(2000 + k, (centre * 3).tolist()) for k in range(5)] + [(3000, rows[0][1]), (3000, rows[0][1]), (None, rows[1][1])]
    bad = [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, [1.0, None] * 8), (4004, [float("inf")] * 16), (4005, []), (4006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS node", "1 AS shard", "2 AS label")
    got = embeddup.near_duplicates(df).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], label[linked[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    names = [min((rows[j][0] for j in np.flatnonzero(label == label[i]) if rows[j][0] is not None), default=None) for i in range(len(x))]
    want = sorted([(r[0], int(linked[i].sum()), names[i], r[0] == names[i]) for i, r in enumerate(rows)] + [(b[0], 0, b[0], True) for b in bad], key=str)
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got], key=str) == want
    assert embeddup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("width", "large", "copies"), [(8, 16384, 16.0), (64, 16384, 16.0), (16, 600, 16.0), (16, 16384, 1.5)])
def test_no_link_is_lost_between_shards(spark, monkeypatch, width, large, copies):
    monkeypatch.setattr(embeddup, "SHARD", 300)
    monkeypatch.setattr(embeddup, "LARGE", large)
    monkeypatch.setattr(embeddup, "COPIES", copies)
    rng = np.random.default_rng(width)
    x = embeddup.unit(rng.normal(size=(1200, width)))
    side = rng.normal(size=x.shape)
    side = embeddup.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    turn = np.arccos(0.951)
    x = np.concatenate([x, np.cos(turn) * x + np.sin(turn) * side])
    got = {r.vec_id: r for r in embeddup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert links.sum() >= 2400
    assert [got[k].n_links for k in range(len(x))] == links.tolist()
    assert all(got[k].component_id == got[k + 1200].component_id for k in range(1200))
    assert got[0].audit_links == got[0].audit_found > 0


def test_lists_are_bounded():
    rng = np.random.default_rng(5)
    for n in (1, 2, 700, 7919):
        x = rng.normal(size=(n, 8))
        import pyarrow as pa

        got = embeddup._build(pa.table({"node": np.arange(n), "v": pa.array(list(x))}))
        both = np.unique(np.stack([got["node"].to_numpy(), got["other"].to_numpy()]), axis=1)
        assert np.bincount(both[0], minlength=n).max() <= 2 * (embeddup.DEGREE + embeddup.FAR)


def test_graph_search_finds_ranges():
    rng = np.random.default_rng(4)
    x = embeddup.unit(np.concatenate([rng.normal(size=(800, 24)), rng.normal(size=24) + rng.normal(size=(100, 24)) * 0.15]))
    graph = embeddup.pruned_graph(x)
    q, n = embeddup.range_search(x, graph, 0, np.arange(len(x)), 0.95)
    truth = int((x @ x.T >= 0.95).sum())
    assert len(q) / truth >= 0.9 and len({*zip(q.tolist(), n.tolist(), strict=True)}) == len(q)


def test_pipeline_stages_on_a_fixture(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, f"This is plain english text about subject {k}: " + " ".join(f"word{k}x{j}" for j in range(60)), "en", f"s{k % 12}") for k in range(20, 60)]
    copy = rows[0][1]
    rows += [(200, copy, "en", "s1"), (201, "12345 67890 ???", None, "s2"), (202, "leak " + " ".join(f"secret{j}" for j in range(12)) + " end", "en", "s3"), (203, None, "en", "s3")]
    rows = [(k, t if t is None else t + "\nThis boilerplate line ends every page of all.", g, s) for k, t, g, s in rows if t != "12345 67890 ???"] + [rows[-3]]
    spark.createDataFrame([(*r, 0 if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"secret{j}" for j in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    now, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        path = str(tmp_path / name.replace(" ", "-"))
        now.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = now
    base = set(range(20, 60))
    ids = lambda n: {r.doc_id for r in kept[n].collect()}
    assert ids("language ID") == base | {200, 202}
    lines = {r.doc_id: r.text for r in kept["line dedup"].collect()}
    assert sum("boilerplate" in t for t in lines.values()) == 1 and "boilerplate" in lines[20]
    assert ids("SimHash near-dedup") >= base and len(ids("SimHash near-dedup")) <= len(ids("line dedup"))
    assert ids("benchmark decontamination") == ids("SimHash near-dedup") - {202}
    last = kept["SentencePiece encoding and decoding"].collect()
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in last}


def test_registry():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_operators_take_clashing_columns(spark):
    """Names that operators use inside change nothing: results equal those without the extra columns."""
    from cubiform.llm import decontaminate, linededup, lmscore, shingles

    inside = ["node", "component", "h1", "h2", "place", "site", "word", "n", "row", "round", "codes", "lost", "slot", "size", "line", "raw", "shingle", "shingles", "text_key", "group", "first", "label", "fps", "cell", "hits", "held_out"]
    plain = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    more = docs(spark).selectExpr("*", *[f"'x' AS `{c}`" for c in inside if c not in docs(spark).columns])
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank")], "item_id long, text string")
    of = {
        "contamination": lambda d: decontaminate.contamination(d, bench, window=10),
        "scores": lambda d: lmscore.fit_and_score(d).select("doc_id", "n_tokens"),
        "lines": lambda d: linededup.without_boilerplate(d).select("doc_id", "text", "n_lines"),
        "near": lambda d: shingles.keep_first(d).select("doc_id", "text"),
    }
    for name, f in of.items():
        a, b = (sorted(map(str, f(d).collect())) for d in (plain, more))
        assert a == b, name
