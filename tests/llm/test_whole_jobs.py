"""Cases in which operators once did less than the whole job."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cubiform.llm import decontaminate, langid, lmscore, pieces, shingles, simhash
from cubiform.llm.queries import tokenizer_path

from .fixtures import DOCS, docs, empty


def word_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


# -- near-dedup of the pipeline


@pytest.mark.parametrize("sampled", [1, shingles.SAMPLED])
def test_pipeline_keeps_one_of_planted_near_copies(spark, monkeypatch, sampled):
    import corpus_pipeline

    monkeypatch.setattr(shingles, "SAMPLED", sampled)
    rng = random.Random(11)
    passage = " ".join(f"common{k}" for k in range(30))
    rows = [*DOCS, (None, "another row without an id, of other words", "en", "s1"), (400, passage, "en", "s1"), (400, "one more text under the id four hundred", "en", "s1")]
    for k in range(25):
        words = [f"w{k}x{rng.randrange(500)}" for _ in range(rng.choice([40, 80, 160]))]
        for copy in range(4):
            w = list(words)
            for _ in range(copy * len(w) // 60):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((1000 + rng.randrange(10**6), " ".join(w) + (" " + passage if k % 3 else ""), "en", "s"))
    sets = [word_sets(r[1]) for r in rows]
    label = list(range(len(rows)))
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    groups: dict = {}
    for r, x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append(r)
    kept = corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()
    assert len(groups) < len(rows) - 20
    assert sorted(str((r.doc_id, r.text)) for r in kept if r.doc_id is None) == sorted(str((r[0], r[1])) for r in rows if r[0] is None)
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(min((r[0] for r in g if r[0] is not None), default=None)) for g in groups.values())
    assert corpus_pipeline.near_dedup(spark, empty(spark), "").count() == 0


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 5000)
    sets = [base[:k] for k in (0, 1, 2, 40, 400, 5000)] + [np.union1d(rng.choice(base, k, False), rng.integers(-(2**63), 2**63, j)) for k, j in ((30, 3), (300, 200), (4000, 9), (4999, 0))]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bits = shingles.sketches(owner, np.concatenate(sets), len(sets))
    assert bits.shape == (len(sets), shingles.BITS // 64) and not bits[0].any()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            differ = int(np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum())
            apart = len(np.setxor1d(x, y))
            assert differ <= apart and differ % 2 == apart % 2
    assert shingles.sketches(np.empty(0, int), np.empty(0, np.int64), 0).shape[0] == 0


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for k in range(30):
        words = [f"w{k}x{rng.randrange(500)}" for _ in range(120)]
        rows.append((k, " ".join(words), "en", "s"))
        words[rng.randrange(20, 100)] = "edited"
        rows.append((100 + k, " ".join(words), "en", "s"))
    prefixes = shingles.prefixes
    monkeypatch.setattr(shingles, "prefixes", lambda sets: prefixes(sets).limit(0))
    kept = corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()
    assert {r.doc_id for r in kept} == set(range(30))


def test_nearest_names_a_near_fingerprint_in_every_tile(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST", 16)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63, 40)
    flips = [sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), False)) for _ in range(200)]
    fps = [*(int(base[k % 40]) ^ f for k, f in enumerate(flips)), *([int(base[0])] * 100)]
    rows = [(k, f, int(n)) for k, (f, n) in enumerate(zip(fps, rng.choice([0, 1, 40, 50, 49, 200], len(fps)), strict=True))]
    got = {(r.a, r.b) for r in simhash.nearest(spark.createDataFrame(rows, "node long, fp long, n int"), 0.8, 6).collect()}
    differ = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    fits = lambda a, b: a[0] != b[0] and differ(a[1], b[1]) <= 6
    assert all(fits(rows[a], rows[b]) for a, b in got)
    close = lambda a, b: 5 * a[2] >= 4 * b[2] and 5 * b[2] >= 4 * a[2]
    assert {a[0] for a in rows for b in rows if fits(a, b) and close(a, b)} <= {a for pair in got for a in pair}
    assert len(got) <= 2 * len(rows) * 20  # no pairs of the 100 equal ones
    h = np.frombuffer(rng.bytes(8 * 5), np.uint64)
    ones = [sum(int(x) >> k & 1 for x in h) for k in range(64)]
    assert simhash.fingerprint_of(h) == sum(1 << k for k, n in enumerate(ones) if n > 2) and simhash.fingerprint_of(h[:0]) == 0


# -- texts are cut once


def test_texts_are_split_once(spark):
    for rows in (decontaminate.tokens(docs(spark)), lmscore.word_counts(docs(spark))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and "regexp_extract_all" not in plan


def test_splitting_finds_the_words_at_their_places(spark):
    texts = [None, "", " ", "a", "a ", " a", "\x00\x7fa--B9\n", "É é, HÄUSER\u2028x \U0001f600y", "\ufeff", "a" * 50 + ".b"]
    table = docs(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    want = {r.doc_id: list(r.w) for r in table.select("doc_id", decontaminate.words(table.text).alias("w")).collect()}
    found: dict = {}
    for r in decontaminate.tokens(table).orderBy("doc_id", "pos").collect():
        assert r.n_words == len(want[r.doc_id])
        found.setdefault(r.doc_id, []).append((r.pos, r.word))
    assert found == {k: list(enumerate(["", *w])) for k, w in want.items()}


# -- language ID


def test_language_id_holds_few_rows_as_objects(monkeypatch):
    import pyarrow as pa

    given = []
    monkeypatch.setattr(langid, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"t": [str(k) for k in range(2 * langid.ROWS + 3)]})
    parts = list(langid._cut(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch]) and max(p.num_rows for p in parts) == langid.ROWS
    assert len(given) == 2


# -- LM scoring


def test_every_token_is_a_training_target(spark):
    for place in range(4):  # a word met once, at each place of a text
        text = " ".join("rare" if k == place else "plain" for k in range(4))
        model = lmscore.fit(docs(spark, [(1, text, "en", "s")]))
        lex = model["lexicon"]
        net, start = lmscore.Network(model["flat"], lex["mass"].shape[1]), lmscore.Network.new(lex)
        own = lex["classes"][lex["number"][b"rare"]]
        assert net.out[-1, own] > start.out[-1, own]
    model = lmscore.fit(docs(spark, [(1, "alone", "en", "s")]))
    assert (model["flat"] != lmscore.Network.new(model["lexicon"]).flat).any()


def test_training_makes_no_floats_too_small_to_be_normal():
    words = [f"v{k}".encode() for k in range(300)]
    bucket = (lmscore._hash(words) % np.uint64(lmscore.BUCKETS)).astype(int)
    slot = np.array([1 + int((bucket[lmscore.HEADS : k] == bucket[k]).sum()) if k >= lmscore.HEADS else 0 for k in range(300)] + [0] * lmscore.BUCKETS)
    mass = np.full((lmscore.BUCKETS, slot.max() + 1), -1.0)
    mass[:, 0] = 3
    mass[bucket[lmscore.HEADS :], slot[lmscore.HEADS : 300]] = 5
    lex = {"inputs": np.append(np.arange(300), lmscore.INPUTS + np.arange(lmscore.BUCKETS)).astype(np.uint16), "heads": np.full(lmscore.HEADS, 50.0), "mass": mass}
    classes = np.concatenate([np.arange(lmscore.HEADS), lmscore.HEADS + bucket[lmscore.HEADS :], lmscore.HEADS + np.arange(lmscore.BUCKETS)])
    net = lmscore.Network.new(lex)
    assert net.sizes == lmscore.Network(net.flat, net.places).sizes == (mass >= 0).sum(axis=1).tolist() and min(net.sizes) < net.places
    codes = np.random.default_rng(4).integers(0, len(classes), 4000)
    ids, at = lmscore.laid_out(codes, np.array([4000]), lex)
    tiny = np.finfo(np.float32).tiny
    for _, grad in net.gradients(ids, at, classes[codes], slot[codes]).values():
        assert not ((grad != 0) & (np.abs(grad) < tiny)).any()


# -- disk


def test_near_dedup_leaves_only_survivors_on_disk(spark, monkeypatch, tmp_path):
    import corpus_pipeline
    from cubiform.llm import common

    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    kept = corpus_pipeline.near_dedup(spark, docs(spark), "")
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["survivors"]
    assert kept.count() == len({r[1] if (r[1] or "").strip() else "" for r in DOCS}) - 1  # LONG is a near copy of its longer form
    assert "shingles" not in shingles.sets_of(docs(spark)).columns


def test_shuffles_of_stored_tables_go(spark):
    from cubiform.llm import common

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(1 for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f)
    before = files()
    assert common.stored(spark.range(1000).repartition(3, "id"), "dealt").count() == 1000
    assert files() <= before


# -- pieces


def test_words_are_cut_counted_and_joined_in_arrow(spark):
    import pyarrow as pa

    model = pieces.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    plain = [None, "", "a  b,\n\n c 漢字 😀 ▁x", " \n", "It's ok.No"]
    for texts in (plain, [*plain, "d\0e f", "\0"]):  # with a \0 they are cut apart in Python
        words, length = model.cutter()(texts)
        assert isinstance(words, pa.Array) and len(words) == length.sum()
        ends = np.cumsum([0, *length]).tolist()
        for t, a, b in zip(texts, ends, ends[1:], strict=False):
            assert "".join(words.slice(a, b - a).to_pylist()) == (" " + t.replace("▁", " ") if t else "")
        each = sorted({w for w in words.to_pylist() if w})
        flat, n = model.arrow_parts(pa.array(["-", *each], pa.large_string()).slice(1))
        ends = np.cumsum([0, *n]).tolist()
        assert [flat.slice(a, b - a).to_pylist() for a, b in zip(ends, ends[1:], strict=False)] == model.parts(each)
    counted = {r.word: r.n for r in pieces.distinct_parts(docs(spark, [(k, t, "en", "s") for k, t in enumerate(["a b a", "a\0b", None, "", " a"])]), model).collect()}
    assert counted == {"▁a": 3, "▁▁a": 1, "▁b": 1, "\0": 1, "b": 1}
    size, ids = pieces._laid_out([b"", b"abcd", b"12345678"], np.array([0, 1, 2, 2, 0, 1]), np.array([0, 3, 0, 2, 1, 0]))
    assert size.tolist() == [0, 3, 0, 2, 1, 0] and ids.tobytes() == b"abcd1234567812345678abcd"
