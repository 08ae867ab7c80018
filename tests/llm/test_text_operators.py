"""Language ID, decontamination, LM scoring, pieces, token files, sharding, line dedup and SimHash on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cubiform.llm import decontaminate, langid, linededup, lmscore, pieces, sharding, simhash, tokenfiles
from cubiform.llm.queries import tokenizer_path

from .fixtures import DOCS, PASSAGE, docs, empty


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# -- language ID


def corpus(spark, n=120):
    rng = random.Random(1)
    words = {"en": "the of and to in is that it was for on with as his they".split(), "fr": "le la et les des est que une dans pour qui sur pas avec".split()}
    rows = [(k, " ".join(rng.choices(words[lang := ("en", "fr")[k % 2]], k=30)), lang, "s") for k in range(n)]
    return docs(spark, rows)


def test_langid_learns_and_covers_odd_rows(spark):
    model = langid.fit(corpus(spark))
    assert model["langs"] == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(corpus(spark, 60), model).collect()}
    assert all(v[0] == ("en", "fr")[k % 2] and 0 <= v[1] <= 1 for k, v in got.items())
    odd = {r.text: r.lang_pred for r in langid.predict(docs(spark), model).collect()}
    assert odd[None] == odd[""] == odd["12345 67890 !!! ???"] == "und"
    assert langid.predict(empty(spark), model).count() == 0
    nothing = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(docs(spark), nothing).collect()} == {"und"}


def test_langid_matches_counting_by_hand(spark):
    model = langid.fit(corpus(spark))
    text, score = "the river and une île", model["prior"].copy()
    for n, g in enumerate(langid.grams(np.array(list(map(ord, text)), np.uint32))):
        assert len(g) == len(text) - n
        score += model["table"][g].astype(float).sum(axis=0)
    want = np.exp(score - score.max())
    np.testing.assert_allclose(langid.posterior(text, model), want / want.sum(), rtol=1e-6)


def test_langid_slices_do_not_change_long_texts(spark, monkeypatch):
    model = langid.fit(corpus(spark))
    long = "le monde est grand et the world is small " * 500
    whole = langid.posterior(long[:3000], model)
    monkeypatch.setattr(langid, "SLICE", 97)
    np.testing.assert_allclose(langid.posterior(long[:3000], model), whole)


def test_accepted_keeps_columns(spark):
    kept = langid.accepted(corpus(spark))
    assert kept.columns == docs(spark).columns and kept.count() == 120


# -- decontamination


def brute_contamination(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(lower))
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for i, text in items:
            q = cut(text)
            n = min(window, len(q))
            for s in range(len(q) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, PASSAGE), (2, "Häuser und Bäume"), (3, ""), (4, None), (5, "a a a a a a a a a a a a"), (2, "nothing like it is in there at all, my dear friend Bob"), (6, "Short Text!")]


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    more = [(100 + k, " ".join(rng.choices(["a", "b", *PASSAGE.split()[:4]], k=60)), "en", "s") for k in range(40)] + [(300, "a " * 40, "en", "s"), (301, "É é HÄUSER und Bäume häuser UND bäume", "de", "s")]
    items = spark.createDataFrame(ITEMS + [(7, "a b a b the quick a b a b a the")], "item_id long, text string")
    got = decontaminate.contamination(docs(spark, DOCS + more), items)
    want = brute_contamination([r[1] for r in DOCS + more], ITEMS + [(7, "a b a b the quick a b a b a the")])
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(((r[0], *w) for r, w in zip(DOCS + more, want, strict=True)), key=str)


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(empty(spark), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs(spark), items.limit(0)).collect())
    kept = decontaminate.clean(docs(spark), items)
    assert kept.columns == docs(spark).columns
    assert sorted(map(str, {r.doc_id for r in kept.collect()})) == sorted(map(str, {3, 4, 5, 8, 9, 10, None}))


def test_proximity_allows_slop(spark):
    moved = PASSAGE.replace("brown fox", "brown old fox")
    listed = decontaminate.item_words(spark.createDataFrame([(1, PASSAGE)], "item_id long, text string"))
    index = decontaminate.build_index(docs(spark, [(1, moved, "en", "s"), (2, "the quick brown fox", "en", "s")]), listed.select("word"))
    assert {r.doc_key for r in decontaminate.proximity_matches(index, listed, slop=1).collect()} == {"1"}


# -- LM scoring


def by_hand(text, lex, net, counts):
    """The score of one text, token by token."""
    words, known = lmscore.tokens(text), len(lex["number"])
    bucket = lambda w: int(lmscore._hash([w])[0] % lmscore.BUCKETS)
    codes = [lex["number"].get(w, known + bucket(w)) for w in words]
    around = lambda k: int(lex["inputs"][codes[k]]) if 0 <= k < len(codes) else lmscore.Network.rows - 1
    share = lambda z: z - np.log(np.exp(z).sum())
    total = 0.0
    for t, w in enumerate(words):
        h = np.append(sum((net.left[around(t - o)] + net.right[around(t + o)]) / o for o in range(1, lmscore.SIDE + 1)), 1.0)
        c = int(lex["classes"][codes[t]])
        total += share(h @ net.out)[c]
        if c >= lmscore.HEADS:
            total += share(h @ net.inner[c - lmscore.HEADS])[lex["slots"][codes[t]]]
        if codes[t] >= known:
            rare = lex["mass"][bucket(w), 0]
            total += np.log(counts[w] / rare) if counts.get(w) else -np.log(rare + 2)
    return len(words), total


@pytest.mark.parametrize(("named", "packed"), [(8192, 1 << 20), (70, 12 * 300)])
def test_lm_scores_equal_token_by_token(spark, monkeypatch, named, packed):
    monkeypatch.setattr(lmscore, "LEXICON", named)
    monkeypatch.setattr(lmscore, "PACKED_BYTES", packed)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=50)), "en", "s") for k in range(200)]
    rows += [(1000, "w399 w1 unheard", "en", "s"), (None, "W398 w398 " + "x" * 300, "en", "s"), (1000, None, "en", "s"), (1001, "", "en", "s")]
    table = docs(spark, rows)
    seen = table.where("doc_id IS NULL OR doc_id <> 1000")
    model = lmscore.fit(seen)
    lex = model["lexicon"]
    net = lmscore.Network(model["flat"], lex["mass"].shape[1])
    counts = Counter(w for r in rows if r[0] != 1000 for w in (r[1] or "").encode().lower().split())
    assert {r.word.encode(): r.n for r in lmscore.word_counts(seen).collect()} == counts and len(lex["number"]) <= named
    got = sorted(((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in lmscore.score(table, model).collect()))
    want = sorted((str(r[0]), *by_hand((r[1] or "").encode(), lex, net, counts)) for r in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-3)
    assert lmscore.fit_and_score(table).count() == len(rows)


def small_lm(words=500):
    """A lexicon and a network with random weights, texts of the lexicon's words."""
    rng = np.random.default_rng(6)
    named = [f"v{k}".encode() for k in range(words)]
    bucket = (lmscore._hash(named) % np.uint64(lmscore.BUCKETS)).astype(int)
    slot = np.array([1 + int((bucket[lmscore.HEADS : k] == bucket[k]).sum()) if k >= lmscore.HEADS else 0 for k in range(words)] + [0] * lmscore.BUCKETS)
    mass = np.full((lmscore.BUCKETS, slot.max() + 1), -1.0)
    mass[:, 0] = 3
    mass[bucket[lmscore.HEADS :], slot[lmscore.HEADS : words]] = 5
    inputs = np.append(np.arange(words), lmscore.INPUTS + np.arange(lmscore.BUCKETS)).astype(np.uint16)
    classes = np.concatenate([np.arange(lmscore.HEADS), lmscore.HEADS + bucket[lmscore.HEADS :], lmscore.HEADS + np.arange(lmscore.BUCKETS)])
    lex = {"number": {w: k for k, w in enumerate(named)}, "classes": classes, "inputs": inputs, "slots": slot, "heads": np.full(lmscore.HEADS, 50.0), "mass": mass, "hashes": np.empty(0, np.uint64), "counts": np.empty(0, np.float32), "whole": True}
    net = lmscore.Network.new(lex)
    net.out += rng.normal(0, 0.3, net.out.shape).astype(np.float32)
    net.inner += rng.normal(0, 0.3, net.inner.shape).astype(np.float32)
    return lex, net, rng.integers(0, words + lmscore.BUCKETS, 300), np.array([0, 120, 1, 0, 179])


def test_lm_probabilities_sum_to_one():
    lex, net, codes, sizes = small_lm()
    ids, at = lmscore.laid_out(codes, sizes, lex)
    spot, total = at[60:61], 0.0
    for code in range(len(lex["classes"])):
        total += float(np.exp(net.log_probabilities(ids, spot, lex["classes"][[code]], lex["slots"][[code]]))[0])
    assert total == pytest.approx(1.0, abs=1e-4)


def test_lm_gradients_are_finite_differences():
    lex, net, codes, sizes = small_lm()
    ids, at = lmscore.laid_out(codes, sizes, lex)
    args = (ids, at, lex["classes"][codes], lex["slots"][codes])
    loss = lambda: -float(net.log_probabilities(*args).astype(np.float64).mean())
    rng = np.random.default_rng(1)
    for name, (rows, grad) in net.gradients(*args).items():
        whole = np.zeros(getattr(net, name).shape)
        whole[rows] = grad
        flat, table = whole.ravel(), getattr(net, name).reshape(-1)
        for k in [*np.argsort(-np.abs(flat))[:6], *rng.integers(0, len(flat), 4)]:
            before, step = table[k], np.float32(0.02)
            table[k] = before + step
            up = loss()
            table[k] = before - step
            slope, table[k] = (up - loss()) / (2 * step), before
            assert slope == pytest.approx(flat[k], abs=2e-4, rel=0.02), (name, k)


def test_lm_beats_the_unigram_model_on_held_out_texts(spark):
    rng = random.Random(11)
    follow = {k: rng.sample(range(300), 3) for k in range(300)}

    def text():
        now, out = rng.randrange(300), []
        for _ in range(60):
            now = rng.choice(follow[now])
            out.append(f"t{now}")
        return " ".join(out)

    rows = [(k, text(), "en", "s") for k in range(2500)]
    model = lmscore.fit(docs(spark, rows[:2000]))
    start = {**model, "flat": lmscore.Network.new(model["lexicon"]).flat}
    mean = [np.mean([r.mean_log_likelihood for r in lmscore.score(docs(spark, rows[2000:]), m).collect()]) for m in (start, model)]
    assert mean[1] > mean[0] + 0.2


def test_lm_prefers_the_corpus_and_survives_odd_rows(spark):
    model = lmscore.fit(corpus(spark, 3000))
    probe = docs(spark, [(1, "the of and to in is that it was for on with", "en", "s"), (2, "the le of la and les to des in est is que", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s")])
    got = {r.doc_id: r for r in lmscore.score(probe, model).collect()}
    assert got[1].mean_log_likelihood > got[2].mean_log_likelihood
    assert (got[3].n_tokens, got[3].log_likelihood, got[3].mean_log_likelihood) == (0, 0.0, None)
    blank = lmscore.fit(empty(spark))
    assert lmscore.score(docs(spark), blank).count() == len(DOCS)
    assert lmscore.score(empty(spark), model).count() == 0


# -- pieces


@pytest.mark.parametrize("bound", [pieces.PACKED_BYTES, 400])
def test_pieces_equal_the_library_and_decode(spark, monkeypatch, bound):
    import sentencepiece

    monkeypatch.setattr(pieces, "PACKED_BYTES", bound)
    path = tokenizer_path("piece_bpe_32k.model")
    model, library = pieces.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    more = [(50, "a  b   c\n\nd\0e 漢字 😀 ▁x ². " + "x" * 80 + " " + "-" * 70, "x", "s"), (51, "Hello, world.It's www.test.com;ok!?\r\n\ttab <s> <0x41>", "x", "s"), (52, " lead and trail ", "x", "s")]
    got = pieces.decode(pieces.encode(docs(spark, DOCS[:8] + DOCS[9:11] + more), model, verify=True), model).collect()
    for r in got:
        assert r.ids == (None if r.text is None else library.encode(r.text)), r.doc_id
        assert r.round_trip and r.decoded == (None if r.text is None else r.text.replace("▁", " "))
    assert pieces.encode(empty(spark), model).count() == 0


def test_unigram_lattice_takes_the_best_path(spark):
    table = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "▁a": -3.2, "bab": -4.0, "▁ab": -6.0}
    model = pieces.Pieces([(p, k, s) for k, (p, s) in enumerate(table.items())], [p.encode() for p in table], None, 99, bpe=False)
    words = spark.createDataFrame([("▁abab",), ("ab",), ("▁ac",)], "word string")

    def best(w):
        paths = [(0.0, [])] + [None] * len(w)
        for e in range(1, len(w) + 1):
            ways = [(paths[s][0] + table[w[s:e]], [*paths[s][1], list(table).index(w[s:e])]) for s in range(e) if paths[s] and w[s:e] in table]
            if not ways:
                ways = [(paths[e - 1][0] + pieces.UNKNOWN_SCORE, [*paths[e - 1][1], 99])]
            paths[e] = max(ways)
        return paths[-1][1]

    for r in pieces.encode_words(words, model, 2).collect():
        assert r.ids == best(r.word)


def test_long_unbroken_words(spark):
    import sentencepiece

    path, rng = tokenizer_path("piece_bpe_32k.model"), random.Random(8)
    model, library = pieces.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ACGT", "abcXYZ019+/=", "x", "aé漢😀"]
    texts = ["".join(rng.choices(k, k=n)) for k in kinds for n in (61, 62, 200, 4000)] + ["".join(rng.choices("ACGT", k=100_000))]
    rows = [(k, t, "x", "s") for k, t in enumerate(texts)]
    for r in pieces.encode(docs(spark, rows), model, verify=True).collect():
        assert r.ids == library.encode(r.text) and r.round_trip, (r.doc_id, len(r.text))


def test_long_and_short_folds_agree(spark):
    rng = random.Random(9)
    table = {p: -rng.randrange(1, 60) / 8 for p in {"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(60)}}
    words = spark.createDataFrame([("".join(rng.choices("abcd", k=rng.randrange(1, 50))),) for _ in range(60)], "word string").distinct()
    for bpe in (False, True):
        model = pieces.Pieces([(p, k, s) for k, (p, s) in enumerate(table.items())], [p.encode() for p in table], None, 99, bpe=bpe)
        short = {r.word: r.ids for r in pieces.encode_words(words, model, 2).collect()}
        assert short == {r.word: r.ids for r in pieces._long(words, model).collect()}


def test_parts_are_cut_between_characters_that_no_piece_joins():
    model = pieces.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    words = [" the", "a1b2", "\n", "\0", "naïve漢字", "  ", "x" * 70, " 2024-01"]
    for word, got in zip(words, model.parts(words), strict=True):
        marked = word.replace(" ", "▁")
        assert "".join(got) == marked
        ends = {sum(map(len, got[:k])) for k in range(1, len(got))}
        assert ends == {k for k in range(1, len(marked)) if marked[k - 1 : k + 1] not in model.pairs}
    assert model.parts([]) == []


# -- token files


def test_elias_fano_selects_everything():
    rng = np.random.default_rng(0)
    for values in ([], [0], [5], [0, 0, 0], np.sort(rng.integers(0, 10**9, 5000)), np.cumsum(rng.integers(0, 3, 9000)), [0, 2**60]):
        ef = tokenfiles.EliasFano.of(np.asarray(values, np.int64))
        back, end = tokenfiles.EliasFano.read(memoryview(data := ef.tobytes()), 0)
        assert end == len(data)
        assert back.select(np.arange(len(values))).tolist() == list(map(int, values))
    dense = tokenfiles.EliasFano.of(np.arange(0, 1_000_000, 100))
    assert len(dense.tobytes()) < 10_000 * 10 / 8 + 3000  # of 80,000 bytes as 64-bit numbers


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    more = [(-5, "A. b, C.D e.,f it's IT'S. ÉA. İstanbul. <|endoftext|> A. <|ENDOFTEXT|>", "x", "s"), (20, "a\tb.\nc é. 日本語. ²a.", "x", "s")]
    rows = DOCS + more
    out = tokenfiles.write_files(docs(spark, rows), path)
    got = sorted(tokenfiles.read_files(spark, out, with_ids=True).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (key, text, *_) in zip(got, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.ids) == (key, at, ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenfiles.read_files(spark, tokenfiles.write_files(empty(spark), path)).count() == 0


def test_token_files_take_ids_far_apart(spark):
    ids = [-(2**63), -8 * 10**18, 0, 5, 8 * 10**18, 2**63 - 1]
    assert tokenfiles.TokenFile(tokenfiles.pack_file([None, *ids], [0] * 7, [], 2)).doc_ids() == [None, *ids]
    rows = [(k, f"text {j}", "en", "s") for j, k in enumerate(ids)]
    out = tokenfiles.write_files(docs(spark, rows).coalesce(1), tokenizer_path("word_bpe_49k.json"))
    assert [r.doc_id for r in tokenfiles.read_files(spark, out).orderBy("start").collect()] == ids


def test_encoder_beyond_its_memory():
    with open(tokenizer_path("word_bpe_49k.json"), "rb") as f:
        spec = f.read()
    texts = [b"some words, and More. words", b"other words again", None]
    assert tokenfiles.Encoder(spec, 2).encode(texts) == tokenfiles.Encoder(spec).encode(texts)


# -- sharding


def test_shards_are_even_whole_and_versioned(spark):
    rng = random.Random(3)
    rows = [(k, "x" * rng.choice([1, 10, 100, 1000, 5000]), "en", "s") for k in range(2000)] + DOCS
    out, path = sharding.shard(docs(spark, rows), shards=24)
    got = out.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for s in range(24):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        sizes[s] = sum(r.size for r in mine)
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 24
    texts = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
    assert sorted(r.version for r in spark.read.parquet(path).select("version").distinct().collect()) == [0, 1]
    assert sharding.shard(empty(spark))[0].count() == 0


def test_rebalancing_moves_little():
    sizes = {k: (100 + k % 7, 1) for k in range(4096)}
    before = sharding.rebalanced(sharding.first_map(4096, 24), sizes, 24)
    grown = sharding.rebalanced(before, sizes, 25)
    moved = [k for k in range(4096) if grown[k] != before[k]]
    assert len(moved) < 4096 / 25 * 1.5 and {grown[k] for k in moved} == {24}
    shrunk = sharding.rebalanced(before, sizes, 23)
    assert set(shrunk) == set(range(23))


# -- line dedup


def test_line_dedup_equals_brute_force(spark):
    shared, local = "This line stands on a great many sites at once.", "This one only repeats on one single site."
    rows = [(k, f"own line of document number {k}, long enough\n  {shared} \nx\nThe.", "en", f"s{k % 14}") for k in range(40)]
    rows += [(k, f"{local}\nmore", "en", "one") for k in range(50, 90)] + DOCS
    got = linededup.without_boilerplate(docs(spark, rows))
    assert got.columns == [*[c for c in docs(spark).columns if c != "n_removed"], "n_lines", "n_removed"]
    sites: dict[str, set] = {}
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            if len(line.strip(" \t\r\f\v")) >= linededup.MIN_CHARS:
                sites.setdefault(line.strip(" \t\r\f\v"), set()).add(source or "")
    bad = {x for x, s in sites.items() if len(s) >= linededup.MIN_SITES}
    assert bad == {shared}
    seen, want = set(), []
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            want.append((key, None))
            continue
        kept = []
        for line in text.split("\n"):
            x = line.strip(" \t\r\f\v")
            if x not in bad or x not in seen:
                kept.append(line)
            if x in bad:
                seen.add(x)
        want.append((key, "\n".join(kept)))
    assert rows_of(got, "doc_id", "text") == sorted(want, key=str)
    assert linededup.without_boilerplate(empty(spark)).count() == 0


def test_near_threshold_lines_are_exact(spark):
    for n in (linededup.MIN_SITES - 1, linededup.MIN_SITES):
        rows = [(k, "exactly at the threshold of sites, this line", "en", f"s{k}") for k in range(n)]
        removed = sum(int(r.n_removed) for r in linededup.without_boilerplate(docs(spark, rows)).collect())
        assert removed == (n - 1 if n >= linededup.MIN_SITES else 0)


# -- SimHash


def brute_simhash(texts):
    import xxhash

    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    return out


def test_simhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    rng = random.Random(5)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(40)) for _ in range(400)]
    rows = list(DOCS)
    for k in range(60):
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(400)] = "changed"
        rows.append((100 + k, " ".join(w), "en", "s"))
    fps = brute_simhash([r[1] for r in rows])
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((r[0], f) for r, f in zip(rows, fps, strict=True))
    unique = sorted(set(fps))
    group = {f: f for f in unique}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(unique):
        for b in unique[:i]:
            if (a ^ b).bit_count() <= 2:
                group[top(a)] = top(b)
    least: dict[int, int] = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[top(f)] = min(least.get(top(f), r[0]), r[0])
    assert {(r.fp % 2**64, r.component_id) for r in got} == {(f, least.get(top(f))) for f in fps}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**62), 2**62, 30)
    near = [int(b) ^ (1 << int(rng.integers(64)) if i else 0) ^ (1 << int(rng.integers(64)) if i > 1 else 0) for b in base for i in range(4)]
    near = sorted({(x + 2**63) % 2**64 - 2**63 for x in near})
    df = spark.createDataFrame([(x,) for x in near], "fp long")
    from cubiform.llm.components import components

    for tile in (2, 2048):
        got = {r.node: r.component for r in components(simhash.near_links(df, 2, tile)).collect()}
        for i, a in enumerate(near):
            for b in near[:i]:
                if ((a ^ b) % 2**64).bit_count() <= 2:
                    assert got[a] == got[b]
