"""LM scoring by masked pseudo-likelihood, with a bidirectional window network trained in numpy.

Every token is hidden in turn and predicted from the ``SIDE`` tokens before it and after it. The network sums
embeddings of both sides and predicts the word in two steps: its class, which is a frequent word alone or a hash
bucket, and then the word within its bucket, among the words of the lexicon and one place for all other words,
both given both sides:
log P(token | both sides) = log P(class | both sides) + log P(word | class, both sides).
A word beyond the lexicon takes its share of its bucket's last place by its own count over the whole corpus.
The sum over all words of the corpus is one; the untrained network is the corpus's unigram model.

Counting covers all texts, as a partially aggregated ``groupBy`` whose result grows with the corpus. Counts go to
the tasks as hash-sorted arrays, most frequent first, up to ``PACKED_BYTES``; words beyond that come to the documents
that hold them by a join, so every word is scored by its own count. Texts are cut into word numbers once and
stored. Training masks every token once: the texts are dealt into ``ROUNDS`` parts by hash, and in a round each
task starts from the same parameters, moves them over its own rows of that part, and the moves are averaged by
tokens with a ``groupBy`` over parameter numbers, so neither driver nor any task holds more than one network.
The result depends on how rows are dealt to tasks, but not on timing: a task that is run again moves alike.

Tokens are runs of bytes between ASCII white space, A-Z lowered. Defined cases: a null or empty text has no
tokens, sum 0 and no mean; a word without a count (of other corpora) takes less than the share of a word met once; very
long texts are scored whole, in slices; repeated rows score alike; an empty corpus gives an untrained
network. Columns other than the id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, lower_ascii, stored

#: Words predicted by name at most and their longest bytes; the first of them are inputs of their own, and the first of those classes of their own.
LEXICON, LONGEST, INPUTS, HEADS, BUCKETS = 8192, 256, 4096, 64, 64
#: Bytes of counts that are broadcast at most; the rest are joined.
PACKED_BYTES = 64 << 20
#: Tokens on each side, embedding width, tokens in a step and in a slice of scoring, averaged rounds.
SIDE, WIDTH, STEP, SLICE, ROUNDS = 2, 16, 8192, 16384, 3
#: Step length, its first divisor, and the bound of a logit.
RATE, FIRST, FAR = 0.1, 1e-3, 80.0


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all texts."""
    found = F.split(lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+")
    each = docs.select(F.explode_outer(found).alias("word")).where("word <> ''")  # none is empty; else a filter would split texts twice
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _hash(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words, repeat(42)), np.uint64, len(words))


def _level() -> Column:
    return F.floor(F.log2("n") * 16).cast("int")


def _down_to(steps: list[tuple[int, int]], most: int) -> int:
    """The least level such that words of it and above are at most ``most``."""
    least, total = 1 << 30, 0
    for at, n in sorted(steps, reverse=True):
        total += n
        if total > most:
            break
        least = at
    return least


def lexicon(counts: DataFrame) -> dict:
    """Words by falling count with their class and place, what holds for the classes, and the packed counts of other words."""
    level, named = _level(), F.octet_length("word") <= LONGEST
    steps = counts.groupBy(level.alias("level"), named.alias("named")).agg(F.count(F.lit(1)).alias("words")).collect()  # two thousand rows at most
    every: dict[int, int] = {}
    for r in steps:
        every[r.level] = every.get(r.level, 0) + r.words
    least, packed = _down_to([(r.level, r.words) for r in steps if r.named], LEXICON), _down_to(list(every.items()), PACKED_BYTES // 12)
    kept = (level >= least) & named
    words = sorted(((bytes(r.w), r.n) for r in counts.where(kept).select(F.col("word").cast("binary").alias("w"), "n").collect()), key=lambda x: (-x[1], x[0]))
    bucket = (_hash([w for w, _ in words]) % np.uint64(BUCKETS)).astype(np.int64)
    slot, size = np.zeros(len(words) + BUCKETS, np.int64), np.ones(BUCKETS, np.int64)  # the first place of a bucket is for all other words
    for k in range(HEADS, len(words)):
        slot[k] = size[bucket[k]]
        size[bucket[k]] += 1
    rare = np.zeros(BUCKETS)
    for r in counts.where(~kept).groupBy(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("b")).agg(F.sum("n").alias("n")).collect():
        rare[r.b] = r.n
    classes = np.concatenate([np.where(np.arange(len(words)) < HEADS, np.arange(len(words)), HEADS + bucket), HEADS + np.arange(BUCKETS)]).astype(np.int64)
    inputs = np.concatenate([np.where(np.arange(len(words)) < INPUTS, np.arange(len(words)), INPUTS + bucket), INPUTS + np.arange(BUCKETS)]).astype(np.uint16)
    mass = np.full((BUCKETS, int(size.max())), -1.0)
    mass[:, 0] = rare
    for k in range(HEADS, len(words)):
        mass[bucket[k], slot[k]] = words[k][1]
    heads = np.array([n for _, n in words[:HEADS]] + [0] * max(0, HEADS - len(words)), float)
    got = counts.where(~kept & (level >= packed)).select(F.xxhash64("word").alias("h"), F.col("n").cast("long").alias("n")).toArrow()
    h, n = got["h"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return {
        "number": {w: k for k, (w, _) in enumerate(words)},
        "classes": classes,
        "inputs": inputs,
        "slots": slot,
        "heads": heads,
        "mass": mass,
        "hashes": h[order],
        "counts": np.log(n[order]).astype(np.float32),
        "whole": packed <= min(every, default=0),
    }


class Network:
    """Embeddings of the left and right side, class weights and the weights of each bucket's words; ``flat`` numbers all parameters.

    The last row of a table of weights is the bias. ``sizes`` has how many places of each bucket stand for words: others are
    left out, since their shares, as good as none, make floats too small to be normal, which slow every product down.
    """

    rows = INPUTS + BUCKETS + 1  # the last is the place outside a text

    def __init__(self, flat: np.ndarray, places: int):
        n, c = self.rows * WIDTH, HEADS + BUCKETS
        self.flat, self.places = flat.astype(np.float32), places
        cut = np.split(self.flat, np.cumsum([n, n, (WIDTH + 1) * c]))
        self.left, self.right = cut[0].reshape(-1, WIDTH), cut[1].reshape(-1, WIDTH)
        self.out, self.inner = cut[2].reshape(WIDTH + 1, c), cut[3].reshape(BUCKETS, WIDTH + 1, places)
        self.sizes = (np.arange(1, places + 1) * (self.inner[:, WIDTH] != -FAR)).max(axis=1).tolist()  # no word's bias is at the bound

    @classmethod
    def new(cls, lex: dict, seed: int = 7) -> Network:
        """Random embeddings, no weights, and as biases the logarithms of the corpus's shares."""
        mass = lex["mass"]
        of = np.concatenate([lex["heads"], np.maximum(mass, 0).sum(axis=1)]) + 0.5
        within = np.maximum(mass, 0) + 0.5
        spread = np.random.default_rng(seed).normal(0, 0.3, 2 * cls.rows * WIDTH)
        net = cls(np.concatenate([spread, np.zeros((WIDTH + 1) * len(of) + BUCKETS * (WIDTH + 1) * mass.shape[1])]), mass.shape[1])
        net.out[WIDTH] = np.log(of / of.sum())
        net.inner[:, WIDTH] = np.where(mass < 0, -FAR, np.log(within / np.where(mass < 0, 0, within).sum(axis=1, keepdims=True)))
        net.sizes = (mass >= 0).sum(axis=1).tolist()
        return net

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of both sides around the rising places ``at``, and a one for the bias."""
        lo, hi = at[0], at[-1] + 1
        near = ids[lo - SIDE : hi + SIDE]
        left, right, n = self.left[near], self.right[near], hi - lo
        h = np.ones((n, WIDTH + 1), np.float32)
        sums = left[SIDE - 1 : SIDE - 1 + n] + right[SIDE + 1 : SIDE + 1 + n]
        for o in range(2, SIDE + 1):
            sums += (left[SIDE - o : SIDE - o + n] + right[SIDE + o : SIDE + o + n]) / np.float32(o)
        h[:, :WIDTH] = sums
        return h[at - lo]

    def gradients(self, ids: np.ndarray, at: np.ndarray, target: np.ndarray, slot: np.ndarray) -> dict[str, tuple]:
        """Of the mean negative log-probability of the tokens at rising places ``at``: per array, the rows that have any and their gradients."""
        h, scale = self.hidden(ids, at), np.float32(1 / len(at))

        def error(h: np.ndarray, weights: np.ndarray, true: np.ndarray) -> np.ndarray:
            z, total = _exponentials(h, weights)
            z *= (scale / total)[:, None]
            z[np.arange(len(true)), true] -= scale
            return z

        d = error(h, self.out, target)
        back = d @ self.out[:WIDTH].T
        found = {"out": (slice(None), (d.T @ h).T)}
        order, bounds = _by_bucket(target)
        which, sorted_h, sorted_slot = np.flatnonzero(np.diff(bounds)), h[order], slot[order]
        inner, more = np.zeros((len(which), WIDTH + 1, self.places), np.float32), np.empty((len(order), WIDTH), np.float32)
        for k, b in enumerate(which.tolist()):
            some, n = slice(bounds[b], bounds[b + 1]), self.sizes[b]
            d = error(sorted_h[some], self.inner[b, :, :n], sorted_slot[some])
            np.matmul(sorted_h[some].T, d, out=inner[k, :, :n])
            np.matmul(d, self.inner[b, :WIDTH, :n].T, out=more[some])
        back[order] += more
        found["inner"] = (which, inner)
        lo, n = at[0], at[-1] + 1 - at[0]
        spread = np.zeros((WIDTH, n), np.float32)
        spread[:, at - lo] = back.T
        near = ids[lo - SIDE : lo + n + SIDE]
        rows, row = np.unique(near, return_inverse=True)
        for name, sign in (("left", -1), ("right", 1)):
            moved = np.zeros((WIDTH, n + 2 * SIDE), np.float32)
            for o in range(1, SIDE + 1):
                moved[:, SIDE + sign * o : SIDE + sign * o + n] += spread / np.float32(o)
            found[name] = (rows, np.stack([np.bincount(row, m, len(rows)) for m in moved], axis=1).astype(np.float32))
        return found

    def train(self, ids: np.ndarray, at: np.ndarray, target: np.ndarray, slot: np.ndarray, seen: Network) -> None:
        """One Adagrad step on the tokens at places ``at``; ``seen`` holds the squares so far."""
        for name, (rows, grad) in self.gradients(ids, at, target, slot).items():
            squares = getattr(seen, name)
            squares[rows] += grad * grad
            getattr(self, name)[rows] -= np.float32(RATE) * grad / np.sqrt(squares[rows])

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray, target: np.ndarray, slot: np.ndarray) -> np.ndarray:
        def shares(h: np.ndarray, weights: np.ndarray, true: np.ndarray) -> np.ndarray:
            z, total = _exponentials(h, weights)
            return np.log(z[np.arange(len(true)), true] / total)

        h = self.hidden(ids, at)
        lp = shares(h, self.out, target)
        order, bounds = _by_bucket(target)
        sorted_h, sorted_slot, more = h[order], slot[order], np.zeros(len(order), np.float32)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            some = slice(bounds[b], bounds[b + 1])
            more[some] = shares(sorted_h[some], self.inner[b, :, : self.sizes[b]], sorted_slot[some])
        lp[order] += more
        return lp


def _exponentials(h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits, which are held within ``FAR`` of zero, and their sums."""
    z = h @ weights
    np.clip(z, np.float32(-FAR), np.float32(FAR), out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], np.float32)


def _by_bucket(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of buckets in order of them, and where each bucket's begin."""
    order = np.argsort(target.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(target[order], HEADS + np.arange(BUCKETS + 1))
    return order[bounds[0] :], bounds - bounds[0]


def laid_out(codes: np.ndarray, sizes: np.ndarray, lex: dict) -> tuple[np.ndarray, np.ndarray]:
    """Input ids of texts, with room around each, and the place of each token."""
    at = np.arange(len(codes)) + SIDE * (1 + np.repeat(np.arange(len(sizes)), sizes))
    ids = np.full(len(codes) + SIDE * (len(sizes) + 1), Network.rows - 1, np.uint16)
    ids[at] = lex["inputs"][codes]
    return ids, at


def codes_of(texts: list[bytes | None], lex: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Word numbers of all texts, their sizes, what the own counts of rare words add to each text, and its words whose counts aren't packed.

    A rare word has the number of its bucket, after the lexicon's. A word that isn't packed is taken as one without a count.
    """
    get, known = lex["number"].get, len(lex["number"])
    words = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter((get(w, -1) for ws in words for w in ws), np.int32, int(sizes.sum()))
    new = np.flatnonzero(codes < 0)
    owner = np.searchsorted(np.cumsum(sizes), new, side="right")
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    rare = [words[k][i] for k, i in zip(owner.tolist(), (new - first[owner]).tolist(), strict=True)]
    h = _hash(rare)
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    codes[new] = known + bucket
    place = np.searchsorted(lex["hashes"], h)
    place[place == len(lex["hashes"])] = 0
    hit = lex["hashes"][place] == h if len(lex["hashes"]) else np.zeros(len(h), bool)
    unheard = _unheard(lex)[bucket]
    share = np.where(hit, lex["counts"][place] - _of(lex)[bucket], unheard) if len(lex["hashes"]) else unheard
    lost: list[list[bytes]] = [[] for _ in words]
    if not lex["whole"]:
        for k in np.flatnonzero(~hit).tolist():
            lost[owner[k]].append(rare[k])
    return codes, sizes, np.bincount(owner, weights=share, minlength=len(words)).astype(float), lost


def _of(lex: dict) -> np.ndarray:
    """Logarithms of how often a bucket's rare words stand in the corpus."""
    return np.log(np.maximum(lex["mass"][:, 0], 1.0))


def _unheard(lex: dict) -> np.ndarray:
    """What a word without a count takes of its bucket's rare words."""
    return -np.log(lex["mass"][:, 0] + 2.0)


def coded(docs: DataFrame, lex: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table of ``(round, row, doc_id, share, codes, lost)``: whole texts as word numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)
    texts = T.ArrayType(T.BinaryType())
    fields = [("text_key", T.LongType()), ("doc_id", docs.schema[doc_id].dataType), ("share", T.DoubleType()), ("codes", T.ArrayType(T.IntegerType())), ("lost", texts)]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                codes, sizes, share, lost = codes_of(byte_values(part.column(2)), sent.value)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(share), lists, pa.array(lost, pa.list_(pa.binary()))], names=schema.names)

    whole = F.col(text).cast("string")
    found = docs.select(F.xxhash64(whole).alias("text_key"), F.col(doc_id).alias("doc_id"), whole.alias("text")).mapInArrow(run, schema)
    found = found.withColumn("round", F.pmod("text_key", F.lit(ROUNDS)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    return stored(found.select("round", "row", "doc_id", "share", "codes", "lost"), "codes", "round")


def _batches(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their codes and sizes."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            part = b.slice(k, rows)
            yield part, part.column(column).flatten().to_numpy(), part.column(column).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def train(codes: DataFrame, lex: dict) -> np.ndarray:
    """Parameters after ``ROUNDS`` averaged rounds over the rows of ``coded``."""
    small = {k: lex[k] for k in ("classes", "inputs", "slots")}
    net = Network.new(lex)
    flat, places = net.flat.astype(np.float64), net.places
    for k in range(ROUNDS):
        sent = codes.sparkSession.sparkContext.broadcast((small, flat.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lex, start = sent.value
            net, seen, n = Network(start.copy(), places), Network(np.full(len(start), FIRST * FIRST, np.float32), places), 0
            for _, found, sizes in _batches(batches, 0):
                ids, at = laid_out(found, sizes, lex)
                target, slot = lex["classes"][found], lex["slots"][found]
                for s in range(0, len(at), STEP):
                    some = slice(s, s + STEP)
                    net.train(ids, at[some], target[some], slot[some], seen)
                n += len(at)
            where = np.flatnonzero(net.flat != start)
            moved = net.flat[where].astype(np.float64) - start[where]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(where, -1).astype(np.int32)), pa.array(np.append(moved * n, n))], names=["i", "v"])

        got = codes.where(F.col("round") == k).select("codes").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # a row a parameter
        i, v = got["i"].to_numpy(), got["v"].to_numpy()
        flat[i[i >= 0]] += v[i >= 0] / max(1.0, float(v[i < 0].sum()))
        sent.unpersist()
    return flat.astype(np.float32)


def fit(docs: DataFrame, text: str = "text") -> dict:
    """``{"lexicon", "flat", "counts", "codes"}``: words, trained parameters, the table of all counts and that of the texts as numbers."""
    counts = stored(word_counts(docs, text), "word-counts")
    lex = lexicon(counts)
    codes = coded(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), lex)
    return {"lexicon": lex, "flat": train(codes, lex), "counts": counts}


def fit_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``score(docs, fit(docs))``; texts are cut into words once."""
    counts = stored(word_counts(docs, text), "word-counts")
    lex = lexicon(counts)
    codes = coded(docs, lex, doc_id, text)
    return _scored(codes, {"lexicon": lex, "flat": train(codes, lex), "counts": counts})


def pseudo_likelihoods(codes: np.ndarray, sizes: np.ndarray, lex: dict, net: Network) -> np.ndarray:
    """Summed log-probabilities of whole texts, those within the rare words of a bucket left out."""
    ids, at = laid_out(codes, sizes, lex)
    target, slot, lp = lex["classes"][codes], lex["slots"][codes], np.empty(len(at))
    for s in range(0, len(at), SLICE):
        some = slice(s, s + SLICE)
        lp[some] = net.log_probabilities(ids, at[some], target[some], slot[some])
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=lp, minlength=len(sizes)).astype(float)


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, log_likelihood, mean_log_likelihood)``, a row per row of ``docs``."""
    return _scored(coded(docs, model["lexicon"], doc_id, text), model)


def _scored(codes: DataFrame, model: dict) -> DataFrame:
    lex = model["lexicon"]
    small = {k: lex[k] for k in ("classes", "inputs", "slots")}
    places = lex["mass"].shape[1]
    sent = codes.sparkSession.sparkContext.broadcast((small, model["flat"]))
    fields = [("row", T.LongType()), ("doc_id", codes.schema["doc_id"].dataType), ("n_tokens", T.LongType()), ("lp", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, flat = sent.value
        net = Network(flat, places)
        for part, found, sizes in _batches(batches, 3):
            lp = pseudo_likelihoods(found, sizes, lex, net) + part.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sizes), pa.array(lp)], names=schema.names)

    found = codes.select("row", "doc_id", "share", "codes").mapInArrow(run, schema)
    total = F.col("lp")
    if not lex["whole"]:  # counts beyond the bound come to their documents by a join
        bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
        less = F.array(*[F.lit(float(x)) for x in _of(lex) + _unheard(lex)])
        own = codes.select("row", F.explode("lost").alias("word")).withColumn("word", F.col("word").cast("string")).join(model["counts"], "word")
        own = own.groupBy("row").agg(F.sum(F.log("n") - F.element_at(less, bucket + 1)).alias("own"))
        found, total = found.join(own, "row", "left"), F.col("lp") + F.coalesce("own", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return found.select("doc_id", "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))
