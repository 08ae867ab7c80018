"""SentencePiece encoding and decoding with a relational lattice.

Texts are cut into words that no piece of the vocabulary can span, words between characters that stand
together in no piece, and each distinct part (a word, from here on) is encoded once:
its substrings of bounded length are exploded and equi-joined to the piece table, the edges are grouped by
word, and a higher-order ``aggregate`` folds them to the best path. For a unigram model the fold is Viterbi
over summed scores. A BPE model's encoding is not its highest sum of scores (its scores only rank merges), so
there the fold goes over the same edges in merge order: each step joins the pair of neighbours whose edge
ranks first. Characters without a piece become byte pieces, or the unknown piece if the model has none.

The encoded words, most frequent first and up to ``PACKED_BYTES``, go to the tasks as hash-sorted arrays, and
whole texts are put together from them; words beyond that size are joined to their documents by a shuffle.
Decoding joins the pieces of the ids and undoes the markers.

Parts of more than ``SHORT`` characters (unbroken codes, mostly) would make a fold over immutable arrays slow, so
the edges of such a part, found and grouped by the same joins, are folded by a task in Python with a heap of the
joins that are open: in time n log n, and with the same result (tested).

Defined cases: a null text has null ids, an empty one none; words are cut exactly, whatever their length;
``U+2581`` in a text decodes as a space, as in the library; repeated rows encode alike; an empty table gives no
rows; extra columns pass through ``encode`` untouched.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, setting, stored

SPACE = "▁"
#: Bytes of encoded words that are broadcast at most; the rest are joined.
PACKED_BYTES = 128 << 20
#: Words that a task is meant to encode.
TASK_WORDS = 32768
#: Words of texts, repeats included, that a task counts at a time.
COUNTED = 1 << 22
#: Characters of the longest part whose starts and end fit into the bits of a number.
SHORT = 61
#: Latin letters, after which a stop may end a word.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What a character without a piece costs a unigram path.
UNKNOWN_SCORE = -1000.0


@dataclass
class Pieces:
    """A piece table: ``rows (piece, id, score)`` of pieces that text can match, and what stands for bytes."""

    rows: list[tuple[str, int, float]]
    names: list[bytes]  # by id, what each decodes to
    byte_ids: list[int] | None
    unknown: int
    bpe: bool
    stops: str = field(init=False)
    longest: int = field(init=False)
    pairs: frozenset[str] = field(init=False)
    numbers: np.ndarray = field(init=False)  # of the characters in pairs, by code point
    joined: np.ndarray = field(init=False)  # whether two numbers are a pair

    def __post_init__(self):
        known = [p for p, _, _ in self.rows]
        self.longest = max(map(len, known), default=1)
        self.pairs = frozenset(p[k : k + 2] for p in known for k in range(len(p) - 1))
        self.stops = "".join(c for c in ",.;:!?" if not any(re.search(f"[{LETTERS}]{re.escape(c)}", p) for p in known))
        if any("\n" in p or "\0" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in known):
            raise ValueError("pieces that span words or lines are not supported")
        letters = sorted({c for p in self.pairs for c in p})
        self.numbers = np.zeros(0x110000, np.int32)
        self.numbers[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1,) * 2, bool)
        for a, b in self.pairs:
            self.joined[self.numbers[ord(a)], self.numbers[ord(b)]] = True

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """From a model file that adds a dummy prefix and keeps white space."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(m.vocab_size())
        plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        byte_ids = [i for i in ids if m.is_byte(i)]
        names = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else b" \xe2\x81\x87 " if m.is_unknown(i) else m.id_to_piece(i).encode() for i in ids]
        scores = [m.get_score(i) for i in plain]
        bpe = len(scores) > 1 and all(float(s).is_integer() for s in scores)  # ranks of merges
        return cls([(m.id_to_piece(i), i, s) for i, s in zip(plain, scores, strict=True)], names, byte_ids if len(byte_ids) == 256 else None, m.unk_id(), bpe)

    def table(self, spark: SparkSession) -> DataFrame:
        rank = {s: k for k, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        rows = [(p, i, s, rank[s]) for p, i, s in self.rows]
        return spark.createDataFrame([*rows, ("", 0, 0.0, 0)], "piece string, id int, score double, rank int")

    def parts(self, words: list[str]) -> list[list[str]]:
        """Each of ``cutter``'s words, cut between characters that stand together in no piece, with its markers.

        All words are looked at as one array of characters.
        """
        text = "".join(words).replace(" ", SPACE)
        whole = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        last = self._ends(np.frombuffer(text.encode("utf-32-le"), "<u4"), whole)
        at = last.tolist()
        flat = [text[a:b] for a, b in zip(chain((0,), at), at, strict=False)]
        upto = (np.searchsorted(last, whole) + 1).tolist()
        return [flat[a:b] for a, b in zip(chain((0,), upto), upto, strict=False)]

    def _ends(self, points: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where parts end in the code points of words, which end at ``whole``."""
        code = self.numbers[points]
        ends = np.ones(len(points), bool)
        ends[:-1] = ~self.joined[code[:-1], code[1:]]
        ends[whole - 1] = True
        return np.flatnonzero(ends) + 1

    def arrow_parts(self, words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """``parts`` of words that are not empty, one after the other, and how many each word has."""
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        text = words.buffers()[2][at[0] : at[-1]].to_pybytes().decode().replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        whole = np.cumsum(pc.utf8_length(words).to_numpy())
        last = self._ends(points, whole)
        width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        starts = np.append(0, np.cumsum(width)[last - 1])
        flat = pa.LargeStringArray.from_buffers(len(last), pa.py_buffer(starts), pa.py_buffer(text.encode()))
        return flat, np.diff(np.searchsorted(last, whole) + 1, prepend=0)

    def marker(self):
        """Text without ``\\0`` -> the text with one between its words: before a space, around a line end, and before a stop after a letter.

        The marker is kept as the space it stands for, so that most texts stay one byte a character. Two ``\\0`` may stand together.
        """
        stop = re.compile(f"[{re.escape(self.stops)}](?<=[{LETTERS}][{re.escape(self.stops)}])") if self.stops else None

        def mark(text: str) -> str:
            marked = text.replace("\n", "\0\n\0").replace(" ", "\0 ")
            while " \0 " in marked:
                marked = marked.replace(" \0 ", "  ")
            return stop.sub("\0\\g<0>", marked) if stop else marked

        return mark

    def cutter(self):
        """Texts -> their words, one after the other in an Arrow array, and how many each has.

        Words are cut in Arrow, so a word is no Python object. Empty words may be among them; null and empty texts have no others.
        """
        mark, zero = self.marker(), re.compile("(\0)")

        def cut(text: str) -> list[str]:  # no piece has a \\0
            return [w for p in zero.split(" " + text.replace(SPACE, " ")) for w in ([p] if p == "\0" else mark(p).split("\0"))]

        def words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
            if any(t and "\0" in t for t in texts):
                lists = pa.array([cut(t) if t else [] for t in texts], pa.large_list(pa.large_string()))
            else:
                lists = pc.split_pattern(pa.array([mark(" " + t.replace(SPACE, " ")) if t else "" for t in texts], pa.large_string()), "\0")
            return lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)

        return words


def distinct_parts(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``(word, n)`` of the parts of all words of all texts."""
    cut = pieces.cutter()

    def counts(words: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        found = pa.chunked_array(words, pa.large_string()).value_counts()
        found = pa.RecordBatch.from_struct_array(found).filter(pc.not_equal(found.field("values"), ""))
        split = []
        for k in range(0, found.num_rows, 1 << 16):
            some = found.slice(k, 1 << 16)
            flat, each = pieces.arrow_parts(some.column(0))
            split.append(pa.table({"word": flat.cast(pa.string()), "n": np.repeat(some.column(1).to_numpy(), each)}))
        if split:
            summed = pa.concat_tables(split).group_by("word", use_threads=False).aggregate([("n", "sum")])
            yield from summed.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches(32768)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Array] = []
        for b in batches:
            for k in range(0, b.num_rows, 256):
                words.append(cut(b.column(0).slice(k, 256).to_pylist())[0])
                if sum(map(len, words)) > COUNTED or sum(w.nbytes for w in words) > 16 * COUNTED:
                    yield from counts(words)
                    words = []
        if words:
            yield from counts(words)
        del words
        give_back()

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, pieces: Pieces, packed: bool = True) -> DataFrame:
    """``words`` (distinct, in ``word``) with ``edges``, the pieces found in each.

    A packed edge, of words of at most ``SHORT`` characters, is a number: rank of the score, start from 0, length and
    id in 18, 20, 6 and 18 bits, so edges sort by rank and then place. Other edges are structures that have the
    score besides. ``words`` should be dealt by ``word`` already; then edges meet without a shuffle.
    """
    table = F.broadcast(pieces.table(words.sparkSession))  # as long as the vocabulary, whatever the input
    n, own = F.char_length("word"), words.columns
    spans = words.select(*own, F.explode(F.sequence(F.lit(0), n)).alias("s"))
    width = F.when(F.col("s") == n, F.sequence(F.lit(0), F.lit(0))).otherwise(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s"))))
    spans = spans.select(*own, "s", F.explode(width).alias("len"))
    found = spans.withColumn("piece", F.col("word").substr(F.col("s") + 1, F.col("len"))).join(table, "piece")
    if max(len(pieces.names), 1) >= 1 << 18 or pieces.longest >= 1 << 6:
        raise ValueError("the vocabulary is too large for packed edges")
    edge = _shift(F.col("rank").cast("long"), F.lit(44)) + _shift(F.col("s").cast("long"), F.lit(24)) + _shift(F.col("len").cast("long"), F.lit(18)) + F.col("id")
    return found.groupBy(*own).agg(F.collect_list(edge if packed and pieces.bpe else F.struct("score", "rank", "s", "len", "id")).alias("edges"))


def _unpacked(edges: Column) -> Column:
    """Packed edges as structures of start, length and id."""
    field = lambda e, by, bits: F.shiftrightunsigned(e, by).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return F.transform(edges, lambda e: F.struct(field(e, 24, 20).alias("s"), field(e, 18, 6).alias("len"), field(e, 0, 18).alias("id")))


def _shift(value: Column, by: Column | str) -> Column:
    return F.call_function("shiftleft", value, F.col(by) if isinstance(by, str) else by)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_words(words: DataFrame, pieces: Pieces, tasks: int) -> DataFrame:
    """``words`` (distinct, in ``word``) with ``ids``, by that many tasks."""
    short, long = (words.where(x).repartition(tasks, "word") for x in (F.char_length("word") <= SHORT, F.char_length("word") > SHORT))
    found = lattice(short, pieces)
    if pieces.bpe:
        ids = _let(_unpacked(F.sort_array("edges")), lambda all_: _let(F.filter(all_, lambda e: e["len"] > 0), lambda edges: _bpe(edges, pieces)))
    else:
        ids = _let(F.filter("edges", lambda e: e["len"] > 0), lambda edges: _viterbi(edges, pieces))
    return found.select(*words.columns, ids.alias("ids")).unionByName(_long(long, pieces))


def _long(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``encode_words`` for parts of any length."""
    found = lattice(words, pieces, packed=False).select(*words.columns, "edges")
    schema = T.StructType([*words.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    at = words.columns.index("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                edges = one.column(b.num_columns - 1).flatten()
                score, rank, s, length, id_ = (c.to_numpy() for c in edges.flatten())
                real = length > 0  # the end of a word has an edge that matches no text
                path = (long_merges if pieces.bpe else long_viterbi)(len(one.column(at)[0].as_py()), s[real], length[real], rank[real] if pieces.bpe else score[real])
                ids = long_ids(one.column(at)[0].as_py(), path, dict(zip(zip(s[real].tolist(), length[real].tolist(), strict=True), id_[real].tolist(), strict=True)), pieces)
                yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([ids], pa.list_(pa.int32()))], names=schema.names)

    return found.mapInArrow(run, schema)


def long_merges(n: int, s: np.ndarray, length: np.ndarray, rank: np.ndarray) -> list[int]:
    """Ends of the parts that the fold in merge order leaves of ``n`` characters."""
    ranks = dict(zip(zip(s.tolist(), (s + length).tolist(), strict=True), rank.tolist(), strict=True))
    after, before = list(range(1, n + 1)), list(range(-1, n))  # of a start its part's end, of an end its part's start
    open_ = [(r, a, a + 1, b) for (a, b), r in ranks.items() if b == a + 2]
    heapq.heapify(open_)
    alive = bytearray(b"\1") * (n + 1)  # starts of parts
    while open_:
        _, a, middle, b = heapq.heappop(open_)
        if not (alive[a] and after[a] == middle and middle < n and alive[middle] and after[middle] == b):
            continue
        alive[middle], after[a], before[b] = 0, b, a
        if a:
            c = before[a]
            if (r := ranks.get((c, b))) is not None:
                heapq.heappush(open_, (r, c, a, b))
        if b < n:
            c = after[b]
            if (r := ranks.get((a, c))) is not None:
                heapq.heappush(open_, (r, a, b, c))
    ends, at = [], 0
    while at < n:
        at = after[at]
        ends.append(at)
    return ends


def long_viterbi(n: int, s: np.ndarray, length: np.ndarray, score: np.ndarray) -> list[int]:
    """Ends of the pieces of the path with the highest sum of scores; on ties the one whose last pieces are longer."""
    order = np.argsort(s + length, kind="stable")
    into = np.searchsorted((s + length)[order], np.arange(n + 2)).tolist()
    s, score = s[order].tolist(), score[order].tolist()
    best, back = [0.0], [0]
    for end in range(1, n + 1):
        ways = [(best[s[k]] + score[k], -s[k]) for k in range(into[end], into[end + 1])]
        top, start = max([*ways, (best[end - 1] + UNKNOWN_SCORE, 1 - end)])
        best.append(top)
        back.append(-start)
    ends, at = [], n
    while at:
        ends.append(at)
        at = back[at]
    return ends[::-1]


def long_ids(word: str, ends: list[int], ids: dict[tuple[int, int], int], pieces: Pieces) -> list[int]:
    """Ids of the spans between ``ends``: their pieces, else their bytes or the unknown piece."""
    out = []
    for a, b in zip([0, *ends], ends, strict=False):
        known = ids.get((a, b - a))
        if known is not None:
            out.append(known)
        elif pieces.byte_ids is None:
            out.append(pieces.unknown)
        else:
            out += [pieces.byte_ids[x] for x in word[a:b].encode()]
    return out


def _bpe(edges: Column, pieces: Pieces) -> Column:
    """Ids of ``word``, its edges sorted by rank and place, by the fold in merge order: a step joins the first edge that spans exactly two neighbours."""
    n = F.char_length("word")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ordered = F.filter(edges, lambda e: e["len"] > 1)
    steps = F.sequence(F.lit(2), F.greatest(n, F.lit(2)))
    ends_of = lambda e: _shift(one, e["s"]).bitwiseOR(_shift(one, e["s"] + e["len"]))
    inner_of = lambda e: _shift(_shift(one, e["len"] - 1) - 1, e["s"] + 1)
    within = lambda mask, e: mask.bitwiseAND(e["ends"]) == e["ends"]
    as_bits = lambda edges: F.transform(edges, lambda e: F.struct(ends_of(e).alias("ends"), inner_of(e).alias("inner")))

    def mask_of(joins: Column) -> Column:
        """Starts of the final pieces, and the end, as bits."""

        def step(mask: Column, _: Column) -> Column:
            fits = F.filter(joins, lambda e: within(mask, e) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1))
            return mask.bitwiseAND(F.bitwise_not(F.coalesce(F.get(fits, F.lit(0))["inner"], zero)))

        return F.aggregate(steps, _shift(one, n + 1) - 1, step)

    def ids_of_mask(mask: Column) -> Column:
        def last(e: Column) -> Column:
            return (mask.bitwiseAND(ends_of(e)) == ends_of(e)) & (mask.bitwiseAND(F.when(e["len"] > 1, inner_of(e)).otherwise(zero)) == 0)

        path = F.sort_array(F.transform(F.filter(edges, last), lambda e: F.struct(e["s"].alias("s"), e["id"].alias("id"))))
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda p: _shift(one, p).bitwiseAND(mask) != 0)

        def general(path: Column) -> Column:
            one_of = lambda s: F.get(F.filter(path, lambda e: e["s"] == s), F.lit(0))["id"]
            return F.flatten(F.transform(starts, lambda s: _let(one_of(s), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(_bytes_of(s, F.lit(1), pieces)))))

        full = lambda p: F.size(p) + 1 == F.bit_count(mask)
        return _let(path, lambda p: F.when(full(p), F.transform(p, lambda e: e["id"])).otherwise(general(p)))

    return _let(_let(as_bits(ordered), mask_of), ids_of_mask)


def _bytes_of(s: Column, length: Column, pieces: Pieces) -> Column:
    """Ids for a span without a piece: its bytes, or the unknown piece."""
    if pieces.byte_ids is None:
        return F.array(F.lit(pieces.unknown))
    digits, first = F.hex(F.col("word").substr(s + 1, length).cast("binary")), pieces.byte_ids[0]
    return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int") + first)


def _ids_of(edges: Column, s: Column, length: Column, pieces: Pieces) -> Column:
    """Ids of one span: its piece, else its bytes or the unknown piece."""
    hit = F.get(F.filter(edges, lambda e: (e["s"] == s) & (e["len"] == length)), F.lit(0))["id"]
    return _let(hit, lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(_bytes_of(s, length, pieces)))


def _viterbi(edges: Column, pieces: Pieces) -> Column:
    """Ids of the path with the highest sum of scores; on ties the one whose last pieces are longer."""
    n = F.char_length("word")
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s")))

    def step(best: Column, end: Column) -> Column:
        into = F.filter(edges, lambda e: e["s"] + e["len"] == end)
        ways = F.transform(into, lambda e: F.struct((F.get(best, e["s"])["score"] + e["score"]).alias("score"), (-e["s"]).alias("back")))
        lone = F.struct((F.get(best, end - 1)["score"] + UNKNOWN_SCORE).alias("score"), (1 - end).alias("back"))
        top = F.array_max(F.concat(ways, F.array(lone)))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (-top["back"]).alias("s"))))

    def ids_back(best: Column) -> Column:
        def back(cuts: Column, _: Column) -> Column:
            first = F.get(cuts, F.lit(0))
            return F.when(first == 0, cuts).otherwise(F.concat(F.array(F.get(best, first)["s"]), cuts))

        cuts = F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)
        spans = lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda s, k: F.struct(s.alias("s"), (F.get(c, k + 1) - s).alias("len")))
        return F.flatten(F.transform(_let(cuts, spans), lambda x: _ids_of(edges, x["s"], x["len"], pieces)))

    return _let(F.aggregate(F.sequence(F.lit(1), n), start, step), ids_back)


class Packed:
    """Encoded words by hash: sorted 64-bit hashes, where each word's ids start, and the ids.

    What a worker has put together from them is kept with them, up to ``most`` words, from task to task.
    """

    def __init__(self, hashes: np.ndarray, ids: pa.Array, most: int = 1 << 19):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.most, self.known = hashes[order], most, {}
        if len(hashes) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words share a hash")
        starts = ids.offsets.to_numpy().astype(np.int64)
        length = np.diff(starts)[order]
        self.ends = np.concatenate([[0], np.cumsum(length)])
        take = np.repeat(starts[:-1][order] - self.ends[:-1], length) + np.arange(self.ends[-1])
        self.ids = ids.values.to_numpy().astype(np.uint32)[take]

    def find(self, parts: list[str]) -> list[bytes | None]:
        """Ids of each part as little-endian 32-bit bytes; None for one that is not packed."""
        from xxhash import xxh64_intdigest

        h = np.fromiter(map(xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        return [self.ids[self.ends[k] : self.ends[k + 1]].tobytes() if ok else None for k, ok in zip(at.tolist(), hit.tolist(), strict=True)]

    def words(self, words: list[str], parts: Callable[[list[str]], list[list[str]]]) -> list[bytes | None]:
        """Ids of different words; None for a word with a part that is not packed."""
        out = list(map(self.known.get, words))
        new = [w for w, i in zip(words, out, strict=True) if i is None and w]
        split = parts(new)
        flat = list(set(chain.from_iterable(split)))
        ids = dict(zip(flat, self.find(flat), strict=True))
        fresh = {"": b""}
        for w, ps in zip(new, split, strict=True):
            got = [ids[p] for p in ps]
            if None not in got:
                fresh[w] = b"".join(got)
        if len(self.known) + len(fresh) <= self.most:
            self.known.update(fresh)
        return [fresh.get(w) if i is None else i for w, i in zip(words, out, strict=True)]


def _frequent(words: DataFrame) -> tuple[DataFrame, bool]:
    """The most frequent words that fit into ``PACKED_BYTES``, and whether that is all of them."""
    cost = F.lit(20) + 4 * F.size("ids")
    level = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted((r.level, r.cost) for r in words.groupBy(level.alias("level")).agg(F.sum(cost).alias("cost")).collect())  # a thousand rows at most
    least, total = 0, 0
    for at, c in reversed(steps):
        total += c
        if total > PACKED_BYTES:
            least = at + 1
            break
    return words.where(level >= least).select("word", "ids"), total <= PACKED_BYTES


def encoded_parts(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``(word, n, ids)`` of every distinct part of a word of the texts, as a table in the shared folder."""
    spark = docs.sparkSession
    words = stored(distinct_parts(docs, pieces, text), "words")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // TASK_WORDS))
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(4 * TASK_WORDS)):  # groups of a task stay in memory
        return stored(encode_words(words, pieces, tasks), "encoded")


def encode(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text", verify: bool = False) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of the whole text, and if asked ``round_trip``, whether they decode to it.

    Columns of those names are replaced; a null text's ids are null and its round trip true.
    """
    spark = docs.sparkSession
    docs = docs.drop("ids", "round_trip")
    coded = encoded_parts(docs, pieces, text)
    few, whole = _frequent(coded)
    got = few.select(F.xxhash64("word").alias("h"), "ids").toArrow()
    packed = Packed(got["h"].to_numpy().astype(np.int64).view(np.uint64), got["ids"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32())))
    del got
    sent, names = spark.sparkContext.broadcast(packed), spark.sparkContext.broadcast(Names(pieces.names))
    cut, parts = pieces.cutter(), pieces.parts
    rows = docs
    if not whole:  # parts beyond the bound come to their documents by a join
        key = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__key"), F.xxhash64(F.col(text).cast("string")).alias("__hash")]

        def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    own = [list(set(chain.from_iterable(parts(list(filter(None, cut([t])[0].unique().to_pylist())))))) for t in part.column(2).to_pylist()]
                    every = list({p for c in own for p in c})
                    lost = {p for p, i in zip(every, sent.value.find(every), strict=True) if i is None}
                    pairs = [(k, p) for k, c in enumerate(own) for p in c if p in lost]
                    where = pa.array([k for k, _ in pairs], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array([p for _, p in pairs], pa.string())], names=["__key", "__hash", "word"])

        asked = docs.select(*key, F.col(text).cast("string").alias("text")).mapInArrow(missing, "__key string, __hash long, word string").distinct()
        rare = asked.join(coded.select("word", "ids"), "word").groupBy("__key", "__hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "ids"))).alias("__rare"))
        rows = docs.select("*", *key).join(rare, ["__key", "__hash"], "left").select(*docs.columns, "__rare")
    at_text, width = docs.columns.index(text), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("round_trip", T.BooleanType())] if verify else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(at_text).to_pylist()
                words, length = cut(texts)
                words = words.dictionary_encode()
                each = words.dictionary.to_pylist()
                got = sent.value.words(each, parts)
                if None in got:
                    own = {w: np.array(v, "<u4").tobytes() for x in part.column(width).to_pylist() for w, v in x or ()}
                    find = lambda p, own=own: own[p] if p in own else sent.value.find([p])[0]
                    got = [b"".join(map(find, parts([w])[0])) if g is None else g for w, g in zip(each, got, strict=True)]
                size, flat = _laid_out(got, words.indices.to_numpy(), length)
                starts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
                columns = [*part.columns[:width], pa.ListArray.from_arrays(starts, pa.array(flat))]
                if verify:
                    same = [t is None or x == t.replace(SPACE, " ").encode() for t, x in zip(texts, names.value.texts(flat, size), strict=True)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return rows.mapInArrow(run, schema)


def _laid_out(ids: list[bytes], words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each text has, and all of them: texts of so many of ``words``, numbers of what has ``ids``."""
    ends, flat = _joined(pa.array(ids, pa.large_binary()), words)
    return np.diff(ends[np.concatenate([[0], np.cumsum(length)])]) // 4, np.frombuffer(flat, "<i4")


def _joined(parts: pa.LargeBinaryArray, numbers: np.ndarray) -> tuple[np.ndarray, pa.Buffer | bytes]:
    """Where each part ends, 0 before them, and the bytes of those parts one after the other."""
    if not len(numbers):
        return np.zeros(1, np.int64), b""
    found = parts.take(pa.array(numbers))
    ends = np.frombuffer(found.buffers()[1], np.int64)[: len(numbers) + 1]
    return ends, found.buffers()[2][: ends[-1]] if found.buffers()[2] else b""


class Names:
    """What ids decode to, as one run of bytes: markers are spaces already."""

    def __init__(self, names: list[bytes]):
        self.plain = pa.array([n.replace(SPACE.encode(), b" ") for n in names], pa.large_binary())

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The UTF-8 of each of several texts, whose ids follow each other: pieces joined, the dummy prefix off."""
        length, whole = _joined(self.plain, ids)
        whole, ends = memoryview(whole), length[np.cumsum(sizes)].tolist()
        return [bytes(whole[a + (whole[a : min(a + 1, b)] == b" ") : b]) for a, b in zip([0, *ends], ends, strict=False)]


def decode(coded: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids; bytes that are no UTF-8 come out as U+FFFD."""
    coded = coded.drop(out)
    sent = coded.sparkSession.sparkContext.broadcast(Names(pieces.names))
    schema = T.StructType([*coded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                column = part.column(part.num_columns - 1)
                size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = [t.decode("utf-8", "replace") if x.is_valid else None for t, x in zip(sent.value.texts(column.flatten().to_numpy(), size), column, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return coded.select("*", F.col(ids).alias("__ids")).mapInArrow(run, schema)
