"""Token-id files: ids of whole texts, concatenated, with Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents in ascending id order (two bytes an id where the vocabulary
allows, else four), and two monotone sequences in Elias-Fano form: the boundaries and the document ids. A
sequence of m values below u takes about m * (2 + log2(u / m)) bits plus a rank directory of 32 bits per 512;
``select`` answers the k-th value from it without any table of 64-bit offsets. Offsets are local to a file;
a manifest, one row per file, adds where each file starts.

Files are written by the tasks under a name of their own attempt and renamed, so a task that is run again
replaces its file with the same bytes. Defined cases: a null or empty text has the end id alone; null ids
come first; rows that repeat an id follow each other, ordered by text; long texts are encoded whole;
an empty table gives no files and no rows; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, shared_path

MAGIC, HEAD = b"TIDF0001", struct.Struct("<8sBxxxIQQq")
#: Bits in a block of the rank directory; words that a worker remembers.
BLOCK, CACHE = 512, 1 << 20
#: A stop after a letter at the end of a piece: a token of its own.
STOP = re.compile(rb"[.,](?<=[a-z][.,])(?=\s|$)")


class EliasFano:
    """A non-decreasing sequence of numbers from 0, in near-minimal space, with random access."""

    _head = struct.Struct("<QQB7x")

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.directory = n, top, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n, width), np.uint8)
        for k in range(width):
            low[:, k] = (v >> np.uint64(k)) & np.uint64(1)
        places = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(places[-1]) + 1 if n else 0) // BLOCK) * BLOCK, np.uint8)
        bits[places] = 1
        ones = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        return cls(n, top, width, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), directory)

    def tobytes(self) -> bytes:
        return self._head.pack(self.n, self.top, self.low_bits) + self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, top, width = cls._head.unpack_from(data, at)
        at += cls._head.size
        n_low = -(-n * width // 8)
        n_high = -(-((top >> width) + n if n else 0) // BLOCK) * (BLOCK // 8)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        n_dir = n_high * 8 // BLOCK + 1
        directory = np.frombuffer(data, "<u4", n_dir, at + n_low + n_high)
        return cls(n, top, width, low, high, directory), at + n_low + n_high + 4 * n_dir

    def select(self, k: np.ndarray | int) -> np.ndarray:
        """The values at places ``k``."""
        k = np.atleast_1d(np.asarray(k, np.int64))
        out = np.empty(len(k), np.int64)
        for s in range(0, len(k), 4096):
            part = k[s : s + 4096]
            block = np.searchsorted(self.directory, part, side="right") - 1
            bits = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
            rank = (part - self.directory[block] + 1)[:, None]
            place = (np.cumsum(bits, axis=1, dtype=np.int32) >= rank).argmax(axis=1) + block * BLOCK
            value = (place - part) << self.low_bits
            for b in range(self.low_bits):
                bit = part * self.low_bits + b
                value |= ((self.low[bit >> 3] >> (bit & 7)).astype(np.int64) & 1) << b
            out[s : s + 4096] = value
        return out


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: list[bytes], width: int) -> bytes:
    """One file: header, boundaries, document ids (null ones first, counted apart), token ids."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    shifted = (known.astype(np.uint64) - np.uint64(base % (1 << 64))) if len(known) else known
    head = HEAD.pack(MAGIC, width, nulls, len(doc_ids), int(bounds[-1]), base)
    return b"".join([head, EliasFano.of(bounds).tobytes(), EliasFano.of(shifted).tobytes(), *ids])


class TokenFile:
    """A file read back: ``len``, ``doc_id(k)``, ``start(k)``, ``ids(k)``."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        magic, width, self.nulls, self.n, self.n_ids, self.base = HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.bounds, at = EliasFano.read(data, HEAD.size)
        self.keys, at = EliasFano.read(data, at)
        self._ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", self.n_ids, at)

    def __len__(self) -> int:
        return self.n

    def doc_id(self, k: int) -> int | None:
        return None if k < self.nulls else self._signed(self.keys.select(k - self.nulls))[0]

    def _signed(self, v: np.ndarray) -> list[int]:
        return (v + np.int64(self.base)).tolist()  # modulo 2**64, as ids in one file may lie further apart than 2**63

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + self._signed(self.keys.select(np.arange(self.n - self.nulls)))

    def start(self, k: int) -> int:
        return int(self.bounds.select(k)[0])

    def ids(self, k: int) -> np.ndarray:
        a, b = self.bounds.select([k, k + 1])
        return self._ids[a:b]


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian 32-bit bytes.

    The word tokenizer lowers case, drops white space and never joins what it parts, so texts are lowered in A-Z, cut
    at ASCII white space and before a stop that ends a piece, and each distinct piece is encoded by the
    library once per worker, up to a bounded memory. Pieces of letters alone are words to the tokenizer:
    many are encoded at once, and told apart by the tokens that end a word. A text that holds the
    beginning of a special token's name is cut at white space alone.
    """

    def __init__(self, spec: bytes, remembered: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.remembered = Tokenizer.from_buffer(spec), {}, remembered
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in names.items() if t.endswith(suffix)]] = True
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.guard = os.path.commonprefix(special).encode() if special else b"\0"

    @classmethod
    def shared(cls, spec: bytes) -> Encoder:
        """The one of this worker, with what it remembers from earlier tasks."""
        key = zlib.crc32(spec), len(spec)
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(spec)
        return _ENCODERS[key]

    def cut(self, text: bytes | None) -> list[bytes]:
        text = text or b""
        return text.split() if self.guard in text else STOP.sub(rb" \g<0>", text.lower()).split()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        new = list(set(chain.from_iterable(cut)) - self.known.keys())
        fresh = self._looked_up(new)
        if len(self.known) + len(fresh) <= self.remembered:
            self.known.update(fresh)
            fresh = {}
        if fresh:
            get, rest = self.known.get, fresh
            return [b"".join([get(w) or rest.get(w, b"") for w in c]) for c in cut]
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def _looked_up(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        texts = [x.decode("utf-8", "replace") for x in pieces]
        plain = [k for k, t in enumerate(texts) if t.isalpha()] if self.ends.any() else []
        out: dict[bytes, bytes] = {}
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) == len(part) and end[-1] == len(ids):
                data, last = ids.tobytes(), 0
                for k, e in zip(part, (end * 4).tolist(), strict=True):
                    out[pieces[k]] = data[last:e]
                    last = e
        rest = [k for k in range(len(pieces)) if pieces[k] not in out]
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            got = self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)
            out.update((pieces[k], np.array(e.ids, "<u4").tobytes()) for k, e in zip(part, got, strict=True))
        return out


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, tokenizer: str, end: int = 2, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write token-id files and their manifest below ``path`` (by default a fresh shared path), which is returned."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-ids")
    with open(tokenizer, "rb") as f:  # a library's file on the driver; its bytes go to the workers
        spec = f.read()
    sent = spark.sparkContext.broadcast(spec)
    tail = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, keys, lengths, ids = Encoder.shared(sent.value), [], [], []
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = encoder.encode(byte_values(part.column(1)))
                keys += part.column(0).to_pylist()
                lengths += [len(x) // 4 + 1 for x in got]
                ids += [np.frombuffer(x + tail, "<u4").astype(f"<u{width}").tobytes() for x in got]
        if keys:
            context = TaskContext.get()
            files, root = _open(path)
            files.create_dir(root, recursive=True)
            name = f"ids-{context.partitionId():06d}.tidf"
            with files.open_output_stream(f"{root}/_{name}.{context.taskAttemptId()}") as out:
                out.write(pack_file(keys, lengths, ids, width))
            files.move(f"{root}/_{name}.{context.taskAttemptId()}", f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "part": context.partitionId(), "n_docs": len(keys), "n_ids": sum(lengths)}])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = sorted(rows.mapInArrow(run, "file string, part long, n_docs long, n_ids long").collect(), key=lambda r: r.part)  # a row per file
    starts = np.concatenate([[0], np.cumsum([r.n_ids for r in made], dtype=np.int64)])
    listed = [(r.file, int(s), r.n_docs, r.n_ids) for r, s in zip(made, starts, strict=False)]
    spark.createDataFrame(listed, "file string, start long, n_docs long, n_ids long").write.parquet(f"{path}/manifest")
    return path


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``, and the ids if asked, of every document of the files below ``path``."""
    manifest = spark.read.parquet(f"{path}/manifest")
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                files, root = _open(path)
                with files.open_input_file(f"{root}/{r['file']}") as f:
                    got = TokenFile(f.read())
                bounds, keys = got.bounds.select(np.arange(len(got) + 1)), got.doc_ids()
                for at in range(0, len(got), 4096):
                    some = range(at, min(at + 4096, len(got)))
                    parts = [got._ids[bounds[k] : bounds[k + 1]].astype("<u4") for k in some]
                    rows = {"doc_id": pa.array([keys[k] for k in some], pa.int64()), "start": pa.array(bounds[at : some.stop] + r["start"]), "n_tokens": pa.array(np.diff(bounds[at : some.stop + 1])), "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())}
                    if with_ids:
                        rows["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return manifest.select("file", "start").repartition(max(1, n)).mapInArrow(run, schema)
