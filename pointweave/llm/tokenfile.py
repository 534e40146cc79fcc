"""Token-ID files: ids of all texts in ascending doc_id order, in shards compressed by Re-Pair, with random access.

A file is a Parquet table of shards, written by Spark's own writer (so a lost task leaves nothing behind). A shard holds whole
documents of up to SHARD ids, cut out of one range of doc_ids; only a document longer than that is cut. Its columns:

    part, shard     the range's number (ascending doc_ids) and the shard's within it
    at, n_ids       the ids before it within the part, and its own
    nth             the number within the part of its first document
    doc_ids, n      its documents and how many ids each has here
    alphabet, ends, rules, lengths, sequence
                    the grammar (repair.py); little-endian unsigned 32-bit integers, rules in pairs

Texts go through the tokenizers library. Its normaliser and its pattern treat what stands between ASCII blanks by itself, so ids
are kept for such pieces of text as came before; equality with whole texts is tested.

Defined cases: a null text counts as empty and gives the end id alone; null doc_ids come last; rows of one doc_id are documents
of their own, in the order of their texts' hashes; no rows give an empty file. Other columns are not looked at. In memory are
a batch of texts and one shard.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Batches, lean, shared_folder
from .repair import Decoder, Grammar, compress

END, SHARD = 1, 1 << 20
#: Texts between blanks whose ids are kept: the longest, and how many at once.
LONGEST, KEPT = 64, 1 << 19
SCHEMA = "part int, shard int, at long, n_ids long, nth long, doc_ids array<long>, n array<long>, alphabet int, ends array<int>, rules binary, lengths binary, sequence binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_U32 = np.dtype("<u4")
_CRC = 0xEDB88320  # crc32's polynomial, lowest bit first
#: Graphic characters of Latin scripts: there the normaliser does nothing but lower case, and versions of Unicode agree on kinds.
_SIMPLE = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]+")
#: Fixed: the tokenizer's pattern, in these characters, and the letters that stand for bytes in its vocabulary.
_LETTER, _DIGIT = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}]+")
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PLAIN)}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _raw(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Ids(dict):
    """text between blanks -> its ids as bytes.

    Most pieces of text are Latin letters, digits and signs that the tokenizer's normaliser only puts in lower case; of these the words
    and signs are kept too, as the library's model gives them. The library's encode() takes all other pieces.
    """

    _own: dict[str, Ids] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if not piece:
            raw = b""
        elif _SIMPLE.fullmatch(piece) and "<|" not in piece and (piece.isascii() or unicodedata.is_normalized("NFC", piece)):
            known = self.words.get
            raw = b"".join([known(w) or self._word(w) for w in _PARTS.findall(piece.lower())])
        else:
            raw = _raw(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = raw
        return raw

    def _word(self, word: str) -> bytes:
        # graphic ASCII characters stand for themselves
        raw = _raw([t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))])
        if len(word) <= LONGEST:
            if len(self.words) >= KEPT:
                self.words.clear()
            self.words[word] = raw
        return raw

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    @classmethod
    def get(cls, path: str) -> Ids:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]


class _Shards:
    """Gathers documents of one part and gives shards as rows."""

    def __init__(self, part: int, alphabet: int, size: int):
        self.part, self.alphabet, self.size = part, alphabet, size
        self.shard = self.at = self.nth = self.held = 0
        self.docs: list[int | None] = []
        self.raw: list[bytes] = []

    def add(self, doc: int | None, raw: bytes) -> Iterator[tuple]:
        if self.held and self.held + len(raw) // 4 > self.size:
            yield self.row()
        for a in range(0, len(raw), 4 * self.size):
            if self.held >= self.size:
                yield self.row(whole=False)
            self.docs.append(doc)
            self.raw.append(raw[a : a + 4 * self.size])
            self.held += len(self.raw[-1]) // 4
        if self.held >= self.size:
            yield self.row()

    def row(self, whole: bool = True) -> tuple:
        """The shard at hand; whole says that its last document ends in it."""
        g = compress(np.frombuffer(b"".join(self.raw), _U32), self.alphabet)
        out = (self.part, self.shard, self.at, self.held, self.nth, self.docs, [len(x) // 4 for x in self.raw], g.alphabet, g.ends, g.rules.astype(_U32).tobytes(), g.lengths.astype(_U32).tobytes(), g.sequence.astype(_U32).tobytes())
        self.shard, self.at, self.nth = self.shard + 1, self.at + self.held, self.nth + len(self.docs) - (not whole)
        self.docs, self.raw, self.held = [], [], 0
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def shards(docs: DataFrame, tokenizer: str | None = None, end: int = END, size: int = SHARD) -> DataFrame:
    """SCHEMA's rows; docs: doc_id, text. tokenizer: a file's path on all nodes."""
    path = tokenizer or tokenizer_path()

    def run(batches: Batches) -> Batches:
        ids, last = Ids.get(path), np.asarray([end], _U32).tobytes()
        out = _Shards(TaskContext.get().partitionId(), max(ids.alphabet, end + 1), size)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in out.add(doc, ids.of(text.as_py() or "") + last):
                    yield _batch([row])
        if out.held:
            yield _batch([out.row()])

    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc(), F.col("copy").asc()]
    return flat.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(lean(run), SCHEMA)


def write(docs: DataFrame, folder: str | None = None, **options) -> str:  # noqa: ANN003
    """Writes docs' ids into folder (by default a new one in the shared folder) and returns it."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    shards(docs, **options).write.option("compression", "zstd").parquet(folder)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def _pieces(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per document and shard: part, nth, doc_id, at (ids before it within the part), n, crc (of its ids here), ids if asked for.

    A column `want` of files (places within the shard) limits it to these documents; only the symbols that cover them are decoded.
    """
    want = "want" in files.columns
    needed = ["part", "nth", "at", "doc_ids", "n", "alphabet", "ends", "rules", "lengths", "sequence", *(["want"] if want else [])]
    schema = "part int, nth long, doc_id long, at long, n long, crc long" + ", ids array<long>" * with_ids

    def run(batches: Batches) -> Batches:
        for b in batches:
            for i in range(b.num_rows):  # one shard at a time
                row = b.slice(i, 1).to_pylist()[0]
                rules, lengths, sequence = (np.frombuffer(row[c], _U32) for c in ("rules", "lengths", "sequence"))
                decoder = Decoder(Grammar(row["alphabet"], rules.reshape(-1, 2), lengths, row["ends"], sequence))
                begin = np.cumsum([0, *row["n"]])
                whole = None if want else decoder[:]
                places = sorted(row["want"]) if want else range(len(row["n"]))
                found = [(decoder[int(begin[k]) : int(begin[k + 1])] if want else whole[begin[k] : begin[k + 1]]) for k in places]
                columns = [
                    pa.array([row["part"]] * len(found), pa.int32()), pa.array([row["nth"] + k for k in places], pa.int64()), pa.array([row["doc_ids"][k] for k in places], pa.int64()),
                    pa.array([row["at"] + int(begin[k]) for k in places], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype(_U32).tobytes()) for x in found], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return files.select(*needed).mapInArrow(lean(run), schema)


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo crc32's, lowest power in the highest bit."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_CRC if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from their own and the second one's length."""
    shift, square = 1 << 31, 1 << 23  # x^0 and x^8
    while length:
        if length & 1:
            shift = _times(shift, square)
        square, length = _times(square, square), length >> 1
    return _times(first, shift) ^ second


def _starts(files: DataFrame) -> DataFrame:
    """(part, base): the ids before each part; a row a part, of which there are as many as the file's writer had tasks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded ids: start counts all ids before it."""
    files = read(spark, folder)
    docs = _pieces(files).groupBy("part", "nth").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for pieces in b.column(3).to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = joined_crc(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = docs.join(_starts(files), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "pieces")
    return placed.mapInArrow(lean(join), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(spark: SparkSession, folder: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of those in doc_ids (doc_id): then only their shards are decoded, and there only them."""
    files = read(spark, folder)
    if doc_ids is not None:
        place = ["part", "shard"]
        held = files.select(*place, F.posexplode("doc_ids").alias("k", "doc_id"))
        want = held.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").groupBy(*place).agg(F.collect_list("k").alias("want"))
        files = files.join(want, place)
    pieces = _pieces(files, with_ids=True).groupBy("part", "nth").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("pieces"))
    return pieces.select("doc_id", F.flatten("pieces.ids").alias("ids"))
