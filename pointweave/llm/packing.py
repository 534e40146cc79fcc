"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Documents are tokenised and cut into pieces of at most `capacity` tokens (only longer documents are cut; the first piece may
be shorter). Pieces are placed by decreasing length, each into the open sequence with the least room that still holds it;
the segment tree over the remaining capacities 0..capacity finds that room in logarithmic time. Pieces of one length are
alike, so it is enough to place the counts of pieces by length: sequences with the same room form ranges of numbers, and
one step fills a whole range as best-fit would do one by one. That plan is as small as the capacity, not as the corpus.
Each piece then finds its sequence and offset by its rank among the pieces of its length; ranks are counted within hash
ranges (chunks) and added up from the chunks before, so that no task holds a length's pieces.

Defined cases: a null text counts as empty and gives the end token alone; repeated rows are separate documents; an empty
table gives no rows. Only counts by length reach the driver.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, lean

CAPACITY, END, CHUNKS = 2048, 0, 1 << 14
SPECIAL, RUN = "<|endoftext|>", 100_000
#: What \s is in the tokenizer's pattern; Python's has four separators more.
_BLANK_RUN = re.compile(r"[^\S\x1c-\x1f]+")


class Tree:
    """Segment tree over capacities; each leaf is true where a range of sequences has that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, room: int, there: bool) -> None:
        i = room + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def least(self, room: int) -> int:
        """The least capacity >= room that is there, or -1."""
        i = room + self.size
        if self.any[i]:
            return room
        while i > 1 and (i % 2 or not self.any[i + 1]):
            i //= 2
        if i <= 1:
            return -1
        i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


@dataclass(frozen=True)
class Step:
    """Pieces of one length, ranks rank.. on: `per` in a row into each of `count` sequences from `first`, at `offset`."""

    length: int
    rank: int
    first: int
    count: int
    per: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Best-fit decreasing over counts of pieces by length."""
    tree, rooms, steps, opened = Tree(capacity), {}, [], 0  # rooms: capacity -> ranges (first, count) of sequences

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if not rooms.setdefault(room, []):
                tree.put(room, True)
            rooms[room].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least(length)
            if room < 0:  # nothing fits: open as many as this length fills
                room, per = capacity, capacity // length
                first, count = opened, max(1, left // per)
                opened += count
            else:
                first, count = rooms[room].pop()
                if not rooms[room]:
                    tree.put(room, False)
                per = room // length
            # the tightest sequence stays the tightest until it is full, so each takes `per` in a row
            use = min(count, left // per)
            if use:
                steps.append(Step(length, rank, first, use, per, capacity - room))
                add(room - per * length, first, use)
                rank, left = rank + use * per, left - use * per
            if left and use < count:  # fewer than `per` are left
                steps.append(Step(length, rank, first + use, 1, left, capacity - room))
                add(room - left * length, first + use, 1)
                use, left = use + 1, 0
            add(room, first + use, count - use)
    return steps


class _Encoder:
    _own: dict[str, _Encoder] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = len(ranks)

    def encode(self, text: str) -> list[int]:
        """The ids of `tokenizers`: SPECIAL is one id, and what stands between its copies is encoded by itself."""
        if SPECIAL not in text:
            return self.ordinary(text)
        ids: list[int] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                ids.append(self.special)
            ids += self.ordinary(part)
        return ids

    def ordinary(self, text: str) -> list[int]:
        """Runs of RUN blanks or more are too deep for the pattern's backtracking: the piece it would take of one is cut here."""
        if len(text) < RUN:
            return self.core.encode_ordinary(text)
        ids, at = [], 0
        for m in _BLANK_RUN.finditer(text):
            if m.end() - m.start() >= RUN:
                # the last blank goes with what follows, if anything does
                end = m.end() - (m.end() < len(text))
                ids += self.core.encode_ordinary(text[at : m.start()])
                ids += self.core.encode_single_piece(text[m.start() : end].encode())
                at = end
        return ids + self.core.encode_ordinary(text[at:])

    @classmethod
    def get(cls, path: str) -> _Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]


def ranks_path() -> str:
    """The rank file with the same vocabulary as byte_bpe_50k.json; its encoder gives the same ids three times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, key) for every piece; docs: doc_id, text. tokenizer: a rank file's path on all nodes."""
    path = tokenizer or ranks_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "key"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _Encoder.get(path).encode
        for b in batches:
            rows = []
            for doc, text, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = encode(text) if text else []
                ids.append(end)
                raw, n = array("I", ids).tobytes(), len(ids)
                if n <= capacity:
                    rows.append((doc, 0, 0, n, zlib.crc32(raw), key))
                    continue
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc, i, a, z - a, zlib.crc32(raw[4 * a : 4 * z]), key) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit("pack"), "doc_id", "text").alias("key"))
    return source.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, key long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    cutted = cut(pieces(docs, tokenizer, capacity, end))
    chunk = cutted.withColumn("chunk", F.shiftrightunsigned("key", 64 - int(math.log2(CHUNKS))).cast("int"))
    per = chunk.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = per.select("length", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = {int(r["length"]): int(r["n"]) for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    steps = best_fit(counts, capacity)
    own = Window.partitionBy("length", "chunk").orderBy("key", "doc_id", "piece")
    ranked = chunk.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "chunk"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    # steps by length, then rank: a piece's step is the last one that begins at or before it
    steps.sort(key=lambda s: (s.length, s.rank))
    plan = np.array([(s.length, s.rank, s.first, s.count, s.per, s.offset) for s in steps], np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, count, per, offset = shared.value.T
        spans = (np.searchsorted(length, np.arange(capacity + 1)), np.searchsorted(length, np.arange(capacity + 1), side="right"))
        for b in batches:
            n, r = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.empty(len(n), np.int64)
            for x in np.unique(n):
                mine, (lo, hi) = n == x, (spans[0][x], spans[1][x])
                at[mine] = lo + np.searchsorted(rank[lo:hi], r[mine], side="right") - 1
            place_in = r - rank[at]
            seq = first[at] + place_in // per[at]
            off = offset[at] + place_in % per[at] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names)

    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
