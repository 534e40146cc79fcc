"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller doc_id. The plan of repeats.py
brings the surroundings of equal anchors together; a shard sorts them from the anchor on with the deep-shallow sorter (the
anchors' common GRAM bytes are the shallow depth), which also puts equal surroundings next to each other, and then sorts the
windows of surroundings that differ. Equal neighbours in suffix order share their least document.

Defined cases: null text counts as empty; texts shorter than WINDOW bytes stay whole; documents with equal ids are neither
smaller, so they do not shorten each other; null ids come after all others; an empty table gives no rows. Memory is about
60 bytes for a byte of the longest text, or of a pack.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from ._common import U64, mix64
from .suffixes import deep_shallow, letters

WINDOW, GRAM, CHUNK = 50, 24, 200_000
WIDEST = 2 * WINDOW - GRAM  # bytes of a place's surroundings, at most


class Bytes:
    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n, self.data, self.offsets = len(data), data, offsets
        padded = np.concatenate([data, np.zeros(WIDEST + 8, np.uint8)])
        self.words = np.ndarray(self.n + WIDEST + 1, "<u8", buffer=padded.data, strides=(1,))

    def gram_hashes(self, a: int, z: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self.words[a:z] * U64(0x9E3779B97F4A7C15)
            x ^= x >> U64(29)
            x += self.words[a + 8 : z + 8] * U64(0xC2B2AE3D27D4EB4F)
            x ^= x >> U64(31)
            x += self.words[a + 16 : z + 16] * U64(0xD6E8FEB86659FD93)
            return mix64(x + U64(0x165667B19E3779F9))  # not 0 for zero bytes

    def span_hash(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Eight bytes at a time; what lies behind the end is masked."""
        size = y - x
        out = mix64(size)
        with np.errstate(over="ignore"):
            for i in range(0, WIDEST, 8):
                left = np.clip(size - i, 0, 8)
                word = np.where(left > 0, self.words[np.minimum(x + i, self.n)] << ((8 - left) * 8).astype(U64) % U64(64), U64(0))
                out = mix64(out * U64(3) + word)
        return out


def ragged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places begin..end-1 of many runs, end to end."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class SuffixDedup(repeats.Method):
    shape = repeats.Shape(WINDOW, GRAM, by_start=False)

    def __init__(self, texts: bool = False):
        self.texts = texts
        self.schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")

    def symbols(self, pack: repeats.Pack) -> Bytes:
        return Bytes(pack.data, pack.offsets)

    def send(self, s: Bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
        return s.data[ragged(begin, end)].tobytes()

    def solve(self, blobs: list[bytes], left: np.ndarray, right: np.ndarray, own: np.ndarray, rank: np.ndarray) -> np.ndarray:
        n, span = len(left), self.shape.span
        data = np.frombuffer(b"".join(blobs), np.uint8)
        size, width = left + right, span - 1 + WINDOW
        rows = np.zeros((n, width + 6), np.uint8)
        row = np.arange(n) * (width + 6)
        rows.reshape(-1)[ragged(row + span - 1 - left, row + span - 1 + right)] = data
        rows[:, width], rows[:, width + 1] = left, right
        rows[:, width + 2 :] = np.ascontiguousarray(own, "<u4").view(np.uint8).reshape(n, 4)
        # suffixes at the anchors, then what stands before them
        words = letters(np.concatenate([rows[:, span - 1 : width], rows[:, : span - 1], rows[:, width:]], axis=1))
        order, new = deep_shallow(words, GRAM // 8)
        heads = np.flatnonzero(new)
        kind = np.empty(n, np.int64)
        kind[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(rank[order], heads)
        out = np.where(rank > least[kind], own, np.uint32(0)).astype(np.uint32)
        # different surroundings of one anchor can still share windows
        some = order[heads]  # one place of each kind
        head_words = words[some, : GRAM // 8]
        group = np.cumsum(np.append(True, (head_words[1:] != head_words[:-1]).any(axis=1))) - 1
        mixed = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(mixed):
            return out
        earlier = np.zeros(len(some), np.uint32)
        # anchor by anchor, as many at once as fit into CHUNK windows
        total = np.cumsum(np.bitwise_count(own[some[mixed]]).astype(np.int64))
        ends = np.flatnonzero(np.append(group[mixed][1:] != group[mixed][:-1], True)) + 1
        a = 0
        while a < len(mixed):
            z = int(ends[max(np.searchsorted(total[ends - 1], (total[a - 1] if a else 0) + CHUNK, side="right") - 1, np.searchsorted(ends, a, side="right"))])
            self._windows(rows, some[mixed[a:z]], mixed[a:z], own, least, earlier)
            a = z
        return out | (earlier[kind] & own)

    def _windows(self, rows: np.ndarray, places: np.ndarray, kinds: np.ndarray, own: np.ndarray, least: np.ndarray, earlier: np.ndarray) -> None:
        """Sorts the windows of some kinds and sets, in `earlier`, those that a kind with a lesser document has too."""
        span, width = self.shape.span, rows.shape[1]
        i, back = np.nonzero((own[places, None] >> np.arange(span, dtype=np.uint32)) & 1)
        views = np.lib.stride_tricks.sliding_window_view(rows.reshape(-1), WINDOW)
        order, new = deep_shallow(letters(views[places[i] * width + span - 1 - back]), GRAM // 8)
        heads = np.flatnonzero(new)
        mine = least[kinds[i]]
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(mine[order], heads), np.diff(heads, append=len(order)))
        hit = first < mine
        np.bitwise_or.at(earlier, kinds[i[hit]], np.uint32(1) << back[hit].astype(np.uint32))

    def rows(self, pack: repeats.Pack, s: Bytes, repeated: np.ndarray) -> pa.RecordBatch:
        kept, removed, runs = repeats.covered(repeated, WINDOW, pack.offsets)
        sizes, n = np.diff(pack.offsets), len(pack.ids)
        left, at = pack.data[kept].tobytes(), np.concatenate([[0], np.cumsum(sizes - removed)])
        texts = [left[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        ids = pa.array(pack.ids, pa.int64(), mask=pack.null.astype(bool))
        cols = [ids, sizes, removed, runs, [hashlib.sha256(t).hexdigest() for t in texts], *([pa.array(texts, pa.binary())] if self.texts else [])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if self.texts else [])]
        assert n == len(texts)
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)


def remove(docs: DataFrame, texts: bool = False, **plan: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text), and kept (binary) with texts."""
    return repeats.find(docs, SuffixDedup(texts), **plan)
