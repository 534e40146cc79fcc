"""Removal of repeated word sequences by matching statistics over a compressed FM-index.

A word goes if a window of WINDOW consecutive words that covers it also starts earlier: in a document with a smaller doc_id,
or before it in the same document. The plan of repeats.py brings the surroundings of equal anchors together. A shard indexes
the distinct ones (fmindex.py) and streams them through it: backward search from each window's end keeps the range of
suffixes that begin with the part read so far. A range of one suffix holds the document itself only, so every window with
that part is unique and is skipped; a range that lasts for the whole window names all places where it occurs.

Words are the runs of characters other than the six ASCII blanks, told apart by 64-bit hashes.
Defined cases: null text counts as empty; shorter documents stay whole; rows that share a doc_id count as one document, whose
rows all start at 0 (copies with one id do not shorten each other); null ids come after all others; an empty table gives no
rows. Memory is about 120 bytes for a byte of the longest text, or of a pack.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from ._common import U64, _powers, mix64, seeded, words_of
from .fmindex import FMIndex
from .suffix_dedup import ragged

WINDOW, GRAM = 20, 6
_MIX = seeded(GRAM, 900) | U64(1)


class Words:
    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.hashes, self.begin, self.end, self.offsets = words_of(data, offsets)
        self.n = len(self.hashes)

    def gram_hashes(self, a: int, z: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(sum((self.hashes[a + i : z + i] * _MIX[i] for i in range(GRAM)), np.zeros(z - a, U64)))

    def span_hash(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        size = y - x
        out = mix64(size)
        with np.errstate(over="ignore"):
            for i in range(int(size.max(initial=0))):
                on = np.flatnonzero(size > i)
                out[on] = mix64(out[on] * U64(3) + self.hashes[x[on] + i])
        return out


def distinct(symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places of the distinct windows, the window's number at each of begin); hashes find equal ones, symbols decide."""
    if not len(begin):
        return begin, begin
    name = np.zeros(len(begin), U64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            name = mix64(name * U64(3) + symbols[begin + i].astype(U64))
    _, first, same = np.unique(name, return_index=True, return_inverse=True)
    differ = np.zeros(len(begin), bool)
    for i in range(WINDOW):
        differ |= symbols[begin + i] != symbols[begin[first[same]] + i]
    same[differ] = len(first) + np.arange(int(differ.sum()))
    return np.concatenate([begin[first], begin[differ]]), same


class FMDedup(repeats.Method):
    shape = repeats.Shape(WINDOW, GRAM, by_start=True)

    def __init__(self, texts: bool = False):
        self.texts = texts
        self.schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")

    def symbols(self, pack: repeats.Pack) -> Words:
        return Words(pack.data, pack.offsets)

    def send(self, s: Words, begin: np.ndarray, end: np.ndarray) -> bytes:
        first, last = s.begin[begin], s.end[end - 1]
        sizes = (last - first).astype("<u4")
        return len(sizes).to_bytes(4, "little") + sizes.tobytes() + s.data[ragged(first, last)].tobytes()

    def solve(self, blobs: list[bytes], left: np.ndarray, right: np.ndarray, own: np.ndarray, rank: np.ndarray) -> np.ndarray:
        parts, sizes = [], []
        for b in blobs:
            n = int.from_bytes(b[:4], "little")
            bounds = np.concatenate([[0], np.cumsum(np.frombuffer(b, "<u4", n, 4), dtype=np.int64)])
            h, _, _, at = words_of(np.frombuffer(b, np.uint8, offset=4 + 4 * n), bounds)
            parts.append(h)
            sizes.append(np.diff(at))
        hashes, size = np.concatenate(parts), np.concatenate(sizes)
        at = np.concatenate([[0], np.cumsum(size)])
        # equal surroundings are indexed once, with the rank of the earliest
        n = len(left)
        power = _powers(int(size.max(initial=1)) + 1)[0]
        inner = np.arange(len(hashes)) - np.repeat(at[:-1], size)
        with np.errstate(over="ignore"):
            one = np.add.reduceat(mix64(hashes) * power[inner], at[:-1])
            two = np.add.reduceat(mix64(hashes ^ U64(0x5DEECE66D)) * power[inner], at[:-1])
            one = mix64(one + (left.astype(U64) << U64(40)) + own.astype(U64))
        order = np.lexsort((rank, two, one))
        new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
        some = order[new]
        kind = np.empty(n, np.int64)
        kind[order] = np.cumsum(new) - 1
        least = rank[some]
        out = np.where(rank > least[kind], own, np.uint32(0)).astype(np.uint32)

        words = hashes[ragged(at[some], at[some + 1])]
        sizes_, offsets = size[some], np.concatenate([[0], np.cumsum(size[some])])
        names, symbols = np.unique(words, return_inverse=True)
        index = FMIndex(symbols, offsets, len(names), int(sizes_.max(initial=0)))
        # the value of a suffix: the place in (document, start) order of the word it begins with
        column = index.order - (offsets + np.arange(len(offsets)))[index.text]
        value = np.append(least[index.text] - left[some][index.text] + column, np.iinfo(np.int64).max)
        found = self._stream(index, symbols, offsets, left[some], own[some])
        if not len(found[0]):
            return out
        which, back, low, high = found
        lows, of = np.unique(low, return_inverse=True)  # ranges of equal length are equal or apart
        highs = np.empty(len(lows), np.int64)
        highs[of] = high
        first = np.minimum.reduceat(value, np.stack([lows, highs], axis=1).reshape(-1))[::2]
        hit = first[of] < least[which] - back
        earlier = np.zeros(len(some), np.uint32)
        np.bitwise_or.at(earlier, which[hit], np.uint32(1) << back[hit].astype(np.uint32))
        return out | (earlier[kind] & own)

    def _stream(self, index: FMIndex, symbols: np.ndarray, offsets: np.ndarray, left: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, back, low, high) of the windows with at least two occurrences; a text's windows are tried from its start on.

        Equal windows are searched once.
        """
        span = self.shape.span
        back = np.arange(span - 1, -1, -1)
        wanted = ((own[:, None] >> back.astype(np.uint32)) & 1).astype(bool)  # by column: starts ascend
        text, column = np.nonzero(wanted)
        begin, same = distinct(symbols, offsets[text] + left[text] - back[column])
        kind = np.full(wanted.shape, -1, np.int64)
        kind[text, column] = same
        low, high, read = np.zeros(len(begin), np.int64), np.full(len(begin), index.total), np.full(len(begin), WINDOW)
        done = np.zeros(len(begin), bool)
        found: list[tuple[np.ndarray, ...]] = []
        which = np.arange(len(left))
        while len(which := which[wanted[which].any(axis=1)]):
            column = wanted[which].argmax(axis=1)
            of = kind[which, column]
            on = np.unique(of[~done[of]])
            done[on] = True
            for step in range(WINDOW - 1, -1, -1):
                if not len(on):
                    break
                low[on], high[on] = index.extend(symbols[begin[on] + step], low[on], high[on])
                lone = high[on] - low[on] < 2
                read[on[lone]] = step
                on = on[~lone]
            wanted[which, column] = False
            hit = read[of] == WINDOW
            found.append((which[hit], back[column[hit]], low[of[hit]], high[of[hit]]))
            # a part that occurs once, from word `read` of the window on, rules out all windows that hold it
            upto = (column + read[of])[~hit]
            wanted[which[~hit]] &= np.arange(span) > upto[:, None]
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def rows(self, pack: repeats.Pack, s: Words, repeated: np.ndarray) -> pa.RecordBatch:
        stays, removed, _ = repeats.covered(repeated, WINDOW, s.offsets)
        raw, kept, counts = pack.data.tobytes(), [], np.diff(s.offsets)
        for d, (x, y) in enumerate(zip(pack.offsets[:-1].tolist(), pack.offsets[1:].tolist(), strict=True)):
            words = raw[x:y].split()
            if removed[d]:
                words = list(itertools.compress(words, stays[s.offsets[d] : s.offsets[d + 1]].tolist()))
            kept.append(b" ".join(words))
        ids = pa.array(pack.ids, pa.int64(), mask=pack.null.astype(bool))
        cols = [ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()), *([pa.array(kept, pa.binary()).cast(pa.string())] if self.texts else [])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if self.texts else [])])


def remove(docs: DataFrame, texts: bool = False, **plan: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs (doc_id, text), and kept with texts."""
    return repeats.find(docs, FMDedup(texts), **plan)
