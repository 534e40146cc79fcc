"""A compressed FM-index over texts of whole-number symbols, and backward search for many patterns at once.

The suffix order comes from prefix doubling; every text ends with a separator of its own, less than all symbols. The
Burrows-Wheeler transform is held in a wavelet tree laid out level by level (bits packed in 64-bit words with running
counts), so a step of backward search is two rank queries a level.
"""

from __future__ import annotations

import numpy as np

from ._common import U64


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.n, self.ones = n, int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(U64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U64(1) << bit) - U64(1)))


class Wavelet:
    """Wavelet tree, one bit vector a level: zeros go left, ones right, stably."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels, self.depth = [], max(1, int(sigma - 1).bit_length())
        v = values
        for d in range(self.depth - 1, -1, -1):
            bit = ((v >> d) & 1).astype(bool)
            self.levels.append((d, Bits(bit), int((~bit).sum())))
            v = np.concatenate([v[~bit], v[bit]])
        # where the symbols' runs begin in the last order, which is by the bits read backwards
        symbol, base = np.arange(sigma), np.zeros(sigma, np.int64)
        for d, bits, zeros in self.levels:
            b = bits.rank(base)
            base = np.where(((symbol >> d) & 1).astype(bool), zeros + b, base - b)
        self.base = base

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before low and before high."""
        for d, bits, zeros in self.levels:
            one = ((symbol >> d) & 1).astype(bool)
            l, h = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + l, low - l)
            high = np.where(one, zeros + h, high - h)
        return low - self.base[symbol], high - self.base[symbol]


class FMIndex:
    """Over texts that lie end to end: symbols (0..sigma-1) and the n + 1 offsets."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, sigma: int, longest: int):
        texts, n = len(offsets) - 1, len(symbols)
        total = n + texts
        end = offsets[1:] + np.arange(texts)  # places of the separators
        full = np.empty(total, np.int64)
        inside = np.ones(total, bool)
        inside[end] = False
        full[end], full[inside] = np.arange(texts), symbols + texts
        # the first order is by as many symbols as fit into 62 bits, then each step doubles them
        width = max(1, int(texts + sigma).bit_length())
        step = max(1, 62 // width)
        padded = np.concatenate([full + 1, np.zeros(step, np.int64)])
        key = np.zeros(total, np.int64)
        for i in range(step):
            key = key << width | padded[i : i + total]
        while True:  # suffixes differ within longest + 1 symbols, as separators do
            self.order = np.argsort(key)
            sorted_key = key[self.order]
            fresh = np.zeros(total, np.int64)
            np.cumsum(sorted_key[1:] != sorted_key[:-1], out=fresh[1:])
            if total == 0 or int(fresh[-1]) == total - 1 or step > longest + 1:
                break
            rank = np.empty(total, np.int64)
            rank[self.order] = fresh
            after = np.concatenate([rank[step:], np.full(min(step, total), -1)])
            key = rank * np.int64(total + 1) + after + 1
            step *= 2
        # separators are never searched for: in the transform they share symbol 0
        last = full[self.order - 1]
        self.wavelet = Wavelet(np.where(last < texts, 0, last - texts + 1), sigma + 1)
        self.begin = texts + np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.text = np.searchsorted(end, self.order)  # the text that each suffix lies in
        self.total = total

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of symbol + pattern, from those of pattern."""
        a, b = self.wavelet.ranks(symbol + 1, low, high)
        return self.begin[symbol] + a, self.begin[symbol] + b
