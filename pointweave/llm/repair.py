"""Re-Pair over an array of ids: frequent pairs of neighbours are replaced by new symbols, round after round.

A round counts all pairs, takes the most frequent ones together and replaces their occurrences from left to right; where two
chosen pairs overlap, the left one is taken. A pair that is used fewer than LEAST times then gets no rule. Rules come with
the number of ids that each stands for, so any range of ids is decoded from the symbols that cover it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rounds and new symbols a round, at most: they bound the time, all ids are encoded in any case.
ROUNDS, BATCH = 4, 3900
#: Uses that a rule is worth.
LEAST = 6


@dataclass(frozen=True)
class Grammar:
    """Symbols below `alphabet` are ids; symbol alphabet + j stands for rules[j]. ends: the rules there are after each round."""

    alphabet: int
    rules: np.ndarray
    lengths: np.ndarray
    ends: list[int]
    sequence: np.ndarray

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offset, length) so that symbol s stands for ids[offset[s] :][: length[s]]; rules follow from those of earlier rounds."""
        length = np.concatenate([np.ones(self.alphabet, np.int64), self.lengths.astype(np.int64)])
        offset = np.cumsum(length) - length
        ids = np.empty(int(length.sum()), np.uint32)
        ids[: self.alphabet] = np.arange(self.alphabet, dtype=np.uint32)
        a = 0
        for z in self.ends:
            both = self.rules[a:z].reshape(-1)
            begin = int(offset[self.alphabet + a]) if z > a else 0
            ids[begin : begin + int(length[both].sum())] = ids[spans(offset[both], length[both])]
            a = z
        return ids, offset, length


def spans(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """offset[0], offset[0] + 1, .. (length[0] of them), offset[1], .."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offset - ends + length, length)


def _found(keys: np.ndarray, chosen: np.ndarray, bits: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """(places, which): where keys hold one of chosen, and which one. Of chosen keys that share a hash the first counts."""
    wide = keys.dtype.type
    slot = lambda x: (x * wide(0x9E3779B1 if wide is np.uint32 else 0x9E3779B97F4A7C15) >> wide(x.itemsize * 8 - bits)).astype(np.int64)
    table = np.full(1 << bits, -1, np.int32)
    table[slot(chosen[::-1])] = np.arange(len(chosen) - 1, -1, -1, dtype=np.int32)
    guess = table[slot(keys)]
    at = np.flatnonzero(guess >= 0)
    which = guess[at]
    same = chosen[which] == keys[at]
    return at[same], which[same]


def compress(ids: np.ndarray, alphabet: int, rounds: int = ROUNDS, batch: int = BATCH, least: int = LEAST) -> Grammar:
    """A grammar of ids (all below alphabet)."""
    top = alphabet + rounds * batch
    wide, bits = (np.uint32, 16) if top <= 1 << 16 else (np.uint64, 32)
    half = wide(bits)
    seq = ids.astype(wide)
    rules, ends, symbols = [np.zeros((0, 2), wide)], [], alphabet
    lengths = np.ones(alphabet, np.int64)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        key = seq[:-1] << half | seq[1:]
        ordered = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(count >= least)
        often = often[np.argsort(-count[often], kind="stable")[:batch]]
        chosen = ordered[first[often]]
        if not len(chosen):
            break
        at, which = _found(key, chosen)
        # of places in a row every other one is free
        fresh = np.concatenate([[True], np.diff(at) > 1])
        begin = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        free = (at - begin) % 2 == 0
        at, which = at[free], which[free]
        worth = np.bincount(which, minlength=len(chosen)) >= least
        at, which = at[worth[which]], which[worth[which]]
        if not len(at):
            break
        pairs = np.stack([chosen[worth] >> half, chosen[worth] & wide((1 << bits) - 1)], 1)
        seq[at] = (symbols + (np.cumsum(worth) - 1)[which]).astype(wide)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        rules.append(pairs)
        lengths = np.concatenate([lengths, lengths[pairs[:, 0].astype(np.int64)] + lengths[pairs[:, 1].astype(np.int64)]])
        symbols += len(pairs)
        ends.append(symbols - alphabet)
    return Grammar(alphabet, np.concatenate(rules).astype(np.uint32), lengths[alphabet:].astype(np.uint32), ends, seq.astype(np.uint32))


class Decoder:
    """Random access to the ids of a grammar."""

    def __init__(self, grammar: Grammar):
        self.sequence = grammar.sequence
        self.ids, self.offset, self.length = grammar.flat()
        self.ends = np.cumsum(self.length[self.sequence])

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, part: slice) -> np.ndarray:
        """ids[a:z], from the symbols that cover it."""
        a, z, _ = part.indices(len(self))
        if a >= z:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.ends, a, side="right"), np.searchsorted(self.ends, z, side="left") + 1
        cover = self.sequence[i:j]
        before = int(self.ends[i - 1]) if i else 0
        return self.ids[spans(self.offset[cover], self.length[cover])][a - before : z - before]
