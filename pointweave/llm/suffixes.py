"""Deep-shallow sorting of strings held as rows of big-endian 64-bit letters.

Shallow part: a radix pass on the first two bytes, then multikey quicksort on eight-byte letters; all segments are split at
once, by three-way partitioning around each segment's middle element, until a segment is one string or `shallow` letters
deep. Deep part: the segments that are left have long common prefixes; each becomes a blind trie, built breadth first: a
node skips the prefix its strings share and branches on the one byte after it, without looking at the bytes between.
"""

from __future__ import annotations

import numpy as np

from ._common import U64


def letters(rows: np.ndarray) -> np.ndarray:
    """n by width bytes as n by ceil(width / 8) big-endian letters, padded with zeros."""
    n, width = rows.shape
    if width % 8:
        rows = np.concatenate([rows, np.zeros((n, -width % 8), np.uint8)], axis=1)
    return np.ascontiguousarray(rows).view(">u8").astype(U64)


def _split(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable three-way partition of segments by values (0, 1, 2, in order of position); returns counts of 0 and of 1.

    order is changed in place. values lie segment after segment.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    low, same = values == 0, values == 1
    cum_low, cum_same = np.concatenate([[0], np.cumsum(low)]), np.concatenate([[0], np.cumsum(same)])
    n_low, n_same = cum_low[ends] - cum_low[begins], cum_same[ends] - cum_same[begins]
    seg = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values))
    before_low = cum_low[:-1] - cum_low[begins][seg]
    before_same = cum_same[:-1] - cum_same[begins][seg]
    inner = place - begins[seg]
    to = np.where(low, before_low, np.where(same, n_low[seg] + before_same, n_low[seg] + n_same[seg] + inner - before_low - before_same))
    at = np.repeat(starts - begins, sizes) + place
    moved = order[at]
    order[starts[seg] + to] = moved
    return n_low, n_same


def deep_shallow(words: np.ndarray, shallow: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): order sorts the rows; new marks, in that order, the first row of each group of equal rows."""
    n, width = words.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    top = (words[:, 0] >> U64(48)).astype(np.uint16)
    order = np.argsort(top, kind="stable")
    sorted_top = top[order]
    starts = np.flatnonzero(np.append(True, sorted_top[1:] != sorted_top[:-1]))
    sizes, depths = np.diff(starts, append=n), np.zeros(len(starts), np.int64)
    new = np.zeros(n, bool)
    new[starts] = True
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        down = (depths >= min(shallow, width)) & (sizes > 1)
        if down.any():
            deep.append((starts[down], sizes[down]))
        on = (sizes > 1) & ~down
        starts, sizes, depths = starts[on], sizes[on], depths[on]
        if not len(starts):
            break
        begins = np.cumsum(sizes) - sizes
        at = np.repeat(starts - begins, sizes) + np.arange(sizes.sum())
        value = words[order[at], np.repeat(depths, sizes)]
        pivot = np.repeat(value[begins + sizes // 2], sizes)
        kind = (value >= pivot).astype(np.int8) + (value > pivot)
        n_low, n_same = _split(order, starts, sizes, kind)
        n_high = sizes - n_low - n_same
        starts = np.concatenate([starts, starts + n_low, starts + n_low + n_same])
        sizes = np.concatenate([n_low, n_same, n_high])
        depths = np.concatenate([depths, depths + 1, depths])
        new[starts[sizes > 0]] = True
        starts, depths, sizes = starts[sizes > 0], depths[sizes > 0], sizes[sizes > 0]
    if deep and width > shallow:
        _blind(words, order, new, np.concatenate([d[0] for d in deep]), np.concatenate([d[1] for d in deep]), shallow)
    return order, new


def _blind(words: np.ndarray, order: np.ndarray, new: np.ndarray, starts: np.ndarray, sizes: np.ndarray, skip: int) -> None:
    """Orders segments that agree in their first `skip` letters by blind tries, one level of branches a round."""
    width = words.shape[1]
    while len(starts):
        begins = np.cumsum(sizes) - sizes
        at = np.repeat(starts - begins, sizes) + np.arange(sizes.sum())
        rows, first = order[at], np.repeat(order[starts], sizes)
        # where a segment's strings first differ: the least letter in which any of them differs from the first one
        letter = np.full(len(starts), width, np.int64)
        differs = np.zeros(len(starts), U64)
        for j in range(width - 1, skip - 1, -1):
            x = np.bitwise_or.reduceat(words[rows, j] ^ words[first, j], begins)
            hit = x != 0
            letter[hit], differs[hit] = j, x[hit]
        on = letter < width  # the others hold equal strings
        if not on.all():
            starts, sizes, letter, differs = starts[on], sizes[on], letter[on], differs[on]
            if not len(starts):
                return
            begins = np.cumsum(sizes) - sizes
            at = np.repeat(starts - begins, sizes) + np.arange(sizes.sum())
            rows = order[at]
        shift = np.zeros(len(starts), U64)  # of the first byte with a difference
        for s in range(0, 64, 8):
            shift[(differs >> U64(s)) != 0] = s
        seg = np.repeat(np.arange(len(starts)), sizes)
        branch = (words[rows, letter[seg]] >> shift[seg]) & U64(255)
        to = np.argsort(seg.astype(np.int64) * 256 + branch.astype(np.int64), kind="stable")
        order[at] = rows[to]
        key = (seg * 256 + branch.astype(np.int64))[to]
        fresh = np.append(True, key[1:] != key[:-1])
        new[at[fresh]] = True
        heads = np.flatnonzero(fresh)
        sizes = np.diff(heads, append=len(at))
        starts = at[heads]
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
