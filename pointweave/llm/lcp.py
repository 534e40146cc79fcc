"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed level by level: runs of a repeated symbol are folded, deterministic coin tossing turns the
sequence into labels that depend on a few neighbours only, local maxima of the labels start phrases, and a phrase is named
by a 64-bit hash of its symbols. Equal substrings therefore get equal names except near their ends, wherever they stand.
The fingerprint is the bottom-SIZE sketch of the names of level 2 and above (and of the root), as 32-bit hex words in
ascending order; the likeness of two fingerprints estimates the Jaccard resemblance of those name sets.

Defined cases: null text counts as empty; an empty text has the empty fingerprint, like 1 to another empty one and 0 to any
other; equal texts have equal fingerprints. Memory is about 80 bytes for a byte of the longest text in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, bytes_of, mix64, sha

SIZE = 64
CHUNK = 1 << 19
_R = U64(0x2545F4914F6CDD1D | 1)
_RINV = U64(pow(int(_R), -1, 1 << 64))


def _toss(width: int) -> np.ndarray:
    """table[a * width + b]: 2 * (lowest bit in which b differs from a) + that bit of b."""
    a, b = np.meshgrid(np.arange(width), np.arange(width), indexing="ij")
    low = (a ^ b) & -(a ^ b)
    place = np.where(a == b, 0, np.bitwise_count(np.maximum(low, 1) - 1))
    return (2 * place + ((b >> place) & 1)).astype(np.uint8).ravel()


_TOSS = {w: _toss(w) for w in (256, 128, 16, 8)}


def _powers(n: int, _kept: list = [np.ones(1, U64), np.ones(1, U64)]) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(_kept[0]) < n:
        with np.errstate(over="ignore"):
            for i, r in enumerate((_R, _RINV)):
                x = np.full(n, r, U64)
                x[0] = 1
                _kept[i] = np.cumprod(x, dtype=U64)
    return _kept[0], _kept[1]


def _narrow(labels: np.ndarray, width: int) -> np.ndarray:
    at = labels.astype(np.uint16)
    out = np.empty_like(labels)
    _TOSS[width].take(at[:-1] * np.uint16(width) + at[1:], out=out[1:], mode="clip")
    out[:1] = labels[:1] & 1
    return out


def _byte_names(data: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of data[p:p + length], read eight bytes at a time."""
    words = np.ndarray(len(data), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    mask = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
    names = mix64((words[p] & mask.take(length, mode="clip")) + length.astype(U64) * U64(0x9E3779B97F4A7C15))
    at, done = np.flatnonzero(length > 8), 8
    while len(at):
        names[at] = mix64(names[at] * U64(3) + (words[p[at] + done] & mask.take(length[at] - done, mode="clip")))
        done += 8
        at = at[length[at] > done]
    return names


def _level(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and document starts of the next level; first marks the first symbol of each document."""
    new = np.empty(len(sym), bool)
    new[0] = True
    np.not_equal(sym[1:], sym[:-1], out=new[1:])
    new |= first
    at = np.flatnonzero(new)
    folded = len(at) < len(sym)
    s, f = (sym[at], first[at]) if folded else (sym, first)
    n = len(s)
    if sym.dtype == np.uint8:
        labels = np.empty(n, np.uint8)
        _TOSS[256].take((s[:-1].astype(np.uint16) << 8) | s[1:], out=labels[1:], mode="clip")
        labels[0] = 0
        labels = _narrow(labels, 16)
    else:
        x = np.empty(n, U64)
        x[0] = 1
        np.bitwise_xor(s[1:], s[:-1], out=x[1:])
        x[x == 0] = 1
        low = np.bitwise_count((x & (~x + U64(1))) - U64(1))
        labels = low * np.uint8(2) + ((s >> low) & U64(1)).astype(np.uint8)
        labels = _narrow(_narrow(labels, 128), 16)
    # A document's first labels must not depend on the document before it.
    starts = np.flatnonzero(f)
    for back in range(2 if sym.dtype == np.uint8 else 3):
        at2 = starts + back
        at2 = at2[at2 < n]
        labels[at2] = (s[at2] & s.dtype.type(3)).astype(np.uint8)
    begin = np.zeros(n, bool)
    if n > 2:
        begin[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
        begin[1:] &= ~f[:-1]  # no phrase of one symbol at a document's start
        begin[:-1] &= ~f[1:]  # nor at its end
    begin |= f
    p = np.flatnonzero(begin)
    if sym.dtype == np.uint8:
        whole = at[p]
        return _byte_names(sym, whole, np.diff(whole, append=len(sym))), f[p]
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        value = s * power[:n]
        if folded:
            run = np.diff(at, append=len(sym))
            more = np.flatnonzero(run > 1)
            value[more] = mix64(s[more] + run[more].astype(U64) * U64(0x9E3779B97F4A7C15)) * power[more]
        names = mix64(np.add.reduceat(value, p) * inverse[p] + np.diff(p, append=n).astype(U64))
    return names, f[p]


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each document, data[offsets[i]:offsets[i + 1]], the ascending 32-bit words of its fingerprint."""
    n = len(offsets) - 1
    out = [np.zeros(0, np.uint32)] * n
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    first = np.zeros(len(data), bool)
    first[offsets[:-1][full]] = True
    sym, doc, level, found = data, full, 0, []
    while True:
        sym, first = _level(sym, first)
        level += 1
        owner = doc[np.cumsum(first) - 1]
        count = np.diff(np.flatnonzero(first), append=len(sym))
        root = np.repeat(count == 1, count)
        take = np.ones(len(sym), bool) if level >= 2 else root
        found.append((owner[take].astype(U64) << U64(32)) | (mix64(sym[take] + U64(level)) >> U64(32)))
        sym, first = sym[~root], first[~root]
        doc = doc[count > 1]
        if not len(sym):
            break
    keys = np.concatenate(found)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    owner = (keys >> U64(32)).astype(np.int64)
    at = np.searchsorted(owner, full)
    end = np.searchsorted(owner, full, side="right")
    words = keys.astype(np.uint32)
    for d, a, b in zip(full.tolist(), at.tolist(), end.tolist(), strict=True):
        out[d] = words[a : min(b, a + SIZE)]
    return out


def text_of(words: np.ndarray) -> str:
    return words.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bottom-k estimate of the Jaccard resemblance, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and a.tobytes() == b.tobytes():
        return 1.0
    every = np.concatenate([a, b])
    every.sort()
    twice = every[1:] == every[:-1]
    n = len(every) - int(twice.sum())
    if len(a) < SIZE and len(b) < SIZE or n <= SIZE:
        return (len(every) - n) / n
    place = np.arange(1, len(every)) - np.cumsum(twice)  # of every[1:] among the distinct words
    return int(twice[place < SIZE].sum()) / SIZE


def fingerprints_of(texts: list[bytes]) -> list[np.ndarray]:
    """Fingerprints of many texts, a chunk of about CHUNK bytes at a time."""
    out, own, size = [], [], 0
    for t in [*texts, None]:
        if own and (t is None or size + len(t) > CHUNK):
            out += sketches(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]))
            own, size = [], 0
        if t is not None:
            own.append(t)
            size += len(t)
    return out


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column; one pass, no shuffle. A column named out is replaced."""
    rest = docs.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = bytes_of(b.column(b.schema.get_field_index(text)))
            raw = data.tobytes()
            got = fingerprints_of([raw[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_of(g) for g in got], pa.string())], [*b.schema.names, out])

    return rest.mapInArrow(run, schema)


def _splits(docs: DataFrame, rows: int, most: int, over: int = 4) -> np.ndarray:
    """Ascending ids at which buckets of about `rows` rows start; each is the id of a row, the first is the least."""
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("key")
    ids = docs.select(key)
    n, least = ids.agg(F.count("*"), F.min("key")).first()
    if not n:
        return np.zeros(0, np.int64)
    step = max(1, n // (over * max(1, min(n // rows, most))))
    got = [r[0] for r in ids.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).distinct().collect()]
    return np.unique(np.array([least, *sorted(got)[over // 2 :: over]], np.int64))


def with_next(docs: DataFrame, rows: int = 64, most: int = 100_000) -> DataFrame:
    """Rows (bucket, look, doc_id, text) dealt so that a row's next in (doc_id, text) order follows it in its partition.

    Buckets start at ids of a bounded sample (at most `most` of them); the first row of a bucket also goes to the one
    before as look-ahead (look 1), and the first of all to the last (look 2). One shuffle of the texts.
    """
    at = _splits(docs, rows, most)
    where = docs.sparkSession.sparkContext.broadcast(at)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = where.value
        for b in batches:
            key = b.column(0).fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(splits, key, side="right") - 1
            own = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(key), np.int32)), *b.columns], ["bucket", "look", "doc_id", "text"])
            yield own
            for look, rows_of in ((1, np.flatnonzero((splits[bucket] == key) & (bucket > 0))), (2, np.flatnonzero(key == splits[0]))):
                if len(rows_of):
                    some = own.take(pa.array(rows_of))
                    to = bucket[rows_of] - 1 if look == 1 else np.full(len(rows_of), len(splits) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(rows_of), look, np.int32)), *some.columns[2:]], own.schema.names)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, "bucket long, look int, doc_id long, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "look", F.col("doc_id").asc_nulls_last(), "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """The op1 contract: each document's fingerprint, that of its edited text and their likenesses; see registry.py."""
    names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int | None, str]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            pairs = [(i, held[i + 1][3]) for i in range(len(held) - 1) if held[i][1] == 0 and held[i + 1][0] == held[i][0]]
            if pairs:
                prints = fingerprints_of([t[3].encode() for t in held])
                edits = []
                for i, after in pairs:
                    t = held[i][3]
                    q = len(t) // 4
                    edits.append((t[: len(t) - q] + after[:q]).encode())
                changed = fingerprints_of(edits)
                cols = [
                    [held[i][2] for i, _ in pairs], [len(held[i][3]) for i, _ in pairs], [sha(e) for e in edits], [text_of(prints[i]) for i, _ in pairs], [text_of(c) for c in changed],
                    [likeness(prints[i], c) for (i, _), c in zip(pairs, changed, strict=True)], [likeness(prints[i], prints[i + 1]) for i, _ in pairs],
                ]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            held = [] if last else held[-1:]

        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3).to_pylist(), strict=True):
                held.append((*row[:3], row[3] or ""))
                size += len(held[-1][3])
                if size > 4 * CHUNK:
                    yield from flush(False)
                    size = 0
        yield from flush(True)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
