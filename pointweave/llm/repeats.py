"""Windows of symbols that recur across a corpus: the plan shared by substring removal over bytes and over words.

A window is WINDOW consecutive symbols of one document. Of the GRAM-symbol strings in a window, the one with the least hash
is its anchor, so equal windows have equal anchors at equal places, and about one symbol in SPAN / 2 starts an anchor.

1. Documents are put into packs of up to PACK bytes where they are read, and kept as a table bucketed by part (FILE packs in
   one file): texts are never shuffled, and later steps join answers to the table without moving it.
2. Each pack sends its distinct anchors' names (NAME bits beside the shard, as packed differences) to shards by hash; a
   shard answers, one bit a name, which of them other packs have too, and which of them very many packs (HOT) have.
3. Packs send the surroundings of shared anchors, each distinct one once, for its earliest occurrence, to the shard of the
   anchor: no more of them than its own windows take up. Surroundings of hot anchors go window by window, dealt by the window's own hash, so that a passage in a third of all documents stays in no one shard.
   A shard decides for each window whether an equal one comes earlier; how it does so is the operator's own method.
4. Packs apply the answers to all occurrences and return rows per document.

Nothing is sampled or capped: every window has an anchor, and hash collisions only add candidates that step 3 rejects. Pack
size and number of shards follow the bytes of text (counted first); results do not depend on them. The table is dropped
once the result is written to the checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, bytes_of, cut, mix64, shuffle_partitions

PACK, LEAST_PACK, SLICE, HOT, SHARD = 4 << 20, 1 << 20, 1 << 16, 256, 8 << 20
FILE = 2  # bits of the number of packs in a file
BUCKETS = 50_000  # of the table, at most
NAME = 28  # bits of an anchor's name within its shard
START = 32  # bits of a start within a document, whose text is shorter than 2 ** 31
LAST = (1 << 63) - 1  # the place of null ids in the order of documents


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int
    by_start: bool  # whether an earlier start in the same document counts, too

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Pack:
    """Documents end to end: ids (nulls as LAST), bytes and byte offsets."""

    ids: np.ndarray
    null: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def packs(docs: DataFrame, size: int) -> DataFrame:
    """(part, pack, ids, null, sizes, data) rows of about `size` bytes of documents (doc_id, text); a longer text is a pack alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, held_size = TaskContext.get().partitionId() << 33, [], 0
        names = ["part", "pack", "ids", "null", "sizes", "data"]

        def out() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            null, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            cols = [pa.array([n >> FILE], pa.int64()), pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, null, sizes.astype(np.int64))), pa.array([b"".join(h[3] for h in held)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            data, offsets = bytes_of(b.column(1))
            null = np.asarray(b.column(0).is_null()).astype(np.uint8)
            ids = b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            a = 0
            while a < len(ids):
                z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max(1, size - held_size), side="right")) - 1)
                held.append((ids[a:z], null[a:z], np.diff(offsets[a : z + 1]), data[offsets[a] : offsets[z]].tobytes()))
                held_size += len(held[-1][3])
                a = z
                if held_size >= size * 9 // 10 or a < len(ids):
                    yield out()
                    n, held, held_size = n + 1, [], 0
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part long, pack long, ids binary, null binary, sizes binary, data binary")


def _packs_in(b: pa.RecordBatch) -> Iterator[tuple[int, Pack]]:
    for i in range(b.num_rows):
        pack, ids, null, sizes, data = (b.column(j)[i] for j in range(1, 6))
        as_array = lambda x, t: np.frombuffer(x.as_buffer(), t)
        yield pack.as_py(), Pack(as_array(ids, np.int64), as_array(null, np.uint8), as_array(data, np.uint8), np.concatenate([[0], np.cumsum(as_array(sizes, np.int64))]))


def bucketed(df: DataFrame, buckets: int) -> str:
    """Writes df as a managed table bucketed by part, without a shuffle, and returns its name."""
    name = f"packs_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "part").option("compression", "zstd").saveAsTable(name)
    return name


def _slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over every run of w entries."""
    done, out = 1, x
    while done * 2 <= w:
        out = f(out[:-done], out[done:])
        done *= 2
    return f(out[: len(out) - (w - done)], out[w - done :]) if w > done else out


@dataclass
class Anchors:
    """Anchors of a pack in text order: symbol place, hash, windows that have it as theirs (bit a: begins a symbols before it), document."""

    at: np.ndarray
    hash: np.ndarray
    own: np.ndarray
    doc: np.ndarray


def anchors(gram_hashes: Callable[[int, int], np.ndarray], n: int, offsets: np.ndarray, shape: Shape) -> Anchors:
    """gram_hashes(a, z): the hashes of the grams that begin at symbols a..z-1; offsets: of documents, in symbols."""
    window, span = shape.window, shape.span
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, n - window + 1, SLICE):
        z = min(a + SLICE, n - window + 1)  # windows a..z-1
        g = gram_hashes(a, z + span - 1)
        top = np.maximum((g >> U64(32)).astype(np.uint32), np.uint32(1))  # 0 marks windows that would leave their document
        padded = np.zeros(z - a + 2 * (span - 1), np.uint32)
        least = padded[span - 1 : span - 1 + z - a]
        least[:] = _slide(top, span, np.minimum)
        lo, hi = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, z + window, side="left")
        for d in range(max(0, lo), min(len(offsets) - 1, hi)):
            x, y = max(a, int(offsets[d]), int(offsets[d + 1]) - window + 1), min(z, int(offsets[d + 1]))
            if x < y:
                least[x - a : y - a] = 0
        at = np.flatnonzero(_slide(padded, span, np.maximum) == top)
        mine = top[at]
        own = np.zeros(len(at), np.uint32)
        for back in range(span):
            own |= (padded[at + span - 1 - back] == mine).astype(np.uint32) << np.uint32(back)
        found.append((at + a, g[at], own))
    if not found:
        empty = np.zeros(0, np.int64)
        return Anchors(empty, np.zeros(0, U64), np.zeros(0, np.uint32), empty)
    at, h, own = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:  # neighbouring slices share the anchors between them
        order = np.argsort(at, kind="stable")
        at, h, own = at[order], h[order], own[order]
        new = np.append(True, at[1:] != at[:-1])
        own = np.bitwise_or.reduceat(own, np.flatnonzero(new)) if len(at) else own
        at, h = at[new], h[new]
    # least hashes are small ones: mixed again, they spread evenly over the shards
    return Anchors(at, mix64(h), own, np.searchsorted(offsets, at, side="right") - 1)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _runs(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of ascending shard numbers."""
    if not len(shard):
        return
    heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(shard)], strict=True):
        yield int(shard[x]), slice(x, y)


def _names(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash and NAME bits of it, in one number; equal names of different hashes only add candidates."""
    return _shard(h, shards) << NAME | (h & U64((1 << NAME) - 1)).astype(np.int64)


def _packed(names: np.ndarray) -> bytes:
    """Ascending names of one shard, as the byte planes of their differences."""
    step = np.diff(names & ((1 << NAME) - 1), prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(step.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.int64).astype(np.uint32)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


@dataclass
class Spots:
    """What a pack sends: distinct surroundings in shard order, and for every occurrence the one that is its own."""

    hash: np.ndarray  # ascending; deals to shards
    first: np.ndarray  # occurrence that stands for each
    anchor: np.ndarray  # by occurrence: index of the anchor
    own: np.ndarray  # by occurrence: its windows
    left: np.ndarray  # by occurrence: symbols before the anchor, and from it on
    right: np.ndarray
    of: np.ndarray  # by occurrence: index into hash and first


def _log2(x: np.ndarray) -> np.ndarray:
    """The place of the highest bit; x > 0."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64) - 1


def spots(a: Anchors, shared: np.ndarray, hot: np.ndarray, offsets: np.ndarray, span_hash: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray, shape: Shape) -> Spots:
    """shared and hot by anchor; span_hash(x, y): hashes of the symbols x..y-1."""
    i = np.flatnonzero(shared)
    left = np.minimum(a.at[i] - offsets[a.doc[i]], shape.span - 1)
    right = np.minimum(offsets[a.doc[i] + 1] - a.at[i], shape.window)
    # windows that stay in the document begin window - right .. left symbols before the anchor
    fit = (np.left_shift(2, left) - 1) & -np.left_shift(1, np.maximum(shape.window - right, 0))
    own = (a.own[i].astype(np.int64) & fit).astype(np.uint32)
    some = own > 0
    i, own, heat = i[some], own[some], hot[i][some]
    if heat.any():  # one entry a window
        x, y = np.nonzero((own[heat, None] >> np.arange(shape.span, dtype=np.uint32)) & 1)
        i = np.concatenate([i[~heat], i[heat][x]])
        own = np.concatenate([own[~heat], np.uint32(1) << y.astype(np.uint32)])
        heat = np.arange(len(i)) >= (~heat).sum()
    # of its surroundings a place needs its own windows only
    left = _log2(own)
    right = shape.window - _log2(own & (~own + np.uint32(1)))
    at = a.at[i]
    text = mix64(span_hash(at - left, at + right) + (left.astype(U64) << U64(8)) + own.astype(U64) * U64(0x9E3779B97F4A7C15))
    deal = np.where(heat, text, a.hash[i])
    order = np.lexsort((at, ids[a.doc[i]], text, deal))
    key, key2 = deal[order], text[order]
    new = np.append(True, (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])) if len(order) else np.zeros(0, bool)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return Spots(key[new], order[new], i, own, left, right, of)


class Method:
    """What an operator adds: its symbols, what it sends of a place, how a shard decides, and its rows."""

    shape: Shape

    def symbols(self, pack: Pack):  # noqa: ANN201
        """Anything with n, offsets, gram_hashes and span_hash."""
        raise NotImplementedError

    def send(self, s, begin: np.ndarray, end: np.ndarray) -> bytes:  # noqa: ANN001
        """The symbols of many places, in a form that solve() reads."""
        raise NotImplementedError

    def solve(self, blobs: list[bytes], left: np.ndarray, right: np.ndarray, own: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """For each place of a shard the windows that also come earlier, as bits like own.

        rank orders the places: documents by id, and (document << START) + start of the anchor if earlier starts count.
        """
        raise NotImplementedError

    def rows(self, pack: Pack, s, repeated: np.ndarray) -> pa.RecordBatch:  # noqa: ANN001
        """repeated marks the symbols at which a repeated window begins."""
        raise NotImplementedError

    schema: str


def _squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _flags(flags: list[dict] | None, pack: int, uniques: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shared and hot for a pack's distinct anchor names."""
    shared, hot = local.copy(), np.zeros(len(uniques), bool)
    answers = {r["shard"]: r for r in flags or [] if r["pack"] == pack}
    for shard, where in _runs(uniques >> NAME):
        if r := answers.get(shard):
            n = where.stop - where.start
            shared[where] |= np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=n).astype(bool)
            hot[where] |= np.unpackbits(np.frombuffer(r["hot"], np.uint8), count=n).astype(bool)
    return shared, hot


def find(docs: DataFrame, method: Method, pack_size: int | None = None, hot_packs: int = HOT) -> DataFrame:
    """Runs the plan over docs (doc_id, text) and returns method.rows for every document."""
    spark, shape = docs.sparkSession, method.shape
    bytes_in = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), bytes_in // SHARD)
    # a small input is dealt out to all tasks
    pack_size = pack_size or min(PACK, max(LEAST_PACK, bytes_in // (shuffle_partitions(spark) << FILE)))
    name = bucketed(packs(docs, pack_size), min(shuffle_partitions(spark), BUCKETS))
    try:
        return cut(_found(spark.table(name), method, shape, shards, hot_packs))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _found(table: DataFrame, method: Method, shape: Shape, shards: int, hot_packs: int) -> DataFrame:
    def local(a: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names, each anchor's place among them, and which of them repeat within the pack."""
        uniques, of, count = np.unique(_names(a.hash, shards), return_inverse=True, return_counts=True)
        if shape.by_start:
            return uniques, of, count > 1
        low, high = np.full(len(uniques), LAST), np.full(len(uniques), -1)
        np.minimum.at(low, of, a.doc)
        np.maximum.at(high, of, a.doc)
        return uniques, of, low < high

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, p in _packs_in(b):
                s = method.symbols(p)
                names = np.sort(_names(anchors(s.gram_hashes, s.n, s.offsets, shape).hash, shards))
                uniques = names[np.append(True, names[1:] != names[:-1])] if len(names) else names
                rows = [(shard, pack, _packed(uniques[where])) for shard, where in _runs(uniques >> NAME)]
                yield _batch(rows, ["shard", "pack", "names"], [pa.int64(), pa.int64(), pa.binary()])

    def answer(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        parts = [_unpacked(x) for x in t.column("names").to_pylist()]
        every = np.concatenate(parts)
        every.sort()
        heads = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        count = np.diff(heads, append=len(every))
        many, very = every[heads[count > 1]], every[heads[count >= hot_packs]]
        rows = []
        for shard, pack, h in zip(t.column("shard").to_pylist(), t.column("pack").to_pylist(), parts, strict=True):
            at = np.searchsorted(many, h)
            shared = many[np.minimum(at, len(many) - 1)] == h if len(many) else np.zeros(len(h), bool)
            if shared.any():
                at = np.searchsorted(very, h)
                hot = very[np.minimum(at, len(very) - 1)] == h if len(very) else np.zeros(len(h), bool)
                rows.append((pack >> FILE, pack, shard, np.packbits(shared).tobytes(), np.packbits(hot).tobytes()))
        return pa.Table.from_batches([_batch(rows, ["part", "pack", "shard", "shared", "hot"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])])

    asked = table.mapInArrow(ask, "shard long, pack long, names binary")
    answered = cut(asked.groupBy("shard").applyInArrow(answer, "part long, pack long, shard long, shared binary, hot binary"))
    flags = answered.groupBy("part").agg(F.collect_list(F.struct("pack", "shard", "shared", "hot")).alias("flags"))
    flagged = table.join(flags, "part", "left")

    def places(b: pa.RecordBatch) -> Iterator[tuple]:
        for i, (pack, p) in enumerate(_packs_in(b)):
            s = method.symbols(p)
            a = anchors(s.gram_hashes, s.n, s.offsets, shape)
            uniques, of, own = local(a)
            shared, hot = _flags(b.column(6)[i].as_py(), pack, uniques, own)
            yield i, pack, p, s, a, spots(a, shared[of], hot[of], s.offsets, s.span_hash, p.ids, shape)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, pack, p, s, a, t in places(b):
                rows = []
                for shard, where in _runs(_shard(t.hash, shards)):
                    k = t.first[where]
                    at = a.at[t.anchor[k]]
                    doc = a.doc[t.anchor[k]]
                    begin = at - s.offsets[doc]
                    blob = method.send(s, at - t.left[k], at + t.right[k])
                    meta = np.concatenate([p.ids[doc].view(np.uint8), begin.view(np.uint8), t.left[k].astype(np.uint8), t.right[k].astype(np.uint8), t.own[k].view(np.uint8)])
                    rows.append((shard, pack, len(k), _squeezed(meta.tobytes()), _squeezed(blob)))
                yield _batch(rows, ["shard", "pack", "n", "meta", "blob"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def decide(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        unpack, n = zstandard.ZstdDecompressor(), t.column("n").to_pylist()
        ids, begin, left, right, own = ([] for _ in range(5))
        for k, x in zip(n, t.column("meta").to_pylist(), strict=True):
            m = np.frombuffer(unpack.decompress(x), np.uint8)
            for col, (lo, hi, kind) in zip((ids, begin, left, right, own), ((0, 8, np.int64), (8, 16, np.int64), (16, 17, np.uint8), (17, 18, np.uint8), (18, 22, np.uint32)), strict=True):
                col.append(m[lo * k : hi * k].view(kind))
        ids, begin, left, right, own = (np.concatenate(x) for x in (ids, begin, left, right, own))
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        if shape.by_start:
            rank = (rank << START) + begin
        blobs = [unpack.decompress(x) for x in t.column("blob").to_pylist()]
        got = method.solve(blobs, left.astype(np.int64), right.astype(np.int64), own, rank).astype(np.uint32)
        cuts = np.cumsum([0, *n])
        rows = [(pack >> FILE, pack, shard, _squeezed(got[x:y].tobytes())) for pack, shard, x, y in zip(t.column("pack").to_pylist(), t.column("shard").to_pylist(), cuts[:-1], cuts[1:], strict=True) if got[x:y].any()]
        return pa.Table.from_batches([_batch(rows, ["part", "pack", "shard", "bits"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])])

    told = flagged.mapInArrow(tell, "shard long, pack long, n long, meta binary, blob binary")
    decided = cut(told.groupBy("shard").applyInArrow(decide, "part long, pack long, shard long, bits binary"))
    decisions = decided.groupBy("part").agg(F.collect_list(F.struct("pack", "shard", "bits")).alias("bits"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i, pack, p, s, a, t in places(b):
                bits = np.zeros(len(t.hash), np.uint32)
                answers = {r["shard"]: r["bits"] for r in b.column(7)[i].as_py() or [] if r["pack"] == pack}
                for shard, where in _runs(_shard(t.hash, shards)):
                    if shard in answers:
                        bits[where] = np.frombuffer(unpack.decompress(answers[shard]), np.uint32)
                repeated = np.zeros(s.n, bool)
                if len(t.of):
                    # an occurrence after the one that was sent repeats all its windows
                    doc, stood = a.doc[t.anchor], t.anchor[t.first[t.of]]
                    later = p.ids[doc] > p.ids[a.doc[stood]]
                    if shape.by_start:
                        start, base = a.at[t.anchor] - s.offsets[doc], a.at[stood] - s.offsets[a.doc[stood]]
                        later |= (p.ids[doc] == p.ids[a.doc[stood]]) & (start > base)
                    mine = np.where(later, t.own, bits[t.of] & t.own)
                    at = a.at[t.anchor]
                    at, mine = at[mine > 0], mine[mine > 0]
                    for back in range(shape.span):
                        repeated[at[(mine >> np.uint32(back)) & 1 == 1] - back] = True
                yield method.rows(p, s, repeated)

    return flagged.join(decisions, "part", "left").mapInArrow(apply, method.schema)


def covered(repeated: np.ndarray, window: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols inside a window that begins at a marked one: a mask of all others, and by document the count and the runs."""
    at = np.flatnonzero(repeated)
    doc = np.searchsorted(offsets, at, side="right") - 1
    head = np.append(True, (np.diff(at) > window) | (np.diff(doc) > 0))[: len(at)]
    begin, end = at[head], at[np.append(head[1:], True)[: len(at)]] + window
    bounds = np.stack([begin, end], axis=1).reshape(-1)
    kept = np.repeat(np.arange(len(bounds) + 1) % 2 == 0, np.diff(bounds, prepend=0, append=len(repeated)))
    n = len(offsets) - 1
    return kept, np.bincount(doc[head], weights=end - begin, minlength=n).astype(np.int64), np.bincount(doc[head], minlength=n)
