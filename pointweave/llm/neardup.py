"""Near-duplicate classes: BagMinHash signatures of word-shingle multisets, banded, then verified exactly.

A text is the multiset of its SHINGLE-word shingles (of all its words, if it has fewer). BagMinHash: every shingle owns one
Poisson process of points (time, component, weight level), split into dyadic weight intervals; a bag takes the points below
its weight, and a component's signature is its first point. Two bags share a component's first point with probability equal
to their weighted Jaccard similarity. A point later than the worst component cannot matter, which ends the work early.

Texts with the same words are one node. Nodes meet in buckets (band number, ROWS components of the signature). First every
node is compared with the least key of each of its buckets; a comparison is exact, on the whole multisets. Members of one
class need no comparison, so buckets of copies are done then. In the buckets that are left all pairs of different classes are looked at, block by block: pairs whose signatures
agree in less than a share of NEAR cannot reach the threshold and go; the others are compared exactly where they meet, and
only links that join two classes come out. Nothing is capped.
Links are joined into classes by label passing with pointer jumping; a class is named by its least doc_id.

Chance: a pair at similarity THRESHOLD misses every bucket with probability (1 - 0.8 ** ROWS) ** BANDS < 6e-6, and agrees in
less than NEAR of its components, which lies five standard deviations lower, with probability < 1e-6.
Defined cases: texts without a word form one class; null counts as empty; null ids are allowed (a class of null ids has a
null class_id); repeated rows share a class; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, chunks_of, cut, lean, mix64, seeded, words_of

SHINGLE, THRESHOLD, BANDS, ROWS, NEAR, BLOCK = 5, 0.8, 40, 6, 0.67, 1000
_MIX = seeded(SHINGLE, 501) | U64(1)
_STEP = U64(0xD1342543DE82EF95)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit shingle hash) of every shingle, in text order."""
    count = np.diff(offsets)
    with np.errstate(over="ignore"):
        if len(hashes) >= width:
            full = sum((hashes[i : len(hashes) - width + 1 + i] * _MIX[i] for i in range(width)), np.zeros(len(hashes) - width + 1, U64))
        else:
            full = np.zeros(0, U64)
        doc = np.repeat(np.arange(len(count)), count)
        inside = doc[: len(full)] == doc[width - 1 :] if len(full) else np.zeros(0, bool)
        docs, out = [doc[: len(full)][inside]], [mix64(full[inside])]
        for d in np.flatnonzero((count > 0) & (count < width)):
            h = hashes[offsets[d] : offsets[d + 1]]
            docs.append(np.array([d]))
            out.append(mix64(np.array([(h * _MIX[: len(h)]).sum(dtype=U64) + U64(len(h))], U64)))
    doc, value = np.concatenate(docs), np.concatenate(out)
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return doc, value


def weighted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their counts."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(at, append=len(doc))


def bag_min_hash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n by m signatures (times of first points); rows of documents without elements stay infinite."""
    total = np.bincount(doc, weights=weight, minlength=n)
    signature = np.full((n, m), np.inf)
    # dyadic weight intervals [0, 1), [1, 2), [2, 4), ... that begin below the weight
    parts = [(doc, value, weight, np.zeros(len(doc)), np.ones(len(doc)), np.zeros(len(doc), np.int64))]
    j, low = 1, 1
    while len(heavy := np.flatnonzero(weight > low)):
        parts.append((doc[heavy], value[heavy], weight[heavy], np.full(len(heavy), float(low)), np.full(len(heavy), float(low)), np.full(len(heavy), j)))
        j, low = j + 1, low * 2
    d0, v0, w0, low0, length0, level0 = (np.concatenate(x) for x in zip(*parts, strict=True))
    with np.errstate(over="ignore", divide="ignore"):
        seed0 = mix64(v0 + level0.astype(U64) * U64(0x9E3779B97F4A7C15))
        bound = np.where(total > 0, (np.log(m) + 6) / np.maximum(total, 1), 0.0)  # later points rarely matter
        todo = total > 0
        while todo.any():
            pick = todo[d0]
            d, seed, w, low, length = d0[pick], seed0[pick], w0[pick], low0[pick], length0[pick]
            t, k = np.zeros(len(d)), U64(0)
            worst = bound.copy()
            while len(d):
                k += U64(1)
                a = mix64(seed + k * _STEP)
                t = t - np.log(((a >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * length)
                on = t <= worst[d]
                if not on.all():
                    d, seed, w, low, length, t, a = (x[on] for x in (d, seed, w, low, length, t, a))
                b = mix64(a)
                at = d * m + ((b >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
                live = low + length * ((b & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < w
                np.minimum.at(signature.reshape(-1), at[live], t[live])
                if len(d):
                    busy = d[np.append(True, d[1:] != d[:-1])] if k < 3 else np.unique(d)
                    worst[busy] = np.minimum(bound[busy], signature[busy].max(axis=1))
            todo &= np.isinf(signature).any(axis=1)
            bound[todo] *= 4
    return signature


def bands_of(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n by bands: the 64-bit bucket names."""
    x = mix64(np.ascontiguousarray(signature).view(U64)).reshape(len(signature), bands, -1)
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(1, bands + 1, dtype=U64) * _STEP, (len(signature), 1))
        for i in range(x.shape[2]):
            out = mix64(out * U64(3) + x[:, :, i])
    return out.view(np.int64)


def key_of(raw: bytes) -> bytes:
    """Names a word sequence."""
    return hashlib.sha256(b" ".join(raw.split())).digest()[:16]


def prints(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(doc_id, key, n, bands, sketch) and the kept columns: n counts shingles; bands is empty for a text without words; sketch has a byte a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in chunks_of(b.column(1)):
                raw, n = data.tobytes(), end - first
                hashes, _, _, at = words_of(data, offsets)
                doc, value = shingles(hashes, at)
                signature = bag_min_hash(*weighted(doc, value), n)
                bands = bands_of(signature)
                sketch = (mix64(signature.view(U64)) & U64(255)).astype(np.uint8)
                count = np.bincount(doc, minlength=n)
                lists = [bands[i] if count[i] else [] for i in range(n)]
                keys = [key_of(raw[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(keys, pa.binary()), pa.array(count, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary()), *(c.slice(first, n) for c in b.columns[2:])], ["doc_id", "key", "n", "bands", "sketch", *keep])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    schema = T.StructType.fromDDL("doc_id long, key binary, n long, bands array<long>, sketch binary")
    for f in source.schema.fields[2:]:
        schema = schema.add(f)
    return source.mapInArrow(lean(run), schema)


def bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, bag) of the wanted keys: the multiset as ascending 64-bit names of (shingle, occurrence)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [key_of(t or b"") for t in b.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0)], ["key", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in chunks_of(b.column(1)):
                hashes, _, _, at = words_of(data, offsets)
                doc, value, weight = weighted(*shingles(hashes, at))
                each = np.repeat(np.arange(len(doc)), weight)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
                with np.errstate(over="ignore"):
                    name = np.where(nth > 0, mix64(value[each] + nth.astype(U64) * _STEP), value[each])
                owner = doc[each]
                order = np.lexsort((name, owner))
                name, cuts = name[order], np.searchsorted(owner, np.arange(end - first + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array([name[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["key", "bag"])

    # one text a key: copies are dropped where they are read, then where they meet
    found = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(lean(keyed), "key binary, text string")
    return found.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("key", "text").mapInArrow(lean(run), "key binary, bag binary")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two bags (ascending, without repeats) reach the threshold."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= THRESHOLD * (len(both) - common) - 1e-9


def verified(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough: 9 * common >= 4 * (both sizes) at 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                on.append(alike(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(on, pa.bool_()))

    left = pairs.join(bag.select(F.col("key").alias("a"), F.col("bag").alias("x")), "a")
    return left.join(bag.select(F.col("key").alias("b"), F.col("bag").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a binary, b binary")


def components(links: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(key, label) of every linked key: label is the least key of its component."""
    a, b = names
    edges = cut(links.select(F.col(a).alias("s"), F.col(b).alias("t")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = cut(edges.groupBy(F.col("s").alias("key")).agg(F.least(F.min("t"), F.first("s")).alias("label")))
    while True:
        near = edges.join(labels, edges.t == labels.key).groupBy(F.col("s").alias("key")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        new = cut(hooked.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("key", "label")
        labels = new.select("key", "label")


def close(state: DataFrame) -> DataFrame:
    """Links (a, b) that join the labels of a bucket; state: bucket, key, n, label, bands, sketch, bag.

    All pairs of different labels are looked at, in the first bucket that both are in: where sketches agree in a share of
    NEAR, the multisets are compared. Members that links of this bucket have joined need no further comparison, so a group
    gives fewer links than it has members. A bucket of over BLOCK members is dealt into blocks, a group for each two blocks.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("key").combine_chunks()
        key, n, label, block = (t.column(c).to_pylist() for c in ("key", "n", "label", "block"))
        sketch = np.stack([np.frombuffer(x, np.uint8) for x in t.column("sketch").to_pylist()])
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        bag = [np.frombuffer(x.as_buffer(), U64) for x in t.column("bag")]
        n, block = np.array(n), np.array(block)
        label = np.unique(np.array([x.hex() for x in label]), return_inverse=True)[1]
        band = int(np.flatnonzero(bands[0] == t.column("bucket")[0].as_py())[0])
        across, a, b = block.min() != block.max(), [], []
        for i in range(len(key)):
            j = np.flatnonzero((label[i + 1 :] != label[i]) & ((block[i + 1 :] != block[i]) if across else True)) + i + 1
            j = j[np.minimum(n[j], n[i]) >= THRESHOLD * np.maximum(n[j], n[i]) - 1e-9]
            if len(j) and band:
                j = j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]
            if not len(j):
                continue
            agree = (sketch[j] == sketch[i]).mean(axis=1)
            order = np.argsort(-agree, kind="stable")
            for k in j[order[agree[order] >= NEAR]].tolist():
                if label[k] != label[i] and alike(bag[i], bag[k]):
                    a.append(key[i])
                    b.append(key[k])
                    label[label == label[k]] = label[i]
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    size = state.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = state.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return groups.groupBy("bucket", "low", "high").applyInArrow(run, "a binary, b binary").distinct()


def classes(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(doc_id, class_id, key, n) and the kept columns for every row of docs (doc_id, text); key names the class.

    Kept columns that have one of these names, or that of the text or a signature, are left out.
    """
    keep = [c for c in keep if c not in ("doc_id", "text", "class_id", "key", "n", "bands", "sketch", "label")]
    printed = cut(prints(docs, keep))
    nodes = printed.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = nodes.select("key", "n", F.explode("bands").alias("bucket"))
    # members are counted first, so that lone ones do not move on
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    state = cut(rows.join(shared, "bucket").select("bucket", "key", "n"))
    bag = cut(bags(docs, state.select("key").distinct()))
    lead = F.min(F.struct("key", "n")).alias("lead")
    fits = F.least("n", F.col("lead.n")) >= THRESHOLD * F.greatest("n", F.col("lead.n")) - 1e-9
    led = state.join(state.groupBy("bucket").agg(lead), "bucket").where((F.col("key") != F.col("lead.key")) & fits)
    links = cut(verified(led.select(F.col("lead.key").alias("a"), F.col("key").alias("b")).distinct(), bag))
    labels = components(links)
    state = state.join(labels, "key", "left").select("bucket", "key", "n", F.coalesce("label", "key").alias("label"))
    mixed = state.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    state = cut(state.join(mixed, "bucket"))  # buckets of one label are done
    # what a member has to show is joined to the few that are left, once for each bucket
    shows = printed.join(state.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).join(bag, "key")
    found = cut(close(state.join(shows, "key")))
    if not found.isEmpty():
        labels = components(links.union(found))
    named = printed.select("doc_id", "key", "n", *keep)
    named = named.join(labels, "key", "left").select("doc_id", F.coalesce("label", "key").alias("key"), "n", *keep)
    least = named.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "key").select("doc_id", "class_id", "key", "n", *keep)
