"""Mixing sources to target weights by a low-discrepancy schedule.

targets() shares the corpus among the sources by weight, none above REPEATS times its size. The schedule has a slot for each
word of the corpus; slot i stands at the golden-ratio point frac((i + 1/2) * 0.618...), which cumulative target shares map
to a source. That says how many words each source gives, exactly and at any size, within a few words of the targets. A source's
documents, shuffled by a salted hash, lie end to end on a tape that begins again after its last word, and what the source gives
of it is cut into blocks of BLOCK words (the last may be shorter). The blocks of all sources are dealt to as many slots of a
schedule: slot i stands at a golden-ratio point again, cumulative block counts map it to a source, and its rank among its source's
slots names the block. Where a source has a few more slots than blocks, those that are left over go, in order, to the blocks of
sources that have fewer, so that each block has one slot. Documents meet their blocks in a join; what a document gives is the sum
over its pieces there, and its places are the slots in which it begins.

Defined cases: null text has size 0; a null source is a source of its own, after all others; documents of size 0 are kept
with taken 0; repeated rows are separate documents, in an order fixed by doc_id and text hash; an empty table gives no rows.
The sources (not the documents) are collected: more than MAX_SOURCES of them raise ValueError. A source's running sums go
through CHUNKS hash ranges, so that no task holds a whole source; slots are ranked by ranges.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import ranked
from ._common import BLANKS, U64, WORD, bytes_of, cut, lean

REPEATS, MAX_SOURCES, CHUNKS = 3, 100_000, 1 << 14
#: A block has 2 ** BLOCK_BITS words.
BLOCK_BITS = 11
BLOCK = 1 << BLOCK_BITS
#: The schedule's points are whole numbers below CIRCLE; GOLDEN is half a step of (sqrt(5) - 1) / 2 of it.
CIRCLE = 1 << 128
GOLDEN = (math.isqrt(5 << 254) - (1 << 127)) >> 1
WEIGHTS = (1, 2, 3)
_WORD = re.compile(WORD)


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each document of data; words are runs of bytes other than the six ASCII blanks."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): key is a salted hash that shuffles the documents of a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(word_counts(*bytes_of(b.column(0))), pa.int64())], [*b.schema.names[1:], "size"])

    source = docs.select("text", "doc_id", "source", F.xxhash64(F.lit("mix"), "doc_id", "text").alias("key"))
    schema = source.drop("text").schema.add("size", "long")
    return source.mapInArrow(lean(run), schema)


def targets(source_sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the whole by weight; a source stops at repeats times its size, and the excess goes to the others."""
    out = [0.0] * len(source_sizes)
    open_ = sorted((i for i, s in enumerate(source_sizes) if s > 0), key=lambda i: source_sizes[i] / weights[i])
    left, units = float(sum(source_sizes)), math.fsum(weights[i] for i in open_)
    # the share of a unit of weight only grows as sources stop, so they stop in the order of size by weight
    for k, i in enumerate(open_):
        if left / units * weights[i] <= repeats * source_sizes[i]:
            rest = open_[k:]
            unit = left / math.fsum(weights[j] for j in rest)
            for j in rest:
                out[j] = unit * weights[j]
            break
        out[i] = float(repeats * source_sizes[i])
        left, units = left - out[i], units - weights[i]
    return out


@dataclass(frozen=True)
class Mix:
    source: str | None
    size: int
    target: float
    words: int  # what the schedule takes from the source's tape


def _floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of floor((a i + b) / m) over i < n, by Euclid's steps."""
    out = 0
    while True:
        out += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        n, b = divmod(a * n + b, m)
        if not n:
            return out
        m, a = a, m


def schedule(target: list[float], total: int) -> list[int]:
    """How many of the slots, a slot a word, go to each source.

    Points and shares are whole multiples of 1 / CIRCLE, and the points below a share are counted without going through them.
    """
    whole = math.fsum(target)
    ends, at = [], 0
    for t in target:
        at += int(t / whole * CIRCLE) if whole else 0
        ends.append(min(at, CIRCLE))
    ends[-1:] = [CIRCLE] * bool(ends)
    every = _floor_sum(total, CIRCLE, 2 * GOLDEN, GOLDEN)
    below = [total + every - _floor_sum(total, CIRCLE, 2 * GOLDEN, GOLDEN + CIRCLE - e) for e in ends]
    return [y - x for x, y in zip([0, *below], below, strict=False)]


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> list[Mix]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # UTF-8 bytes sort as code points
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    size = [int(r["size"] or 0) for r in rows]
    goal = targets(size, [weights[i % len(weights)] for i in range(len(rows))])
    total = sum(size)
    if not total:
        return [Mix(r["source"], 0, 0.0, 0) for r in rows]
    return [Mix(r["source"], s, g, min(n, REPEATS * s)) for r, s, g, n in zip(rows, size, goal, schedule(goal, total), strict=True)]


def tape(sized: DataFrame) -> DataFrame:
    """sized and the words before each document on its source's tape (begin)."""
    chunk = sized.withColumn("chunk", F.shiftrightunsigned("key", 64 - int(math.log2(CHUNKS))).cast("int"))
    per = chunk.groupBy("source", "chunk").agg(F.sum("size").alias("s"))
    before = per.withColumn("s", F.sum("s").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("_source"), F.col("chunk").alias("_chunk"), F.coalesce("s", F.lit(0)).alias("_before"))
    own = Window.partitionBy("source", "chunk").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = chunk.withColumn("begin", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = inside.join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")))
    return joined.withColumn("begin", F.col("begin") + F.col("_before")).drop("_source", "_chunk", "_before", "chunk")


def slots(spark: SparkSession, mixes: list[Mix]) -> DataFrame:
    """(idx, block, slot): the slot of every block that source idx gives; slots count from 0 without a gap."""
    blocks = [-(-m.words // BLOCK) for m in mixes]
    n = sum(blocks)
    ends = np.array([min((e << 64) // max(n, 1), (1 << 64) - 1) for e in itertools.accumulate(blocks)], U64)
    step = U64(GOLDEN >> 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                point = (b.column(0).to_numpy().astype(U64) * U64(2) + U64(1)) * step
            to = np.minimum(np.searchsorted(ends, point, side="right"), len(ends) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to, pa.int32())], ["slot", "idx"])

    known = spark.createDataFrame(list(enumerate(blocks)), "idx int, blocks long")
    ranks = ranked(spark.range(n).mapInArrow(lean(run), "slot long, idx int"), ["idx"], ["slot"], cut, "block")
    held = ranks.join(F.broadcast(known), "idx")
    had = ranks.groupBy("idx").agg(F.count("*").alias("n"))
    short = known.join(had, "idx", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks")
    short = short.select("idx", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("block"))
    over = ranked(held.where("block >= blocks").select("slot"), [], ["slot"], cut, "k")
    dealt = over.join(ranked(short, [], ["idx", "block"], cut, "k"), "k")
    return held.where("block < blocks").select("idx", "block", "slot").unionByName(dealt.select("idx", "block", "slot"))


def _known(spark: SparkSession, mixes: list[Mix]) -> DataFrame:
    rows = [(m.source, i, m.size, m.target, m.words) for i, m in enumerate(mixes)]
    return spark.createDataFrame(rows, "_source string, idx int, source_size long, target double, words long")


def _sized(docs: DataFrame) -> DataFrame:
    return cut(sizes(docs).withColumn("row", F.monotonically_increasing_id()))


def _scheduled(sized: DataFrame, mixes: list[Mix]) -> DataFrame:
    spark = sized.sparkSession
    at = tape(sized).join(F.broadcast(_known(spark, mixes)), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    turned = at.withColumn("turn", F.explode(F.array(*map(F.lit, range(REPEATS))))).withColumn("lo", F.col("begin") + F.col("turn") * F.col("source_size"))
    turned = turned.withColumn("hi", F.least(F.col("lo") + F.col("size"), "words")).where("lo < hi")
    pieces = turned.withColumn("block", F.explode(F.sequence(F.shiftright("lo", BLOCK_BITS), F.shiftright(F.col("hi") - 1, BLOCK_BITS))))
    left = F.col("block") * BLOCK
    begin = F.greatest("lo", left)
    pieces = pieces.select("row", "doc_id", "source", "key", "turn", "idx", "block", (begin - left).alias("at"), (begin - F.col("lo")).alias("first"), (F.least("hi", left + BLOCK) - begin).alias("words"))
    return pieces.join(slots(spark, mixes), ["idx", "block"])


def scheduled(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The schedule of docs (doc_id, text, source): (slot, at, doc_id, source, key, turn, first, words), a row a piece.

    `words` words of the document, from its word `first` on, stand in the slot's block from word `at` on; it is taken for the
    turn-th time, from 0. Ordered by slot and at, the pieces are the mix.
    """
    sized = _sized(docs)
    return _scheduled(sized, plan(sized, weights)).select("slot", "at", "doc_id", "source", "key", "turn", "first", "words")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, taken, places) for every row of docs (doc_id, text, source).

    places: the slot in which the document begins, for each time it is taken; null if it is not.
    """
    sized = _sized(docs)
    mixes = plan(sized, weights)
    begins = F.collect_list(F.when(F.col("first") == 0, F.struct("turn", "slot")))  # REPEATS at most
    given = _scheduled(sized, mixes).groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(begins)["slot"].alias("places"))
    known = F.broadcast(_known(docs.sparkSession, mixes).drop("words"))
    out = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).join(given, "row", "left")
    return out.select("doc_id", "source", "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "places")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, in_order: bool = False) -> DataFrame:
    """The mix itself: docs' columns, a row for each time a document is taken; one that is cut gives its first words.

    in_order sorts the rows by the slots in which they begin (documents stay whole, also where a block ends in them). Rows that
    agree in doc_id, text and source share what they take evenly, to a word. _key, _source, _size, _taken, _places and _slot are
    names of the operator's own: docs' columns of those names are dropped.
    """
    docs = docs.drop("_key", "_source", "_size", "_taken", "_places", "_slot")
    each = mix(docs, weights).groupBy(F.col("key").alias("_key"), F.col("source").alias("_source"))
    each = each.agg(F.first("size").alias("_size"), F.floor(F.sum("taken") / F.count("*")).alias("_taken"), F.min("places").alias("_places"))
    key = F.xxhash64(F.lit("mix"), "doc_id", "text")
    rows = docs.join(each, (key == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source"))).where("_taken > 0").drop("_key", "_source")
    names = docs.columns
    text_at, n = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, taken = b.column(n).to_numpy(), b.column(n + 1).to_numpy()
            whole, part = taken // size, taken % size
            places = b.column(n + 2).to_pylist()
            # rows alike share, so one may be taken once more than it has places
            slot = lambda i, turn: places[i][min(turn, len(places[i]) - 1)]  # noqa: E731, B023
            if whole.any():
                full = np.repeat(np.arange(len(whole)), whole)
                at = pa.array([slot(i, k) for i, m in enumerate(whole.tolist()) for k in range(m)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(full)) for c in b.columns[:n]), at], [*names, "_slot"])
            some = np.flatnonzero(part)
            if len(some):
                cols = [c.take(pa.array(some)) for c in b.columns[:n]]
                texts = []
                for t, k in zip(cols[text_at].to_pylist(), part[some].tolist(), strict=True):
                    texts.append(t[: next(itertools.islice(_WORD.finditer(t), k - 1, None)).end()])
                cols[text_at] = pa.array(texts, cols[text_at].type)
                at = pa.array([slot(i, int(whole[i])) for i in some.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*cols, at], [*names, "_slot"])

    out = rows.select(*names, "_size", "_taken", "_places").mapInArrow(lean(run), docs.schema.add("_slot", "long"))
    return (out.orderBy("_slot") if in_order else out).drop("_slot")
