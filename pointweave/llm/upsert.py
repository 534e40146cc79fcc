"""Copy-on-write keyed upsert into a folder of sorted Parquet files.

The starting files hold a table sorted by key, `per_file` rows each. A key's home is the last of them that begins at or below it,
else the first. An upsert replays the homes that some change may touch: their rows meet the changes in a shuffled hash join. Before
and after, rows are tagged column by column (null apart from every value) and hashed; the ordered hashes give a SHA-256 for each
slice of a home, and a home whose digests agree is left alone. The others are written again, cut by the ranks of their rows,
and their starting files deleted then. Layout: <folder>/start/__file=<n>/ and <folder>/rewritten/__out=<n>/, one file each.

What the driver and broadcasts hold is one row a starting file. There are at most `files` of these however large the table is, since
per_file is more than a `files`-th of its rows. A home's rows are ranked over ranges and digested in slices of about SLICE rows
(copies of a row are counted first), so only the writer of a file sees all of its rows, one after the other.

Defined cases: rows and changes with a null key are dropped; copies of a key are all changed, in whichever file they lie, and stand in
the order of their rows' hashes; of changes that agree in all that ranks them the one with the greatest values wins; without starting
files there is no home, so nothing is inserted. Names of columns do not matter, apart from __file, __out and __i.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import ranked
from ._common import cut, lean
from .merkle import tagged

#: Starting files, at most; rows in a slice of a home, about.
FILES, SLICE = 700, 4096


def per_file(rows: int, files: int = FILES) -> int:
    return 1 + rows // files


def start(rows: DataFrame, key: str, size: int, folder: str) -> None:
    """Writes the starting files: rows sorted by key, size to a file, the last one the rest."""
    rows = rows.where(F.col(key).isNotNull())
    numbered = ranked(rows, [], [key], cut, "__i").withColumn("__file", F.floor(F.col("__i") / F.lit(float(size))).cast("int")).drop("__i")
    numbered.repartition("__file").sortWithinPartitions("__file", key).write.partitionBy("__file").parquet(f"{folder}/start")


@dataclass(frozen=True)
class Starts:
    """First and last keys of the starting files, by their numbers 0, 1, .."""

    first: list[int]
    last: list[int]

    def home(self, key: Column) -> Column:
        """The number of key's home, by binary search."""
        first = F.lit(self.first)
        steps = F.lit([1 << i for i in reversed(range(len(self.first).bit_length()))])
        there = lambda at, by: (at + by < len(self.first)) & (first[at + by] <= key)
        return F.greatest(F.aggregate(steps, F.lit(-1), lambda at, by: F.when(there(at, by), at + by).otherwise(at)), F.lit(0))

    def first_of(self, home: Column) -> Column:
        return F.lit(self.first)[home]

    def with_copies(self, homes: set[int]) -> list[int]:
        """homes and the files before them that end with the key they begin with."""
        out = set()
        for n in homes:
            out.add(n)
            while n and self.last[n - 1] == self.first[n]:
                n -= 1
                out.add(n)
        return sorted(out)


def _start_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/start")


def starts(spark: SparkSession, folder: str, key: str) -> Starts:
    rows = _start_files(spark, folder).groupBy("__file").agg(F.min(key).alias("a"), F.max(key).alias("z")).orderBy("__file").collect()
    return Starts([r["a"] for r in rows], [r["z"] for r in rows])


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, c): each key's change that is greatest in order, as a struct."""
    rest = [c for c in changes.columns if c not in (key, *order)]
    return changes.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(F.struct(*order, *rest)).alias("__c"))


def _row(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(tagged(v) for v in values)), 256)


def _replayed(files: DataFrame, acting: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """Rows of files before and after the changes in acting (key, __home, __c, __delete): __file, b and a (the rows' columns, null if absent)."""
    columns = [c for c in files.columns if c != "__file"]
    old = files.select(F.col(key).alias("__key"), "__file", F.struct(*columns).alias("b"))
    both = old.hint("shuffle_hash").join(acting.withColumnRenamed(key, "__key"), "__key", "full_outer")
    hit = F.col("__c").isNotNull()
    value = {c: F.when(hit, F.col(f"__c.{c}")).otherwise(F.col(f"b.{c}")) if c in sets else F.col(f"b.{c}") for c in columns} | {key: F.col("__key")}
    after = F.struct(*(value[c].alias(c) for c in columns))
    gone = F.coalesce(F.col("__delete"), F.lit(False))
    return both.select(F.coalesce("__file", "__home").alias("__file"), "b", F.when(~gone, after).alias("a"))


def _compared(replayed: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """(__file, rows, differs): the rows a file has afterwards, and whether its rows are others than before."""
    one = lambda side: F.struct(F.col(f"{side}.{key}").alias("k"), _row([F.col(f"{side}.{c}") for c in columns]).alias("h"), F.lit(int(side == "b")).alias("nb"), F.lit(int(side == "a")).alias("na"))
    sides = F.filter(F.array(F.when(F.col("b").isNotNull(), one("b")), F.when(F.col("a").isNotNull(), one("a"))), lambda x: x.isNotNull())
    each = replayed.select("__file", F.explode(sides).alias("r")).groupBy("__file", "r.k", "r.h").agg(F.sum("r.nb").alias("nb"), F.sum("r.na").alias("na"))
    slices = max(1, -(-size // SLICE))
    listed = lambda n: F.sha2(F.concat_ws(",", F.transform(F.filter(F.sort_array(F.collect_list(F.struct("k", "h", n))), lambda x: x[n] > 0), lambda x: F.concat_ws(":", x["h"], x[n].cast("string")))), 256)
    digests = each.groupBy("__file", F.pmod(F.xxhash64("h"), F.lit(slices)).alias("slice")).agg(listed("nb").alias("before"), listed("na").alias("after"), F.sum("na").alias("rows"))
    return digests.groupBy("__file").agg(F.sum("rows").alias("rows"), F.max(F.col("before") != F.col("after")).alias("differs"))


def plan(found: dict[int, tuple[int, bool]], starting: int, size: int) -> list[tuple[int, int, int, int, int]]:
    """(file, first output, larger, rows of a larger one, of the others) for each file to rewrite; found: file -> (rows afterwards, differs).

    A file is cut into the fewest outputs of at most size rows, as even as can be, the larger first. Then each output joins the one
    before it, as grown, if no kept file stands between and both fit into size. Two outputs of one file never do.
    """
    out, left, steps = -1, None, []
    for n in range(starting):
        rows, differs = found.get(n, (0, False))
        if not differs:
            left = None
            continue
        if not rows:
            continue
        k = -(-rows // size)
        small, larger = divmod(rows, k)
        head, tail = small + (larger > 0), small + (larger == k)
        join = left is not None and left + head <= size
        steps.append((n, out if join else out + 1, larger, small + 1, small))
        out += k - join
        left = left + head if join and k == 1 else tail
    return steps


def upsert(spark: SparkSession, folder: str, key: str, size: int, changes: DataFrame, sets: list[str], decide: Callable[[Column], tuple[Column, Column]]) -> list[int]:
    """Applies changes (key, __c: a struct) to the starting files and returns the numbers of those rewritten.

    decide gives, from the first key of a change's home, whether it acts and whether it deletes; otherwise it sets the columns of
    `sets`, and inserts an absent key.
    """
    if not _exists(spark, f"{folder}/start"):
        return []
    at = starts(spark, folder, key)
    homed = changes.withColumn("__home", at.home(F.col(key)))
    acts, deletes = decide(at.first_of(F.col("__home")))
    acting = cut(homed.withColumn("__delete", F.coalesce(deletes, F.lit(False))).where(acts))
    candidates = at.with_copies({r[0] for r in acting.select("__home").distinct().collect()})
    files = _start_files(spark, folder)
    columns = [c for c in files.columns if c != "__file"]
    compared = _compared(_replayed(files.where(F.col("__file").isin(candidates)), acting, key, sets), key, columns, size)
    found = {r["__file"]: (r["rows"], r["differs"]) for r in compared.collect()}
    again = sorted(n for n, (_, differs) in found.items() if differs)
    steps = plan(found, len(at.first), size)
    if steps:
        # a change whose home stays comes out as a row of that home, and goes
        after = _replayed(files.where(F.col("__file").isin(again)), acting, key, sets)
        rows = after.where(F.col("a").isNotNull() & F.col("__file").isin(again)).select("__file", F.col(f"a.{key}").alias("__key"), _row([F.col(f"a.{c}") for c in columns]).alias("__tie"), "a")
        placed = ranked(rows, ["__file"], ["__key", "__tie"], cut, "__i")
        cuts = spark.createDataFrame(steps, "__file int, first int, larger long, more long, less long")
        i, edge = F.col("__i"), F.col("larger") * F.col("more")
        piece = F.when(i < edge, F.floor(i / F.col("more"))).otherwise(F.col("larger") + F.floor(F.try_divide(i - edge, F.col("less"))))
        cutted = placed.join(F.broadcast(cuts), "__file").select("a.*", (F.col("first") + piece).cast("int").alias("__out"))
        cutted.repartition("__out").sortWithinPartitions("__out", key).write.partitionBy("__out").mode("overwrite").parquet(f"{folder}/rewritten")
    _delete(spark, [f"{folder}/start/__file={n}" for n in again])
    return again


def _delete(spark: SparkSession, folders: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def report(spark: SparkSession, folder: str, key: str, sums: dict[str, Column]) -> DataFrame:
    """A row per data file: first_id, n_rows, `sums` (each a long, added up), ids_sha256 (of its keys in order, comma-joined), columns, path, rewritten."""
    parts = []
    for name, mark in (("start", False), ("rewritten", True)):
        if not _exists(spark, f"{folder}/{name}"):
            continue
        files = spark.read.parquet(f"{folder}/{name}")
        columns = [c for c in files.columns if c not in ("__file", "__out")]
        parts.append(files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col(key).cast("long").alias("id"), *(v.alias(c) for c, v in sums.items()), F.lit(",".join(columns)).alias("columns"), F.lit(mark).alias("rewritten")))
    names = list(sums)
    schema = ", ".join(["first_id long", "n_rows long", *(f"{c} long" for c in names), "ids_sha256 string", "columns string", "path string", "rewritten boolean"])
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            values = [first, count, *totals, digest.hexdigest(), columns, path, rewritten]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], [c.split()[0] for c in schema.split(", ")])

        path = None
        for b in batches:
            paths = b.column(0)
            edges = [0, *(np.flatnonzero(np.asarray(paths[1:]) != np.asarray(paths[:-1])) + 1), b.num_rows] if b.num_rows else [0]
            for a, z in zip(edges, edges[1:], strict=False):
                ids = [str(x) for x in b.column(2).slice(a, z - a).to_pylist()]
                if (here := paths[int(a)].as_py()) != path:
                    if path is not None:
                        yield out()
                    path, digest, count, totals = here, hashlib.sha256(), 0, [0] * len(names)
                    first, columns, rewritten = int(ids[0]), b.column(3 + len(names))[int(a)].as_py(), b.column(4 + len(names))[int(a)].as_py()
                digest.update(("," * (count > 0) + ",".join(ids)).encode())
                count += len(ids)
                totals = [t + int(np.sum(b.column(3 + i).slice(a, z - a).to_numpy(zero_copy_only=False))) for i, t in enumerate(totals)]
        if path is not None:
            yield out()

    return rows.repartition("path").sortWithinPartitions("path", "at").mapInArrow(lean(run), schema)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*=*")
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []) > 0
