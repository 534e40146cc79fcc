"""Streams of arrivals: points come in micro-batches and wait, binned, in a table until their arrival (seg, level) is whole.

An arrival may lie in any number of files and batches. Its rows say how many points it has (total); when so many are there it goes
to the mesher. Where total is null it is whole when the stream ends. A batch's points are read once, and what waits of them are the
sums of their bins, which add up over batches to those of the whole arrival. The waiting table is partitioned by segment, level and
batch: a batch that comes again overwrites its own part, an arrival reads and at last drops its own parts only.

The mesher's manifest holds, for the batch at work, which arrivals are in and whether its extract is done, so a batch that comes
again after a failure, in this process or another, goes on where it stopped. Points that come after their segment was refined
go to a table of rejects, with the reason, and so do arrivals that become whole too late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import REFINED, Config
from ..operators import bins as binning
from ..plans.mesher import IngestError, Mesher

POINTS = "seg int, level int, x long, y long, z long, nx long, ny long, nz long, r long, g long, b long, total long"
#: Sums of a bin's points in a batch; told: how many of them know the total.
SUMS = "seg int, level int, kx long, ky long, kz long, n long, sx long, sy long, sz long, sr long, sg long, sb long, nv long, snx long, sny long, snz long, told long, total long"
REJECTS = "seg int, level int, points long, reason string, batch string"
FILE = 1 << 20  # bins of a batch that go to one task to write
END = "end"  # the batch of what is done when the stream has ended

Late = tuple[int | str, int, int, str]


def arrivals(spark: SparkSession, folder: str, files_per_batch: int | None = 1) -> DataFrame:
    """A stream over Parquet files of POINTS, in order of arrival; total may be missing. files_per_batch: None for all that are there."""
    stream = spark.readStream.schema(POINTS)
    return (stream if files_per_batch is None else stream.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def binned(points: DataFrame, cfg: Config) -> DataFrame:
    """SUMS of points."""
    return binning.aggregate(points, cfg, F.count("total").alias("told"), F.max("total").alias("total"))


class Waiting:
    """The table of points, as sums of their bins, whose arrival is not whole yet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, sums: DataFrame, batch: int) -> None:
        """Adds a batch's points (binned), in place of what the batch added before."""
        sums.withColumn("batch", F.lit(batch)).write.partitionBy("seg", "level", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.folder)

    def _read(self, path: str = "") -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", self.folder).schema(f"{SUMS}, batch int").parquet(self.folder + path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def counts(self) -> list[tuple[int, int, int, int | None]]:
        """(level, seg, points, total) of every arrival that waits, previews first; total is null where some row does not know it."""
        rows = self._read()
        if rows is None:
            return []
        found = rows.groupBy("level", "seg").agg(F.sum("n").alias("points"), F.when(F.sum("told") == F.sum("n"), F.max("total")).alias("total"), F.count_if(F.col("n").isNull()).alias("other")).collect()
        if any(r["other"] for r in found):
            raise ValueError(f"{self.folder} has rows that are no sums of bins")  # points, as an earlier version kept them
        return sorted((r["level"], r["seg"], r["points"], r["total"]) for r in found)

    def sums(self, seg: int, level: int) -> DataFrame:
        """The sums of an arrival's bins, over all batches."""
        return binning.merged(self._read(f"/seg={seg}/level={level}").drop("told", "total", "batch"))

    def drop(self, seg: int, level: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/seg={seg}/level={level}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Replay:
    """Feeds a mesher; `folder` keeps the waiting points and the rejects. changed sees the changes of every batch, maybe twice."""

    def __init__(self, mesher: Mesher, folder: str, changed: Callable[[int | str, DataFrame], None] = lambda n, d: None):
        self.mesher, self.spark, self.changed = mesher, mesher.spark, changed
        self.folder = folder.rstrip("/")
        self.waiting = Waiting(self.spark, f"{self.folder}/waiting")

    def __call__(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        sums, done = binned(batch, self.mesher.cfg).persist(), self.mesher.done(number)
        try:
            found = sums.groupBy("seg", "level").agg(F.sum("n").alias("n"), F.count("*").alias("bins")).collect()
            came = [(r["seg"], r["level"], r["n"]) for r in found]
            refined = set(self.mesher.refined_segments()) - {seg for seg, level in done if level == REFINED}
            late = [(seg, level, n, self.mesher.refusal(level)) for seg, level, n in came if seg in refined]
            here = [(seg, level) for seg, level, _ in came if seg not in refined and (seg, level) not in done]
            if here:
                mine = self.spark.createDataFrame(here, "seg int, level int")
                files = sum(r["bins"] for r in found) // FILE + 1
                self.waiting.add(sums.join(F.broadcast(mine), ["seg", "level"], "left_semi").coalesce(files), number)  # mine: a row an arrival of the batch
            self._go_on(number, late, lambda points, total: total is not None and points >= total)
        finally:
            sums.unpersist()

    def finish(self) -> None:
        """The stream has ended: arrivals of unknown size are whole. What knows its size and lacks points goes on waiting."""
        self._go_on(END, [], lambda points, total: total is None)

    def _go_on(self, number: int | str, late: list[tuple[int, int, int, str]], whole: Callable[[int, int | None], bool]) -> None:
        for level, seg, points, total in self.waiting.counts():
            if whole(points, total):
                try:
                    self.mesher.ingest_sums(seg, level, self.waiting.sums(seg, level), number)
                except IngestError as e:
                    late.append((seg, level, points, str(e)))
                self.waiting.drop(seg, level)
        if late:
            self.spark.createDataFrame([(*r, str(number)) for r in late], REJECTS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/rejects/{number}")
        self.changed(number, self.mesher.extract(number))

    def rejects(self) -> DataFrame:
        """(seg, level, points, reason, batch) of all that came too late."""
        try:
            return self.spark.read.schema(REJECTS).parquet(f"{self.folder}/rejects/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], REJECTS)


def replay(spark: SparkSession, folder: str, mesher: Mesher, checkpoint: str, changed: Callable[[int | str, DataFrame], None] = lambda n, d: None, files_per_batch: int | None = 1, state: str | None = None, ends: bool = True) -> list[Late]:
    """Runs all files through the mesher and returns what was rejected (batch, seg, level, reason). state: by default beside the checkpoint.

    Where the stream does not end yet, a later call with the same checkpoint goes on with the files that came since.
    """
    run = Replay(mesher, state or f"{checkpoint.rstrip('/')}-points", changed)
    query = arrivals(spark, folder, files_per_batch).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if ends:
        run.finish()
    return [(r["batch"] if r["batch"] == END else int(r["batch"]), r["seg"], r["level"], r["reason"]) for r in run.rejects().orderBy("batch", "seg", "level").collect()]
