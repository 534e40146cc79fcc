"""The streamed queries' input: whole, in the batches meant, and written by all tasks that read the table."""

import os

from pointweave.config import Config
from pointweave.operators import bins as binning
from pointweave.plans import queries
from pointweave.plans.mesher import SurfaceMesher
from pointweave.plans.points import point_view
from pointweave.streaming import replay
from pyspark.sql import functions as F

from .test_engine import plane


def test_no_task_writes_a_whole_half_of_an_arrival(spark, tmp_path, monkeypatch):
    d = f"{tmp_path}/sf"
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    table.repartition(6).write.parquet(f"{d}/lineitem.parquet")
    came = []

    def took(spark, folder, mesher, checkpoint, changed, **options):
        came.append(spark.read.parquet(folder).withColumn("file", F.input_file_name()).cache())
        came[-1].count()

    monkeypatch.setattr(replay, "replay", took)
    size = os.path.getsize("/root/testdata/sf0.001/lineitem.parquet") // 6
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", size)
    try:
        queries._streamed(spark, d)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    last = came[-1]
    halves = last.withColumn("half", F.pmod(F.xxhash64("x", "y", "z"), F.lit(2))).groupBy("seg", "level", "half")
    assert [r["files"] > 1 for r in halves.agg(F.countDistinct("file").alias("files")).collect()] == [True] * 12
    points = point_view(spark, d)
    assert last.select(points.columns).exceptAll(points).count() == points.exceptAll(last.select(points.columns)).count() == 0
    totals = {(r["seg"], r["level"], r["count"]) for r in points.groupBy("seg", "level").count().collect()}
    assert {(r["seg"], r["level"], r["total"]) for r in last.select("seg", "level", "total").distinct().collect()} == totals
    # of six arrivals, 1, 3 and 6 are whole after the three batches
    whole = [sum(r["count"] == r["total"] for r in c.groupBy("seg", "level", "total").count().collect()) for c in came]
    assert whole == [1, 3, 6]


def test_a_stream_goes_on_with_the_files_that_came_since(spark, tmp_path):
    """One batch a call takes all files; an arrival of unknown size is open until the stream ends."""
    points = plane(spark, 0, 800, 0, 800, 0).withColumn("total", F.lit(None).cast("long"))
    mesher, seen = SurfaceMesher(spark, f"{tmp_path}/state", Config(block_dim=8), "up", False), []
    for i in range(2):
        points.where(f"x {'<' if i == 0 else '>='} 400").repartition(3).write.parquet(f"{tmp_path}/in/{i}")
        replay.replay(spark, f"{tmp_path}/in/*", mesher, f"{tmp_path}/checkpoint", lambda n, c: seen.append(n), None, ends=i == 1)
        assert (i, mesher.refined_segments()) in [(0, []), (1, [0])]
    assert seen == [0, 1, replay.END]
    one = SurfaceMesher(spark, f"{tmp_path}/one", Config(block_dim=8), "up", False)
    one.ingest(0, 1, points.drop("total"))
    assert mesher.field().exceptAll(one.field()).count() == one.field().exceptAll(mesher.field()).count() == 0


def test_what_waits_grows_with_bins_and_not_with_points(spark, tmp_path):
    """Forty points a place wait as one row a bin and batch; the arrival is whole by its points, and equals one of all points."""
    place = plane(spark, 0, 800, 0, 800, 0)
    dense = place.crossJoin(spark.range(40).select(F.col("id").alias("i"))).withColumn("x", F.col("x") + F.col("i") % 7).drop("i")
    n, cfg = dense.count(), Config(block_dim=8)
    dense = dense.withColumn("total", F.lit(3 * n).cast("long"))
    mesher = SurfaceMesher(spark, f"{tmp_path}/state", cfg, "up", False)
    run = replay.Replay(mesher, f"{tmp_path}/points")
    bins = binning.aggregate(dense, cfg).count()
    assert bins * 4 < n
    for batch, points in ((0, 1), (1, 2), (1, 2)):  # the second one comes again
        run(dense, batch)
        assert spark.read.parquet(f"{tmp_path}/points/waiting").count() == points * bins
        assert run.waiting.counts() == [(1, 0, points * n, 3 * n)]
    run(dense.withColumn("total", F.when(F.col("x") > 0, F.col("total"))), 2)  # not all of its points know the total
    assert run.waiting.counts() == [(1, 0, 3 * n, None)] and mesher.refined_segments() == []
    run.finish()
    assert run.waiting.counts() == [] and mesher.refined_segments() == [0]
    one = SurfaceMesher(spark, f"{tmp_path}/one", cfg, "up", False)
    assert one.ingest(0, 1, dense.unionByName(dense).unionByName(dense).drop("total")).input_points == 3 * n
    assert mesher.field().exceptAll(one.field()).count() == one.field().exceptAll(mesher.field()).count() == 0


def test_sums_of_parts_add_up_to_those_of_all_points(spark):
    """Nulls too: a bin whose points lack a coordinate or a colour, in some parts or in all."""
    rows = [(0, 1, i % 5 * 60, 10 if i % 11 else None, 7, 0, i % 3 * 400, 1000 if i % 4 else None, None if i % 2 else i, 3, None) for i in range(300)]
    points = spark.createDataFrame(rows, "seg int, level int, x long, y long, z long, nx long, ny long, nz long, r long, g long, b long")
    parts = [binning.aggregate(points.where(F.col("r").isNull() == odd)) for odd in (True, False)]
    merged, whole = binning.merged(parts[0].unionByName(parts[1])), binning.aggregate(points)
    assert merged.columns == whole.columns
    assert merged.exceptAll(whole).count() == whole.exceptAll(merged).count() == 0
