"""Point files as a data source: layouts, strides, ranges, and which files a filtered read opens."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.sources import ply, points


def rows(n, first=0):
    out = np.zeros(n, ply.RECORD)
    out["x"], out["r"], out["nz"] = np.arange(first, first + n), np.arange(n) % 256, 1
    return out


@pytest.fixture
def pushing(spark):
    spark.conf.set(points.PUSHDOWN, "true")
    yield
    spark.conf.unset(points.PUSHDOWN)


@pytest.fixture
def folder(tmp_path):
    for k, name in enumerate(("r0_refined", "r0_preview_new", "r1_refined", "r1_preview_new", "r3_refined", "rx_refined", "other")):
        ply.write_points(f"{tmp_path}/{name}.ply", rows(103, 1000 * k))
    return str(tmp_path)


def got(df):
    return sorted((r["seg"], r["level"], r["ord"], r["x"], r["r"], r["nz"]) for r in df.collect())


def want(seg, level, first, n=103, stride=1):
    return [(seg, level, i, float(first + i), i % 256, 1.0) for i in range(0, n, stride)]


def test_segments_up_to_the_first_gap(spark, folder):
    assert got(points.read(spark, folder)) == sorted(want(0, 1, 0) + want(0, 0, 1000) + want(1, 1, 2000) + want(1, 0, 3000))
    os.remove(f"{folder}/r1_preview_new.ply")
    with pytest.raises(FileNotFoundError, match="r1_preview_new.ply"):
        points.read(spark, folder)


def test_filters_keep_other_files_closed(spark, folder, pushing):
    """Files that the filter excludes are broken: opening one would fail."""
    for name in ("r0_refined", "r0_preview_new", "r1_preview_new"):
        with open(f"{folder}/{name}.ply", "wb") as f:
            f.write(b"no point file")
    every = points.read(spark, folder)
    assert got(every.where((F.col("seg") == 1) & (F.col("level") == 1))) == want(1, 1, 2000)
    assert got(every.where(F.col("seg").isin(1, 5) & (F.col("level") == 1) & (F.col("ord") < 10))) == want(1, 1, 2000, 10)
    assert got(every.where((F.col("seg") == 1) & (F.col("seg") == 0))) == got(every.where("seg = 7")) == []
    with pytest.raises(Exception, match="not a PLY file"):
        every.where("seg = 1").collect()


def test_chunks_and_their_previews(spark, tmp_path):
    for k, name in enumerate(("tc_b", "tc_a", "r0_refined")):
        ply.write_points(f"{tmp_path}/{name}.ply", rows(50, 1000 * k))
    df = points.read(spark, str(tmp_path), "chunks")
    assert got(df.where("level = 1")) == want(0, 1, 1000, 50) + want(1, 1, 0, 50)
    thin = sorted((r["seg"], r["ord"], r["x"]) for r in df.where("level = 0").collect() if np.isnan([r["nx"], r["ny"], r["nz"]]).all())
    assert thin == [(0, i, 1000.0 + i) for i in range(0, 50, 4)] + [(1, i, float(i)) for i in range(0, 50, 4)]
    assert df.where("level = 0").count() == len(thin)


@pytest.mark.parametrize("stride", [1, 3, 7, 64, 500])
def test_ranges_and_batches_give_each_record_once(folder, stride, monkeypatch):
    """Ranges, batches and strides that do not divide each other, without Spark between planning and reading."""
    monkeypatch.setattr(ply, "RANGE", 20)
    monkeypatch.setattr(points, "BATCH", 8)
    reader = points.PointReader(folder, "segments", stride)
    ords = {}
    for p in reader.partitions():
        for b in reader.read(p):
            ords.setdefault((p.seg, p.level), []).extend(b.column("ord").to_pylist())
            assert b.column("x").to_pylist() == [o + {(0, 1): 0, (0, 0): 1000, (1, 1): 2000, (1, 0): 3000}[p.seg, p.level] for o in b.column("ord").to_pylist()]
    assert ords == {(s, v): list(range(0, 103, stride)) for s in (0, 1) for v in (0, 1)}


def test_odd_folders_and_options(spark, tmp_path):
    assert points.read(spark, str(tmp_path)).count() == 0 == points.read(spark, str(tmp_path), "chunks").count()
    ply.write_points(f"{tmp_path}/tc_0.ply", rows(0))
    assert points.read(spark, str(tmp_path), "chunks").count() == 0
    with pytest.raises(ValueError):
        points.read(spark, str(tmp_path), stride=0)
    with pytest.raises(KeyError):
        points.read(spark, str(tmp_path), "tiles")
