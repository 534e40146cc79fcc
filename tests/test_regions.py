"""State by regions: what a step reads and writes, merging of parts, and what is deleted."""

import contextlib
import io
import json

import pytest
from pyspark.sql import functions as F

from pointweave.config import BASE, Config
from pointweave.plans import regions
from pointweave.plans.mesher import HeightMesher, SurfaceMesher
from tests.test_engine import blocks, plane

CFG = Config(block_dim=8)  # a block is 1600 mm wide, a region 12,800


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("kind", [SurfaceMesher, HeightMesher])
def test_a_step_reads_what_lies_around_its_dirty_blocks(spark, tmp_path, kind):
    more, steps = (("up",), 4) if kind is SurfaceMesher else ((), 3)
    m, read = kind(spark, f"{tmp_path}/m", CFG, *more), []
    for k in range(steps):
        m.ingest(k, 1, plane(spark, 38_400 * k, 38_400 * k + 1500, 0, 1500, 0))
        near = regions.around(m._dirty())
        rows = m.field(near=near)
        read.append((len(files(rows)), rows.count()))
        assert sum(near.meets(p) for p in m._kept["layers"][str(BASE)]) == 1  # other segments are not even opened
        assert "region" in plan(rows).split("PartitionFilters: [", 1)[1].split("\n", 1)[0]
        m.extract().count()
        assert m._state(near).count() == m.extract_stats().updated
    assert read == [read[0]] * steps and read[0][1] > 0
    assert len(m._kept["parts"]) <= 3 and m.meshes().count() == m.block_count() == m._state().count()
    one = kind(spark, f"{tmp_path}/one", CFG, *more)
    for k in range(steps):
        one.ingest(k, 1, plane(spark, 38_400 * k, 38_400 * k + 1500, 0, 1500, 0))
    assert blocks(one.extract()) == blocks(m.meshes())


def test_parts_are_merged_and_the_newest_row_holds(spark, tmp_path):
    m, held = SurfaceMesher(spark, f"{tmp_path}/m", CFG, "up", False), {}
    for step in range(5):
        z = 100 * step if step != 3 else 30_000  # the fourth sheet leaves the blocks of the others without a mesh
        m.ingest(7, 0, plane(spark, -3000, 3000 + 400 * step, -500, 500, z))
        for r in m.extract().collect():
            key = (r["bx"], r["by"], r["bz"])
            assert r["version"] == m.version(key) == held.get(key, (0,))[0] + 1
            held[key] = (r["version"], r["positions"] and (r["positions"], r["colors"], r["indices"]))
        assert {k: v for k, (_, v) in held.items() if v} == blocks(m.meshes())
    sizes = [p["rows"] for p in m._kept["parts"]]
    assert all(a > 2 * sum(sizes[i + 1 :]) for i, a in enumerate(sizes))
    again = SurfaceMesher(spark, f"{tmp_path}/m", CFG, "up", False)
    assert blocks(again.meshes()) == blocks(m.meshes()) and again._kept == json.loads(json.dumps(m._kept))


def test_vacuum_deletes_what_nothing_names(spark, tmp_path):
    m = SurfaceMesher(spark, f"{tmp_path}/m", CFG, "up", False)
    assert m.vacuum() == 0
    for z in (0, 300, 600):
        m.ingest(1, 0, plane(spark, 0, 2000, 0, 2000, z))
        m.extract()
    (tmp_path / "m" / "rows" / "part=99999999").mkdir()  # left by a step that failed
    before = blocks(m.meshes())
    assert m.vacuum(1) > 5 and m.vacuum(1) == 0
    assert [p.name for p in (tmp_path / "m" / "rows").iterdir()] == [f"part={m._kept['layers']['1'][0]['part']}"]
    assert len(list((tmp_path / "m").glob("manifest-*"))) == 1 and not list((tmp_path / "m").glob("dirty-*"))
    again = SurfaceMesher(spark, f"{tmp_path}/m", CFG, "up", False)
    assert blocks(again.meshes()) == before != {}
    assert again.ingest(1, 1, plane(spark, 0, 2000, 0, 2000, 0)).removed_preview and again.extract().count() > 0


def test_more_regions_than_are_named(spark, tmp_path, monkeypatch):
    named = SurfaceMesher(spark, f"{tmp_path}/a", CFG, "up")
    joined = SurfaceMesher(spark, f"{tmp_path}/b", CFG, "up")
    for m, bound in ((named, regions.NAMED), (joined, 1)):
        monkeypatch.setattr(regions, "NAMED", bound)
        m.ingest(0, 1, plane(spark, -20_000, 20_000, 0, 1000, 0))
        m.ingest(1, 1, plane(spark, 19_000, 30_000, 0, 1000, 0))
        m.extract()
    near = regions.around(joined._blocks.read(joined._kept["parts"]))
    assert near.names is None and near.box[0][0] < 0 < near.box[0][1]
    assert blocks(named.meshes()) == blocks(joined.meshes()) != {}


def test_empty_arrivals(spark, tmp_path):
    m = SurfaceMesher(spark, f"{tmp_path}/m", CFG)
    assert m.ingest(0, 0, plane(spark, 0, 100, 0, 100, 0).where("false")).dirty_blocks == 0
    assert m.extract().count() == 0 and m.field().count() == m.field_bytes() == 0 and m.meshes().count() == 0
    m.ingest(0, 1, plane(spark, 0, 2000, 0, 2000, 0))
    assert m.extract().count() > 0
