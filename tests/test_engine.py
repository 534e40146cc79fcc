import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.config import NORMAL_ONE, Config
from pointweave.operators import bins as binning
from pointweave.operators import field as fields
from pointweave.operators import incremental, mesh, normals, orient, surface
from pointweave.operators.rank import ranked
from pointweave.plans import job, queries
from pointweave.plans.lineage import Scratch, cut
from pointweave.plans.mesher import HeightMesher, IngestError, SurfaceMesher
from pointweave.plans.points import point_view, stride
from pointweave.sources import ply
from pointweave.sources import points as point_files
from pointweave.streaming import replay

CFG = Config(block_dim=8)
POINT = "seg int, level int, x long, y long, z long, nx long, ny long, nz long, r long, g long, b long"


def plane(spark, x0, x1, y0, y1, z, step=50, seg=0, level=1):
    rows = [(seg, level, x, y, z, 0, 0, 1000, 200, 100, 50) for x in range(x0, x1, step) for y in range(y0, y1, step)]
    return spark.createDataFrame(rows, POINT)


def mesh_of(spark, pts, cfg=CFG):
    b = cut(normals.estimate(binning.bins(pts, cfg), cfg))
    seen = cut(fields.observed(fields.layer_sum(fields.field(b, cfg)), cfg))
    return surface.quads(seen, surface.vertices(seen, cfg), cfg)


def test_a_level_sheet_gives_level_upward_quads(spark):
    found = cut(mesh_of(spark, plane(spark, -1600, 1800, -2200, 1400, -70)))
    assert found.count() > 150
    v = surface.block_vertices(found).toPandas()
    assert (abs(v.z + 70_000) < 20_000).all() and set(v.r) == {200} and set(v.g) == {100} and set(v.b) == {50}
    for q in found.collect():
        p = [np.array([q[k]["x"], q[k]["y"], q[k]["z"]], float) for k in ("q0", "q1", "q2", "q3")]
        assert np.cross(p[1] - p[0], p[2] - p[0])[2] > 0 and np.cross(p[2] - p[0], p[3] - p[0])[2] > 0


def test_results_do_not_depend_on_partitions(spark):
    pts = point_view(spark, "/root/testdata/sf0.001")
    digests = lambda p: sorted(map(tuple, incremental.digests(surface.meshes(mesh_of(spark, p))).collect()))
    assert digests(pts.repartition(13)) == digests(pts.coalesce(1))


def test_splat_equals_a_voxel_by_voxel_sum(spark):
    rng = np.random.default_rng(5)
    rows = [(0, 1, i, 0, 0, 1, *map(int, rng.integers(-900, 900, 3)), *map(int, rng.integers(-600_000, 600_000, 3)), 10, 20, 30, True) for i in range(40)]
    b = spark.createDataFrame(rows, "seg int, level int, kx long, ky long, kz long, n long, px long, py long, pz long, nx long, ny long, nz long, r long, g long, b long, fixed boolean")
    want = {}
    for r in rows:
        p, n = np.array(r[6:9]), np.array(r[9:12])
        for g in np.ndindex(15, 15, 15):
            g = np.array(g) - 7
            d = g * 200 - p
            if (q := int(d @ d)) <= 160_000:
                w = int(np.floor(np.exp(-q / 80_000) * 2**24 + 0.5))
                dist = int(n @ d) / 1000
                dist = int(np.sign(dist) * np.floor(abs(dist) + 0.5))
                s = want.setdefault(tuple(g), np.zeros(5, np.int64))
                s += np.array([w * dist, w, 10 * w, 20 * w, 30 * w])
    got = {(r["gx"], r["gy"], r["gz"]): [r[c] for c in fields.SUMS] for r in fields.field(b).collect()}
    assert got == {k: v.tolist() for k, v in want.items()}


def test_smallest_eigenvector(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        m = q @ np.diag([1.0, rng.uniform(5, 9), rng.uniform(20, 90)]) @ q.T
        rows.append((*m[[0, 1, 2, 0, 0, 1], [0, 1, 2, 1, 2, 2]].tolist(), *(q[:, 0] * np.sign(q[2, 0])).tolist()))
    rows.append((0.0,) * 6 + (0.0, 0.0, 1.0))
    f = spark.createDataFrame(rows, "xx double, yy double, zz double, xy double, xz double, yz double, wx double, wy double, wz double")
    for r in normals.smallest_eigenvector(f, ("ex", "ey", "ez")).collect():
        assert np.allclose([r["ex"] / NORMAL_ONE, r["ey"] / NORMAL_ONE, r["ez"] / NORMAL_ONE], [r["wx"], r["wy"], r["wz"]], atol=1e-5)


def test_least_eigenvectors_of_degenerate_planes(spark):
    """Equal, nearly equal and vanishing eigenvalues, at many scales: the vector's quotient is the least eigenvalue."""
    rng = np.random.default_rng(11)
    rows, least = [], []
    for i in range(400):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        gap = 10.0 ** rng.integers(-9, 1)
        values = np.array([(0, 0, 1), (0, 1, 1), (1, 1, 1), (0.2, 0.2 + gap, 1), (0, gap, 1), (0.5, 1, 1 + gap), (gap, gap, 1), (0, 0, 0)][i % 8]) * 10.0 ** rng.integers(-6, 7)
        m = q @ np.diag(values) @ q.T
        rows.append((i, *m[[0, 1, 2, 0, 0, 1], [0, 1, 2, 1, 2, 2]].tolist()))
        least.append((m, values))
    for r in normals.smallest_eigenvector(spark.createDataFrame(rows, "i int, xx double, yy double, zz double, xy double, xz double, yz double"), ("ex", "ey", "ez")).collect():
        m, values = least[r["i"]]
        v = np.array([r["ex"], r["ey"], r["ez"]]) / NORMAL_ONE
        assert abs(v @ v - 1) < 1e-5 and v[2] >= 0
        assert v @ m @ v - values[0] <= 1e-6 * values.sum(), (values, v)
        if values[1] - values[0] >= 1e-4 * values.sum() > 0:
            w = np.linalg.eigh(m)[1][:, 0]
            assert abs(abs(v @ w) - 1) < 1e-9 + 2e-6, (values, v, w)


def test_preview_then_refined_is_refined_only(spark, tmp_path):
    one, two = SurfaceMesher(spark, f"{tmp_path}/a", CFG), SurfaceMesher(spark, f"{tmp_path}/b", CFG)
    copy = {}

    def follow(changed):
        for r in changed.collect():
            key = (r["bx"], r["by"], r["bz"])
            if r["positions"] is None:
                copy.pop(key, None)
            else:
                copy[key] = (r["positions"], r["colors"], r["indices"])
            assert r["version"] == one.version(key)

    one.ingest(1, 0, plane(spark, -1000, 1500, -1000, 1000, 400, 100))
    follow(one.extract())
    one.ingest(2, 0, plane(spark, 2000, 4000, -600, 600, 100))
    follow(one.extract())
    assert one.ingest(1, 1, plane(spark, -1000, 2500, -1000, 1000, 0)).removed_preview
    assert one.pending_segments() == [2] and one.dirty_count() > 0
    follow(one.extract())
    with pytest.raises(IngestError, match="AlreadyRefined"):
        one.ingest(1, 1, plane(spark, 0, 100, 0, 100, 0))
    with pytest.raises(IngestError, match="PreviewAfterRefined"):
        one.ingest(1, 0, plane(spark, 0, 100, 0, 100, 0))
    one.ingest(2, 0, plane(spark, 2000, 4000, -600, 600, 100))
    assert one.extract().count() == 0  # the same preview again changes nothing
    two.ingest(1, 1, plane(spark, -1000, 2500, -1000, 1000, 0))
    two.ingest(2, 0, plane(spark, 2000, 4000, -600, 600, 100))
    full = {(r["bx"], r["by"], r["bz"]): (r["positions"], r["colors"], r["indices"]) for r in two.extract().collect()}
    assert copy == full


def blocks(rows):
    return {(r["bx"], r["by"], r["bz"]): (r["positions"], r["colors"], r["indices"]) for r in rows.collect()}


def test_height_surface_replaces_previews(spark, tmp_path):
    a, b = HeightMesher(spark, f"{tmp_path}/a", CFG), HeightMesher(spark, f"{tmp_path}/b", CFG)
    copy = {}
    for level, end, z in ((0, 2000, 1000), (1, 3000, 0)):
        stats = a.ingest(0, level, plane(spark, 0, end, 0, 2000, z))
        assert stats.input_points == end // 50 * 40 and stats.removed_preview == (level == 1) and stats.dirty_blocks == a.dirty_count() > 0
        for r in a.extract().collect():
            copy[r["bx"], r["by"], r["bz"]] = (r["positions"], r["colors"], r["indices"])
            assert r["version"] == a.version((r["bx"], r["by"], r["bz"]))
    b.ingest(0, 1, plane(spark, 0, 3000, 0, 2000, 0))
    want = blocks(b.extract())
    assert {k: v for k, v in copy.items() if v[0]} == want == blocks(a.meshes()) != {}
    for p, c, t in want.values():
        assert set(p[2::3]) == {0} and c[:3] == [200, 100, 50] and max(t) == len(p) // 3 - 1
    with pytest.raises(IngestError, match="PreviewAfterRefined"):
        a.ingest(0, 0, plane(spark, 0, 100, 0, 100, 0))
    assert a.extract().count() == 0 and a.extract_stats().reextracted == 0


def test_height_steps_leave_gaps(spark, tmp_path):
    """Cells whose heights differ by more than twice the radius have no quad between them."""
    m = HeightMesher(spark, f"{tmp_path}/m", CFG)
    m.ingest(0, 1, plane(spark, 0, 800, 0, 800, 0).unionByName(plane(spark, 800, 1600, 0, 800, 900)))
    m.extract()
    assert m.total_tris() == 2 * 2 * 3 * 3 and m.block_count() == 1
    assert {tuple(r) for r in m.block_ids().collect()} == {(0, 0, 0)}


def test_mesher_answers_about_blocks(spark, tmp_path):
    m = SurfaceMesher(spark, f"{tmp_path}/m", CFG)
    assert m.extract().count() == 0 and m.version((0, 0, 0)) == 0 and m.mesh((0, 0, 0)) is None and m.total_tris() == 0
    stats = m.ingest(4, 0, plane(spark, 0, 2000, 0, 2000, 100))
    assert stats.input_points == 1600 and stats.bins + stats.bins_dropped == 400 and not stats.removed_preview
    changed = m.extract().collect()
    e = m.extract_stats()
    assert e.updated == len(changed) > 0 and e.reextracted == e.updated + e.unchanged_direct + e.unchanged_neighbor + e.unchanged_empty
    first = changed[0]
    got = m.mesh((first["bx"], first["by"], first["bz"]))
    assert got.version == 1 and got.positions == first["positions"] and got.tri_count == len(first["indices"]) // 3
    assert m.total_tris() == sum(len(r["indices"]) // 3 for r in changed)
    assert m.mesh_bytes() == sum(m.mesh((r["bx"], r["by"], r["bz"])).heap_bytes for r in changed)
    assert m.field_bytes() > 0 and m.layers() == m.pending_segments() == [4] and m.layer_ranges().first()["layer"] == 4


def test_reopened_mesher_goes_on_and_batches_are_done_once(spark, tmp_path):
    pts = {0: plane(spark, 0, 1500, 0, 1500, 300), 1: plane(spark, 0, 2000, 0, 1500, 0)}
    one = SurfaceMesher(spark, f"{tmp_path}/one", CFG, "up", False)
    one.ingest(0, 0, pts[0])
    one.extract()
    one.ingest(0, 1, pts[1])
    one.extract()
    a = SurfaceMesher(spark, f"{tmp_path}/two", CFG, "up", False)
    a.ingest(0, 0, pts[0], batch=0)
    first = blocks(a.extract(batch=0))
    b = SurfaceMesher(spark, f"{tmp_path}/two", CFG, "up", False)  # as after a restart of the driver
    assert b.pending_segments() == [0] and blocks(b.extract(batch=0)) == first
    assert b.ingest(0, 1, pts[1], batch=1).removed_preview
    c = SurfaceMesher(spark, f"{tmp_path}/two", CFG, "up", False)  # batch 1 comes again before its extract
    assert c.ingest(0, 1, pts[1], batch=1).removed_preview and c.refined_segments() == [0]
    last = blocks(c.extract(batch=1))
    assert last and blocks(c.extract(batch=1)) == last
    with pytest.raises(IngestError, match="AlreadyRefined"):
        c.ingest(0, 1, pts[1], batch=2)
    assert blocks(c.meshes()) == blocks(one.meshes())


def test_arrivals_over_files_and_batches_lose_nothing(spark, tmp_path):
    """Arrivals in pieces, of known and unknown size; late points; a batch that fails after its ingest and comes again."""
    wide, low = plane(spark, 0, 4000, 0, 800, 0), plane(spark, 0, 2000, 0, 800, 300, seg=2, level=0)
    known = lambda df, n: df.withColumn("total", F.lit(n).cast("long"))
    n = wide.count()
    files = [known(wide.where("x < 2000"), n), known(low.where("x < 1000"), None), known(low.where("x >= 1000"), None), known(wide.where("x >= 2000"), n), known(wide.where("x < 100"), n), known(plane(spark, 0, 300, 0, 300, 0, seg=3), 1000)]
    for i, f in enumerate(files):
        f.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    mesher = SurfaceMesher(spark, f"{tmp_path}/state", CFG, "up", False)
    failed, seen, copy = [], [], {}

    def changed(number, rows):
        seen.append(number)
        for r in rows.collect():
            copy[r["bx"], r["by"], r["bz"]] = r["positions"] and (r["positions"], r["colors"], r["indices"])
        if number == 3 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the ingest")

    run = lambda m: replay.replay(spark, f"{tmp_path}/in/*", m, f"{tmp_path}/checkpoint", changed)
    with pytest.raises(Exception, match="lost after the ingest"):
        run(mesher)
    mesher = SurfaceMesher(spark, f"{tmp_path}/state", CFG, "up", False)
    assert run(mesher) == [(4, 0, 1, "AlreadyRefined")]
    assert seen == [0, 1, 2, 3, 3, 4, 5, replay.END] and mesher.refined_segments() == [0] and mesher.pending_segments() == [2]
    one = SurfaceMesher(spark, f"{tmp_path}/one", CFG, "up", False)
    one.ingest(0, 1, wide)
    one.ingest(2, 0, low)
    assert {k: v for k, v in copy.items() if v} == blocks(mesher.meshes()) == blocks(one.extract())
    waiting = replay.Waiting(spark, f"{tmp_path}/checkpoint-points/waiting")
    assert waiting.counts() == [(1, 3, 36, 1000)] and mesher.dirty_count() == 0
    # what came of segment 2's refined version as the stream ended is whole by then; the preview that follows is too late
    for i, f in ((6, known(plane(spark, 0, 2000, 0, 800, 0, seg=2), None)), (7, known(low, None))):
        f.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    assert (replay.END, 2, 0, "PreviewAfterRefined") not in run(mesher)  # previews go first at the end
    assert mesher.refined_segments() == [0, 2] and mesher.pending_segments() == []


def test_extract_simplifies(spark, tmp_path):
    fine, coarse = SurfaceMesher(spark, f"{tmp_path}/a", CFG, "up", False), SurfaceMesher(spark, f"{tmp_path}/b", Config(block_dim=8, simplify_error=20), "up", False)
    for m in (fine, coarse):
        m.ingest(0, 1, plane(spark, 0, 3000, 0, 3000, 700))
        m.extract()
    assert 0 < coarse.total_tris() < fine.total_tris() / 2


def test_far_vertices_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    v, p = rng.integers(-500, 500, (200, 3)), rng.integers(-500, 500, (300, 3))
    to = lambda a: spark.createDataFrame([tuple(map(int, r)) for r in a], "x long, y long, z long")
    far = ((v[:, None, :] - p[None]) ** 2).sum(-1).min(1) > 70**2
    got = mesh.far_fraction(to(v), to(p), 70).first()
    assert (got["vertices"], got["far"]) == (200, int(far.sum()))
    assert mesh.far_fraction(to(v).where("false"), to(p), 70).first()["fraction"] == 0


def test_simplify_keeps_seams_and_flatness(spark):
    n = 9
    pts = np.array([(x, y, 0.0) for y in range(n) for x in range(n)])
    tri = [t for y in range(n - 1) for x in range(n - 1) for a in [y * n + x] for t in ((a, a + 1, a + n + 1), (a, a + n + 1, a + n))]
    edge = np.array([x in (0, n - 1) or y in (0, n - 1) for x, y, _ in pts])
    out = mesh.collapse(pts, np.array(tri), edge, 0.01)
    assert len(out) < len(tri) // 2 and set(np.flatnonzero(edge)) <= set(out.reshape(-1))
    area = np.cross(pts[out[:, 1]] - pts[out[:, 0]], pts[out[:, 2]] - pts[out[:, 0]])[:, 2]
    assert (area > 0).all() and abs(area.sum() / 2 - (n - 1) ** 2) < 1e-9


def test_point_files(spark, tmp_path):
    rows = np.zeros(1003, ply.RECORD)
    rows["x"], rows["r"], rows["nz"] = np.arange(1003), np.arange(1003) % 256, 1
    rows["nz"][5] = np.nan
    for name in ("r0_refined", "r0_preview_new", "r1_refined", "r1_preview_new", "r3_refined"):
        ply.write_points(f"{tmp_path}/{name}.ply", rows)
    got = ply.read_points(spark, f"{tmp_path}/r0_refined.ply", 4).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(0, 1003, 4)) and [r["x"] for r in got] == list(range(0, 1003, 4))
    assert {(r["seg"], r["level"]) for r in point_files.read(spark, str(tmp_path)).select("seg", "level").distinct().collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    head, body = rows.tobytes(), None
    del body
    good = open(f"{tmp_path}/r0_refined.ply", "rb").read()
    assert ply.header(good + b"tail") == ply.header(good)
    assert ply.header(good.replace(b"float n", b"float32 n").replace(b"uchar red", b"uint8 red"))[1] == 1003
    for bad in (b"plx" + good[3:], good[:-1], good.replace(b"float nx", b"float mx"), good.replace(b"binary_little", b"binary_biggg"), good.replace(b"vertex 1003", b"vertex 1004"), good.replace(b"element vertex", b"element points")):
        with pytest.raises(ValueError):
            ply.header(bad)
    assert head
    with pytest.raises(ValueError):
        stride(spark.range(3), 0)
    points = binning.quantise(spark.createDataFrame([(0.1, 0.2, float("nan"), 0.0, 0.0, 1.0), (0.1, 0.2, 0.3, float("nan"), 0.0, 1.0)], "x double, y double, z double, nx double, ny double, nz double"))
    assert [(r["x"], r["z"], r["nz"]) for r in points.collect()] == [(100, 300, 0)]


def test_steps():
    assert ply.steps([0, 1], "pr") == [[(0, 0)], [(0, 1)], [(1, 0)], [(1, 1)]]
    assert ply.steps([0, 1]) == [[(0, 0)], [(0, 1), (1, 0)], [(1, 1)]]


def test_halo_rule(spark):
    v = lambda *g: spark.createDataFrame([g], "gx long, gy long, gz long")
    got = lambda *g: {(r["bx"], r["by"], r["bz"]): r["direct"] for r in incremental.halo(v(*g), CFG).collect()}
    assert got(3, 3, 3) == {(0, 0, 0): True}
    assert got(0, 3, 3) == {(0, 0, 0): True, (-1, 0, 0): False}
    assert (1, 1, 1) not in got(7, 7, 7) and len(got(7, 7, 7)) == 7
    assert len(got(0, 0, 0)) == 8


def test_block_record():
    raw = ply.block_bytes((1, -2, 3), 4, np.arange(3), np.array([1, 2, 3]), np.array([], np.uint32))
    assert raw[:4] == b"SLMB" and len(raw) == 4 + 28 + 12 + 4 and int.from_bytes(raw[24:28], "little") == 1


def test_weld_counts_equal_positions(spark):
    rows = [(0, 0, 0, 0, 1, 2, 3, 9, 9, 9), (1, 0, 0, 0, 1, 2, 3, 7, 7, 7), (1, 0, 0, 1, 4, 5, 6, 1, 1, 1)]
    w = mesh.weld(spark.createDataFrame(rows, "bx long, by long, bz long, idx int, x long, y long, z long, r int, g int, b int"))
    assert {tuple(r) for r in w.collect()} == {(1, 2, 3, 9, 9, 9, 2), (4, 5, 6, 1, 1, 1, 1)}
    assert sorted(r["idx"] for r in mesh.numbered(w, cut).collect()) == [0, 1]
    assert w.agg(F.sum("uses")).first()[0] == 3


def test_far_fraction_query_looks_at_points_of_every_segment(spark):
    d = "/root/testdata/sf0.001"
    v = queries._vertices_mm(spark, d).distinct().toPandas().to_numpy()
    p = point_view(spark, d).select("x", "y", "z").distinct().toPandas().to_numpy()
    near = np.array([(((p - q) ** 2).sum(axis=1) <= 100 * 100).any() for q in v])
    got = queries.q_far_fraction(spark, d).first()
    assert (got["vertices"], got["far"]) == (len(v), int((~near).sum()))
    assert got["fraction"] == round((~near).mean(), 6)


def test_ranges_of_records_are_read_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ply, "RANGE", 100)
    rows = np.zeros(1003, ply.RECORD)
    rows["x"], rows["b"] = np.arange(1003), np.arange(1003) % 200
    ply.write_points(f"{tmp_path}/p.ply", rows)
    for stride_ in (1, 7, 100, 2000):
        got = sorted((r["ord"], r["x"], r["b"]) for r in ply.read_points(spark, f"{tmp_path}/p.ply", stride_).collect())
        assert got == [(i, float(i), i % 200) for i in range(0, 1003, stride_)]


def test_headers_of_any_length(spark, tmp_path, monkeypatch):
    rows = np.zeros(10, ply.RECORD)
    rows["x"] = np.arange(10)
    ply.write_points(f"{tmp_path}/p.ply", rows)
    raw = open(f"{tmp_path}/p.ply", "rb").read()
    with open(f"{tmp_path}/long.ply", "wb") as f:
        f.write(raw.replace(b"element vertex", b"comment " + b"x" * 300_000 + b"\nelement vertex"))
    for bound in (ply.HEAD, 7):
        monkeypatch.setattr(ply, "HEAD", bound)
        assert sorted(r["x"] for r in ply.read_points(spark, f"{tmp_path}/long.ply").collect()) == list(range(10))


def read_mesh(path):
    raw = open(path, "rb").read()
    head, body = raw.split(b"end_header\n", 1)
    n, m = (int(x.split()[-1]) for x in head.decode().split("\n") if x.startswith("element"))
    v = np.frombuffer(body, [("p", "<f4", 3), ("c", "u1", 3)], n)
    t = np.frombuffer(body, [("n", "u1"), ("i", "<i4", 3)], m, n * 15)
    assert len(body) == 15 * n + 13 * m and (t["n"] == 3).all()
    return v, t["i"]


def test_job_writes_meshes_blocks_and_metrics(spark, tmp_path):
    def cloud(x0, x1, step):
        x, y = np.meshgrid(np.arange(x0, x1, step), np.arange(0, 1.6, step))
        rows = np.zeros(x.size, ply.RECORD)
        rows["x"], rows["y"], rows["r"], rows["nz"] = x.ravel(), y.ravel(), 120, 1
        return rows

    for k in range(2):
        ply.write_points(f"{tmp_path}/r{k}_refined.ply", cloud(k * 2, k * 2 + 2, 0.05))
        ply.write_points(f"{tmp_path}/r{k}_preview_new.ply", cloud(k * 2, k * 2 + 2, 0.1))
    out = f"{tmp_path}/out"
    job.main(["--data", str(tmp_path), "--out", out, "--order", "realistic", "--block-dim", "8", "--far", "400"])
    metrics = spark.read.option("header", True).csv(f"{out}/metrics", inferSchema=True).orderBy("step").collect()
    assert [(r["segments"], r["levels"]) for r in metrics] == [("0", "preview"), ("0 1", "refined preview"), ("1", "refined")]
    assert [r["replaced_preview"] for r in metrics] == [False, True, True] and all(r["far_fraction"] == 0 for r in metrics)
    assert metrics[1]["input_points"] == 40 * 32 + 20 * 16
    m = SurfaceMesher(spark, f"{out}/state", CFG)
    rows = blocks(m.meshes())
    v, t = read_mesh(f"{out}/mesh.ply")
    assert len(t) == m.total_tris() == metrics[-1]["triangles"]
    assert len({tuple(p) for p in v["p"].tolist()}) == len(v)
    corner = lambda p, i: tuple(np.float32(np.array(p[3 * i : 3 * i + 3]) / 1e6))
    want = sorted(tuple(corner(p, i) for i in idx[k : k + 3]) for p, _, idx in rows.values() for k in range(0, len(idx), 3))
    assert sorted(tuple(tuple(v["p"][i]) for i in f) for f in t) == want
    for (x, y, z), (p, c, idx) in rows.items():
        raw = open(f"{out}/blocks/block_{x}_{y}_{z}.slmb", "rb").read()
        assert raw == ply.block_bytes((x, y, z), m.version((x, y, z)), np.array(p) / 1e6, c, idx)


def walls(spark):
    """A floor with a box on it: its sides stand upright, and their normals have no sign yet."""
    rows = []
    for u in range(0, 1600, 50):
        for w in range(0, 1600, 50):
            rows += [(u - 1600, w, 0), (u, w, 800)]
            if w < 800:
                rows += [(0, u, w), (1600, u, w), (u, 0, w), (u, 1600, w)]
    return spark.createDataFrame([(0, 1, *p, 0, 0, 0, 10, 20, 30) for p in rows], POINT)


def test_signs_spread_as_in_a_single_heap(spark):
    """Propagation against Prim's algorithm over all bins at once, with one heap and no components."""
    b = cut(normals.estimate(binning.bins(walls(spark), CFG), CFG))
    got = {(r["kx"], r["ky"], r["kz"]): (r["nx"], r["ny"], r["nz"]) for r in orient.orient(b, cut, cfg=CFG).collect()}
    rows = {(r["kx"], r["ky"], r["kz"]): r for r in b.collect()}
    unit = {k: np.array([r["nx"], r["ny"], r["nz"]]) / 1e6 for k, r in rows.items()}
    at = {k: np.array([r["px"], r["py"], r["pz"]], float) for k, r in rows.items()}
    need = {k for k in rows if abs(unit[k][2]) < CFG.seed_nz}
    assert len(need) > 400 and len(rows) - len(need) > 400

    def agreement(s, t):
        e, v = at[t] - at[s], float(unit[s] @ unit[t])
        if abs(v) < CFG.crease and e @ e > 0:
            v -= 2 * float(unit[s] @ e) * float(unit[t] @ e) / float(e @ e)
        return round(v, 6)

    steps = [d for d in itertools.product(range(-2, 3), repeat=3) if any(d)]
    near = {k: [t for d in steps if (t := (k[0] + d[0], k[1] + d[1], k[2] + d[2])) in rows] for k in need}
    sign, heap = {}, []
    for k in sorted(need):
        seeds = [(-min(abs(agreement(k, t)), 1.0), t) for t in near[k] if t not in need]
        if seeds:
            cost, t = min(seeds)
            heap.append((cost, k, agreement(k, t) < 0))
    heapq.heapify(heap)
    while len(sign) < len(need):
        if not heap:
            left = {k for k in need if k not in sign}
            root = max(left, key=lambda k: (abs(rows[k]["nz"]), tuple(-x for x in k)))
            heap.append((-2.0, root, rows[root]["nz"] < 0))
        _, k, f = heapq.heappop(heap)
        if k not in sign:
            sign[k] = f
            for t in near[k]:
                if t in need and t not in sign:
                    v = agreement(k, t)
                    heapq.heappush(heap, (-min(abs(v), 1.0), t, v > 0 if f else v < 0))
    for k, r in rows.items():
        turn = -1 if sign.get(k) else 1
        assert got[k] == tuple(turn * r[c] for c in ("nx", "ny", "nz")), k


def kruskal(links, seeds, nodes):
    """{node: (top, odd)}: -1 and the sign against the seeds, or a member of the tree and the sign against it; links (lo, hi, cost, odd)."""
    to = {n: (n, False) for n in (*nodes, -1)}

    def root(n):
        odd = False
        while to[n][0] != n:
            n, o = to[n]
            odd ^= o
        return n, odd

    for _, lo, hi, odd in sorted([(c, lo, hi, odd) for lo, hi, c, odd in links] + [(c, -1, a, odd) for a, c, odd in seeds]):
        (x, ox), (y, oy) = root(lo), root(hi)
        if x != y:
            x, y = min(x, y), max(x, y)
            to[y] = (x, ox ^ oy ^ odd)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_spanning_signs_equal_kruskal(spark, seed):
    """Ties, cycles of odd sign, trees without a seed, a long chain, a node with many links."""
    rng = np.random.default_rng(seed)
    n = 240
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 120, (260, 2)).tolist() if a != b} | {(a, a + 1) for a in range(120, 179)} | {(180, a) for a in range(181, 210)} | {(a, a + 1) for a in range(211, 239, 2)}
    links = [(a, b, -float(rng.choice([0.25, 0.5, 1.0])) if a < 120 or a >= 180 else -1 + a / 1000, bool(rng.random() < 0.4)) for a, b in sorted(pairs)]
    seeds = [(a, -float(rng.choice([0.5, 1.0])), bool(rng.random() < 0.5)) for a in ([3, 50, 51, 150, 180], [], [7])[seed]]
    both = [(*(e if turn else e[::-1]), c, *e, odd) for *e, c, odd in links for turn in (True, False)]
    with Scratch(spark) as scratch:
        rows = orient.spanning_signs(spark.createDataFrame(both, "a long, b long, cost double, lo long, hi long, odd boolean"), spark.createDataFrame([(a, c, -1, a, odd) for a, c, odd in seeds], "a long, cost double, lo long, hi long, odd boolean"), scratch.keep).collect()
    got, want = {r["a"]: (r["top"], r["odd"]) for r in rows}, kruskal(links, seeds, range(n))
    assert set(got) == {x for e in pairs for x in e} | {a for a, *_ in seeds}
    for a, (top, odd) in got.items():
        if want[a][0] == -1:
            assert (top, odd) == want[a]
        else:  # the same tree, and signs agree against its top
            assert top != -1 and want[top][0] == want[a][0] and odd == want[a][1] ^ want[top][1]


def test_propagated_normals_query_equals_kruskal(spark):
    d = "/root/testdata/sf0.001"
    b = cut(queries._oriented(spark, d).withColumn("fixed", F.col("fixed") & (F.col("kx") % 5 == 0)).withColumn("nz", F.least("nz", F.lit(699_999).cast("long"))))
    got = {tuple(r[c] for c in binning.KEY): tuple(r[c] for c in ("nx", "ny", "nz")) for r in queries.q_propagated_normals(spark, d).collect()}
    rows = {tuple(r[c] for c in binning.KEY): r for r in b.collect()}
    need = sorted(k for k, r in rows.items() if not r["fixed"])
    ident = {k: i for i, k in enumerate(need)}
    links, best = [], {}
    for r in orient.edges(b, queries.CFG).where("v <> 0").collect():
        s, t = ((r["seg"], r["level"], *(r[f"{e}k{x}"] for x in "xyz")) for e in "st")
        cost = -min(abs(r["v"]), 1.0)
        if t not in ident:
            best[s] = min(best.get(s, (1.0,)), (cost, t, r["v"] < 0))
        elif s < t:
            links.append((ident[s], ident[t], cost, r["v"] < 0))
    found = kruskal(links, [(ident[s], c, odd) for s, (c, _, odd) in best.items()], range(len(need)))
    trees = {}
    for k in need:
        top, odd = found[ident[k]]
        if top != -1:
            trees[top] = max(trees.get(top, ((-1,), False)), ((abs(rows[k]["nz"]), -ident[k]), (rows[k]["nz"] < 0) ^ odd))
    for k, r in rows.items():
        flip = False
        if k in ident:
            top, odd = found[ident[k]]
            flip = odd ^ (top != -1 and trees[top][1])
        assert got[k] == tuple((-1 if flip else 1) * r[c] for c in ("nx", "ny", "nz")), k
    assert sum(found[i][0] != -1 for i in found) > 0 or len(best) > 100


def test_box_sides_face_outwards(spark):
    b = cut(normals.estimate(binning.bins(walls(spark), CFG), CFG))
    out = 0
    for r in orient.orient(b, cut, cfg=CFG).collect():
        if r["kz"] in (3, 4) and 3 <= r["ky"] <= 12 and r["kx"] in (0, 16) and abs(r["nx"]) > 900_000:
            assert (r["nx"] > 0) == (r["kx"] == 16)
            out += 1
    assert out > 10


def test_components_equal_union_find(spark):
    b = cut(normals.estimate(binning.bins(walls(spark).unionByName(plane(spark, 9000, 9500, 0, 500, 0)), CFG), CFG).withColumn("nz", F.lit(0).cast("long")).withColumn("fixed", F.lit(False)))
    got = {(r["kx"], r["ky"], r["kz"]): (r["cx"], r["cy"], r["cz"]) for r in orient.components(cut(orient.edges(b, CFG)), b, cut).collect()}
    to = {k: k for k in got}

    def root(k):
        while to[k] != k:
            k = to[k]
        return k

    for k in got:
        for d in itertools.product(range(-2, 3), repeat=3):
            t = (k[0] + d[0], k[1] + d[1], k[2] + d[2])
            if t in to and root(t) != root(k):
                x, y = sorted((root(t), root(k)))
                to[y] = x
    assert got == {k: root(k) for k in got} and len(set(got.values())) > 1


def test_moments_far_from_the_origin(spark):
    far = 4_000_000_000
    near, away = (cut(normals.estimate(binning.bins(walls(spark).withColumns({a: F.col(a) + d for a, d in (("x", s), ("y", s))}), CFG), CFG)) for s in (0, far))
    rows = lambda d, s: sorted((r["kx"] - s // 100, r["ky"] - s // 100, r["kz"], r["nx"], r["ny"], r["nz"]) for r in d.collect())
    assert rows(near, 0) == rows(away, far)


def test_ranks_are_dense_in_each_group(spark):
    """A group over many ranges, small groups, a null one, and an empty table; without groups, too."""
    keys = [("big", i * 7919 % 3001) for i in range(3001)] + [(None, i) for i in range(5)] + [(f"s{i}", 0) for i in range(20)]
    rows = spark.createDataFrame(keys, "g string, k long").repartition(6)
    got = ranked(rows, ["g"], ["k"], cut).collect()
    assert len(got) == len(keys) and all(r["idx"] == r["k"] for r in got)
    every = ranked(rows, [], ["g", "k"], cut, "n").orderBy(F.col("g").asc_nulls_first(), "k").collect()
    assert [r["n"] for r in every] == list(range(len(keys)))
    assert ranked(rows.where("false"), ["g"], ["k"], cut).count() == 0
