"""The engine's operators as queries over the driver's tables, and the same in DuckDB SQL (oracles.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import REFINED, Config
from ..functions.columns import finite, valid_normal
from ..operators import bins as binning
from ..operators import field as fields
from ..operators import height, incremental, mesh, normals, orient, surface
from ..operators.rank import ranked
from .lineage import cut, shared_folder
from .points import point_view, stride, synthetic_preview

CFG = Config(block_dim=8)


def _bins(spark: SparkSession, d: str, trust: str = "level") -> DataFrame:
    return binning.bins(point_view(spark, d), CFG, trust)


def _oriented(spark: SparkSession, d: str) -> DataFrame:
    """Bins with estimated normals, upwards. They are written once: later steps use the normals many times over."""
    return cut(normals.estimate(_bins(spark, d), CFG))


def _field(spark: SparkSession, d: str) -> DataFrame:
    return fields.field(_oriented(spark, d), CFG)


def _seen(rows: DataFrame) -> DataFrame:
    return fields.observed(fields.layer_sum(rows), CFG)


def _quads(rows: DataFrame) -> DataFrame:
    seen = cut(_seen(rows))
    return surface.quads(seen, surface.vertices(seen, CFG), CFG)


def q_point_view(spark, d):
    return point_view(spark, d, order=True)


def q_finite_filter(spark, d):
    p = point_view(spark, d).withColumn("fx", F.when(F.col("x") % 7 == 0, F.lit(float("nan"))).when(F.col("x") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("x") / 1000.0))
    return p.where(finite("fx")).groupBy("seg", "level").agg(F.count("*").alias("n"), F.sum("x").alias("sx"))


def q_stride_sample(spark, d):
    return stride(point_view(spark, d, order=True), 4)


def q_synthetic_preview(spark, d):
    return synthetic_preview(point_view(spark, d, order=True).where(F.col("level") == REFINED))


def q_valid_normals(spark, d):
    return point_view(spark, d).where(valid_normal("nx", "ny", "nz", 1000)).groupBy("seg", "level").agg(F.count("*").alias("n"), F.sum("nx").alias("snx"))


def q_segment_limit(spark, d):
    return point_view(spark, d).where("seg < 2").groupBy("seg", "level").agg(F.count("*").alias("n"))


def q_bin_aggregate(spark, d):
    return binning.aggregate(point_view(spark, d), CFG)


def q_bin_trusted_normals(spark, d):
    return _bins(spark, d)


def q_bin_rank(spark, d):
    keys = binning.aggregate(point_view(spark, d), CFG).select(*binning.KEY)
    return ranked(keys, ["seg", "level"], ["kx", "ky", "kz"], cut).withColumn("idx", F.col("idx").cast("int"))


def q_neighbor_moments(spark, d):
    return normals.moments(_bins(spark, d), CFG).select(*binning.KEY, "m", *(f"m{k}" for k in normals.MOMENTS))


def q_bins_dropped(spark, d):
    m = normals.moments(_bins(spark, d), CFG)
    estimated = ~F.col("fixed") & (F.col("m") >= CFG.normal_min_neighbors)
    dropped = ~F.col("fixed") & (F.col("m") < CFG.normal_min_neighbors)
    return m.groupBy("seg", "level").agg(F.sum(estimated.cast("long")).alias("estimated"), F.sum(dropped.cast("long")).alias("dropped"))


def q_plane_normals(spark, d):
    b = _oriented(spark, d).where(~F.col("fixed"))
    return b.select(*binning.KEY, *(F.round(F.col(f"n{a}") / 1000.0).cast("long").alias(f"n{a}") for a in "xyz"))


def q_voxel_range(spark, d):
    rows = fields.contributions(_oriented(spark, d), CFG)
    return rows.groupBy("layer").agg(F.count("*").alias("rows"), *(f(f"g{a}").alias(f"g{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))))


def q_voxel_field(spark, d):
    return _field(spark, d)


def q_layer_sum(spark, d):
    return fields.layer_sum(_field(spark, d))


def q_retract_layer(spark, d):
    return fields.layer_sum(fields.drop_layer(_field(spark, d), 1))


def q_preview_replaced_field(spark, d):
    return fields.layer_sum(fields.field(fields.replace_previews(_oriented(spark, d)), CFG))


def q_block_lists(spark, d):
    b = _oriented(spark, d)
    for a in "xyz":
        lo = F.floor(F.ceil((F.col(f"p{a}") - CFG.splat_radius) / float(CFG.voxel)) / float(CFG.block_dim))
        hi = F.floor(F.floor((F.col(f"p{a}") + CFG.splat_radius) / float(CFG.voxel)) / float(CFG.block_dim))
        b = b.withColumn(f"b{a}", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*binning.KEY))), lambda k: F.concat_ws(",", *(k[c] for c in binning.KEY)))
    return b.groupBy("bx", "by", "bz").agg(F.count("*").alias("bins"), F.md5(F.concat_ws(";", listed)).alias("list"))


def q_height_cells(spark, d):
    return height.cells(_bins(spark, d, "never"), CFG)


def _height(spark, d):
    return height.quads(height.surface(height.cells(_bins(spark, d, "never"), CFG), CFG), CFG)


def q_height_quads(spark, d):
    z = ("z00", "z10", "z11", "z01")
    return _height(spark, d).select("cx", "cy", *(F.round(F.col(c) * 1000).cast("long").alias(c) for c in z))


def q_height_triangles(spark, d):
    t = height.triangles(_height(spark, d), CFG)
    flat = [F.round(F.col(f"v{i}.{a}") * 1000).cast("long").alias(f"{a}{i}") for i in range(3) for a in "xyz"]
    return t.select("bx", "by", "ord", *flat)


def q_height_meshes(spark, d):
    """Vertices, triangles and content of every tile's mesh, colours included."""
    m = surface.meshes(height.faces(height.surface(height.cells(_bins(spark, d, "never"), CFG), CFG), CFG))
    content = F.md5(F.concat_ws(";", *(F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in ("positions", "colors", "indices"))))
    return m.select("bx", "by", "bz", (F.size("positions") / 3).cast("long").alias("vertices"), (F.size("indices") / 3).cast("long").alias("triangles"), content.alias("digest"))


def q_cell_vertices(spark, d):
    return surface.vertices(_seen(_field(spark, d)), CFG)


def q_sign_edges(spark, d):
    return surface.sign_edges(_seen(_field(spark, d)))


def q_quads(spark, d):
    q = _quads(_field(spark, d))
    return q.select("bx", "by", "bz", "gx", "gy", "gz", "axis", *(F.col(f"q{k}.c{a}").alias(f"q{k}{a}") for k in range(4) for a in "xyz"))


def q_block_vertices(spark, d):
    return surface.block_vertices(_quads(_field(spark, d)))


def q_seam_vertices(spark, d):
    return surface.seam(surface.block_vertices(_quads(_field(spark, d))), CFG).select("bx", "by", "bz", "cx", "cy", "cz", "x", "y", "z")


def q_block_mesh_stats(spark, d):
    m = surface.meshes(_quads(_field(spark, d)))
    return m.select("bx", "by", "bz", (F.size("positions") / 3).cast("long").alias("vertices"), (F.size("indices") / 3).cast("long").alias("triangles"))


def q_mesh_statistics(spark, d):
    return mesh.statistics(surface.meshes(_quads(_field(spark, d))))


def q_block_digests(spark, d):
    return incremental.digests(surface.meshes(_quads(_field(spark, d))))


def q_dirty_blocks(spark, d):
    """What the arrival of segment 1, refined, marks: its preview's voxels and its own."""
    rows = _oriented(spark, d).where("seg = 1")
    preview = incremental.halo(fields.field(rows.where("level = 0"), CFG), CFG)
    return incremental.marked(preview, incremental.halo(fields.field(rows.where("level = 1"), CFG), CFG))


def q_halo_mask(spark, d):
    return incremental.halo(_field(spark, d).select("gx", "gy", "gz"), CFG, upper_only=True)


def _states(spark, d):
    b = cut(_oriented(spark, d))
    before = b.where("level = 0 or seg = 0")
    before = before.where(~((F.col("seg") == 0) & (F.col("level") == 0)))
    after = before.where(~((F.col("seg") == 1) & (F.col("level") == 0))).unionByName(b.where("seg = 1 and level = 1"))
    return b, before, after


def q_changed_blocks(spark, d):
    """Blocks that the refined segment 1 changes after segment 0 was refined; all other segments are previews."""
    _, before, after = _states(spark, d)
    old = cut(incremental.digests(surface.meshes(_quads(fields.field(before, CFG)))))
    new = cut(incremental.digests(surface.meshes(_quads(fields.field(after, CFG)))))
    state = old.withColumn("version", F.lit(1).cast("long"))
    every = old.select("bx", "by", "bz").union(new.select("bx", "by", "bz")).distinct()
    return incremental.apply(state, new, every).where("changed").select("bx", "by", "bz", "version", F.col("digest").isNull().alias("gone"))


def q_extract_stats(spark, d):
    b, before, after = _states(spark, d)
    old = cut(incremental.digests(surface.meshes(_quads(fields.field(before, CFG)))))
    new = cut(incremental.digests(surface.meshes(_quads(fields.field(after, CFG)))))
    dirty = incremental.marked(*(incremental.halo(fields.field(b.where(f"seg = 1 and level = {k}"), CFG), CFG) for k in (0, 1)))
    return incremental.extract_stats(dirty, old, new)


def q_segment_admission(spark, d):
    p = point_view(spark, d).select("seg", "level").distinct()
    accepted, rejected = incremental.admitted(p, p.where("level = 1 and seg < 2").select("seg"))
    return accepted.select("seg", "level", F.lit("accepted").alias("reason")).unionByName(rejected.select("seg", "level", "reason"))


def _tilted(spark, d):
    """The sheet lies flat, where all normals are decided: four columns of five are made undecided."""
    tilt = F.col("kx") % 5 != 0
    b = _oriented(spark, d).withColumn("nz", F.when(tilt, F.least("nz", F.lit(699_999).cast("long"))).otherwise(F.col("nz")))
    return cut(b.withColumn("fixed", F.col("fixed") & ~tilt))


def q_neighbor_edges(spark, d):
    return orient.edges(_tilted(spark, d), CFG).withColumn("v", F.round(F.col("v") * 1000).cast("long"))


def q_best_seed_edge(spark, d):
    s = orient.seed_edges(cut(orient.edges(_tilted(spark, d), CFG)))
    return s.withColumn("v", F.round(F.col("v") * 1000000).cast("long"))


def q_base_agreement(spark, d):
    b = cut(_oriented(spark, d))
    a = orient.base_agreement(b.where("level = 0"), fields.field(b.where("level = 1"), CFG), CFG)
    return a.withColumn("a", F.round(F.col("a") * 1000).cast("long"))


def q_oracle_signs(spark, d):
    b = cut(_oriented(spark, d))
    field = fields.field(b.where("level = 1"), CFG)
    out = orient.apply_oracle(b.where("level = 0"), orient.base_agreement(b.where("level = 0"), field, CFG), CFG)
    return out.groupBy("seg").agg(F.count("*").alias("bins"), F.sum(F.col("fixed").cast("long")).alias("fixed"), F.sum((F.col("nz") < 0).cast("long")).alias("down"))


def q_components(spark, d):
    """All bins are made undecided, so that a segment's sheet is a component, apart from what stands alone."""
    b = cut(_oriented(spark, d).withColumn("fixed", F.lit(False)).withColumn("nz", F.least("nz", F.lit(699_999).cast("long"))))
    return orient.components(cut(orient.edges(b, CFG)), b, cut)


def q_propagated_normals(spark, d):
    b = cut(_oriented(spark, d).withColumn("fixed", F.col("fixed") & (F.col("kx") % 5 == 0)).withColumn("nz", F.least("nz", F.lit(699_999).cast("long"))))
    return orient.orient(b, cut, cfg=CFG).select(*binning.KEY, "nx", "ny", "nz")


def _vertices_mm(spark, d):
    v = surface.block_vertices(cut(_quads(_field(spark, d))))
    return v.select(*(F.round(F.col(a) / 1000.0).cast("long").alias(a) for a in "xyz"))


def q_weld_counts(spark, d):
    v = surface.block_vertices(cut(_quads(_field(spark, d))))
    w = mesh.weld(v)
    return w.agg(F.count("*").alias("welded"), F.sum("uses").alias("vertices"), F.sum("r").alias("r"))


def q_weld_vertices(spark, d):
    return mesh.weld(surface.block_vertices(cut(_quads(_field(spark, d)))))


def q_far_fraction(spark, d):
    """The field holds every arrival, previews too, so a vertex is far if no point of any of them is near."""
    out = mesh.far_fraction(cut(_vertices_mm(spark, d).distinct()), point_view(spark, d), 100)
    return out.select("vertices", "far", F.round("fraction", 6).alias("fraction"))


def q_simplified_stats(spark, d):
    found = cut(_quads(_field(spark, d)))
    m = surface.meshes(found)
    seams = surface.seam(surface.block_vertices(found), CFG).select("bx", "by", "bz", "idx")
    small = mesh.simplify(m, seams, 20.0)
    return small.select("bx", "by", "bz", (F.size("positions") / 3).cast("long").alias("vertices"), (F.size("indices") / 3).cast("long").alias("triangles"))


def _streamed(spark, d):
    """The mesher after all six arrivals came as a stream, with an extract after each batch; and its changes by batch.

    Each arrival comes in two halves, and half of them in two batches. A batch's files are written by as many tasks as read the table,
    and the stream goes on with them.
    """
    import uuid

    from ..streaming.replay import replay
    from .mesher import SurfaceMesher

    at = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    p = point_view(spark, d)
    a, b, c, d, e, f = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (2, 1)]
    batches = [[(a, 0), (a, 1), (b, 0), (c, 0)], [(b, 1), (c, 1), (d, 0), (e, 0)], [(d, 1), (e, 1), (f, 0), (f, 1)]]
    halves = spark.createDataFrame([(*arrival, half, n) for n, batch in enumerate(batches) for arrival, half in batch], "seg int, level int, half long, batch int")
    halves = cut(p.groupBy("seg", "level").agg(F.count("*").alias("total")).join(halves, ["seg", "level"]))  # a row a half
    p = p.withColumn("half", F.pmod(F.xxhash64("x", "y", "z"), F.lit(2)))
    mesher, changes = SurfaceMesher(spark, f"{at}/state", CFG), []
    for n in range(len(batches)):
        p.join(F.broadcast(halves.where(F.col("batch") == n)), ["seg", "level", "half"]).drop("half", "batch").write.parquet(f"{at}/in/{n}")
        replay(spark, f"{at}/in/*", mesher, f"{at}/checkpoint", lambda n, c: changes.append(cut(incremental.digests(c.where("positions is not null")).join(c.select("bx", "by", "bz", "version"), incremental.BLOCK, "right"))), files_per_batch=None, ends=n == len(batches) - 1)
    return mesher, changes


def q_stream_replay_final_field(spark, d):
    """Streams previews and refined segments through the state tables; the field that is left equals the batch one."""
    return fields.layer_sum(_streamed(spark, d)[0].field())


def q_stream_replay_meshes(spark, d):
    """What a consumer holds that applied the changes of every batch in turn: each block's last change, if it has a mesh."""
    changes = _streamed(spark, d)[1]
    every = changes[0]
    for c in changes[1:]:
        every = every.unionByName(c)
    last = every.groupBy("bx", "by", "bz").agg(F.max_by("digest", "version").alias("digest"), F.max_by(F.col("digest").isNull(), "version").alias("gone"))
    return last.where(~F.col("gone")).drop("gone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
