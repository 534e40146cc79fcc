"""Runs a mesher over the steps of a data set and writes what it finds: meshes, block files, metrics.

    python -m pointweave.plans.job --data FOLDER --out FOLDER [--layout segments|chunks] [--mesher surface|height] ..
"""

from __future__ import annotations

import argparse
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import bins as binning
from ..operators import mesh
from ..sources import ply
from ..sources import points as point_files
from .lineage import cut
from .mesher import HeightMesher, Mesher, SurfaceMesher


def run(mesher: Mesher, points: DataFrame, steps: list[list[tuple[int, int]]], out: str, blocks: bool = True, whole: bool = True, distance: int = 0) -> DataFrame:
    """One row of metrics a step, also appended to out/metrics. points: as for ingest, with seg and level.

    blocks: block files of what changed, in out/blocks; whole: the welded mesh, out/mesh.ply, after the last step; distance: the
    share of vertices with no point of the arrivals so far within so many millimetres.
    """
    spark, rows, seen = points.sparkSession, [], []
    for number, arrivals in enumerate(steps, 1):
        began, stats = time.time(), []
        for seg, level in arrivals:
            stats.append(mesher.ingest(seg, level, points.where((F.col("seg") == seg) & (F.col("level") == level))))
        ingested = time.time()
        changed = mesher.extract()
        seen += arrivals
        row = {"step": number, "segments": " ".join(str(s) for s, _ in arrivals), "levels": " ".join(("preview", "refined")[level] for _, level in arrivals)}
        row |= {k: sum(getattr(s, k) for s in stats) for k in ("input_points", "bins", "normals_estimated", "bins_dropped")}
        row |= {"replaced_preview": any(s.removed_preview for s in stats), "ingest_ms": round((ingested - began) * 1000), "extract_ms": round((time.time() - ingested) * 1000)}
        row |= asdict(mesher.extract_stats())
        totals = mesh.statistics(mesher.meshes()).first()
        row |= {"blocks": totals["blocks"], "triangles": totals["triangles"], "mesh_bytes": totals["bytes"], "field_bytes": mesher.field_bytes(), "far_fraction": None}
        if distance:
            live = [(s, level) for s, level in seen if level or (s, 1) not in seen]
            near = points.join(spark.createDataFrame(live, "seg int, level int"), ["seg", "level"], "left_semi")
            verts = mesh.exploded(mesher.meshes()).select(*(F.round(F.col(a) / 1000.0).cast("long").alias(a) for a in "xyz")).distinct()
            row["far_fraction"] = mesh.far_fraction(cut(verts), near, distance).first()["fraction"]
        if blocks:
            ply.write_blocks(changed, f"{out}/blocks")
        schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if k == 'far_fraction' else 'long'}" for k, v in row.items())
        one = spark.createDataFrame([tuple(row.values())], schema)
        ply.write_metrics(one.coalesce(1), f"{out}/metrics")
        rows.append(one)
    if whole and steps:
        ply.write_mesh(mesher.meshes(), f"{out}/mesh.ply", cut)
    table = rows[0] if rows else spark.createDataFrame([], "step long")
    for r in rows[1:]:
        table = table.unionByName(r)
    return table


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Meshes a folder of point files step by step.")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--layout", choices=["segments", "chunks"], default="segments")
    p.add_argument("--mesher", choices=["surface", "height"], default="surface")
    p.add_argument("--order", choices=["pr", "realistic"], default="pr")
    p.add_argument("--limit", type=int, default=0, help="segments, 0 for all")
    p.add_argument("--orientation", choices=["propagate", "up"], default="propagate")
    p.add_argument("--far", type=int, default=0, help="distance of the far fraction in millimetres, 0 for none")
    p.add_argument("--no-blocks", action="store_true")
    p.add_argument("--no-mesh", action="store_true")
    d = Config()
    for name in ("voxel", "block_dim", "bin", "splat_radius", "min_weight", "simplify_error"):
        p.add_argument(f"--{name.replace('_', '-')}", type=type(getattr(d, name)), default=getattr(d, name))
    a = p.parse_args(arguments)
    cfg = Config(voxel=a.voxel, block_dim=a.block_dim, bin=a.bin, splat_radius=a.splat_radius, min_weight=a.min_weight, simplify_error=a.simplify_error)
    # a step's filter on seg and level reaches the source, so each file is opened by its own step only
    spark = SparkSession.builder.config(point_files.PUSHDOWN, "true").getOrCreate()
    points = binning.quantise(point_files.read(spark, a.data, a.layout))
    segs = sorted({f.seg for f in point_files.LAYOUTS[a.layout](a.data)})
    segs = segs[: a.limit] if a.limit else segs
    mesher = SurfaceMesher(spark, f"{a.out}/state", cfg, a.orientation) if a.mesher == "surface" else HeightMesher(spark, f"{a.out}/state", cfg)
    run(mesher, points, ply.steps(segs, a.order), a.out, not a.no_blocks, not a.no_mesh, a.far).show(1000, False)


if __name__ == "__main__":
    main()
