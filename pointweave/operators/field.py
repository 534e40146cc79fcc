"""The signed-distance field: bins splat weighted distances on the voxels around them, layer by layer.

A layer is the base (all refined segments) or one pending preview. Sums are whole numbers, so that any partitioning and any
order of segments give the same field, and dropping a layer restores the field exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BASE, REFINED, WEIGHT_ONE, Config
from ..functions.columns import first_and_last

SUMS = ["wd", "w", "wr", "wg", "wb"]


def contributions(bins: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A row per bin and voxel within the splat radius: w = exp(-q / 2 s^2), s half the radius, and w times distance and colour."""
    axes = {}
    for g, p in (("gx", "px"), ("gy", "py"), ("gz", "pz")):
        lo, hi = first_and_last(F.col(p), cfg.splat_radius, cfg.voxel)
        axes[g] = F.explode(F.sequence(lo, hi))
    out = bins.withColumn("layer", F.when(F.col("level") == REFINED, F.lit(BASE)).otherwise(F.col("seg")))
    for g, e in axes.items():
        out = out.withColumn(g, e)
    d = {k: F.col(f"g{k}") * cfg.voxel - F.col(f"p{k}") for k in "xyz"}
    out = out.withColumn("q", d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]).where(F.col("q") <= cfg.splat_radius**2)
    s2 = 2 * (cfg.splat_radius / 2) ** 2
    w = F.round(F.exp(-F.col("q") / F.lit(s2)) * WEIGHT_ONE).cast("long")
    away = F.round((F.col("nx") * d["x"] + F.col("ny") * d["y"] + F.col("nz") * d["z"]) / 1000.0).cast("long")  # thousandths of a mm
    out = out.withColumns({"w": w, "d": away})
    return out.select("layer", "gx", "gy", "gz", (F.col("w") * F.col("d")).alias("wd"), "w", *((F.col("w") * F.col(c)).alias(f"w{c}") for c in "rgb"))


def accumulate(rows: DataFrame) -> DataFrame:
    """Sums per (layer, voxel); also merges fields."""
    return rows.groupBy("layer", "gx", "gy", "gz").agg(*(F.sum(c).alias(c) for c in SUMS))


def field(bins: DataFrame, cfg: Config = Config()) -> DataFrame:
    return accumulate(contributions(bins, cfg))


def layer_sum(rows: DataFrame) -> DataFrame:
    """Per voxel, the base and all pending previews together."""
    return rows.groupBy("gx", "gy", "gz").agg(*(F.sum(c).alias(c) for c in SUMS))


def drop_layer(rows: DataFrame, seg: int) -> DataFrame:
    return rows.where(F.col("layer") != seg)


def observed(summed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Voxels of enough weight, with distance d (thousandths of a millimetre)."""
    return summed.where(F.col("w") >= cfg.min_weight_units).withColumn("d", F.col("wd") / F.col("w"))


def replace_previews(bins: DataFrame) -> DataFrame:
    """The bins that count once every arrival is in: a segment's refined bins if it has any, else its preview."""
    refined = bins.where(F.col("level") == REFINED).select("seg").distinct()
    preview = bins.where(F.col("level") != REFINED).join(refined, "seg", "left_anti")
    return bins.where(F.col("level") == REFINED).unionByName(preview.select(*bins.columns))
