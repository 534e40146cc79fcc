"""The 2.5-D surface: one height per cell, a quad where four neighbouring cells are seen and close in height."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BASE, REFINED, Config
from ..functions.columns import cell


def cells(bins: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per (layer, cx, cy): sum of bin heights, number of bins, sums of colours; a bin counts once, whatever its points."""
    at = bins.withColumns({"layer": F.when(F.col("level") == REFINED, F.lit(BASE)).otherwise(F.col("seg")), "cx": cell(F.col("px"), cfg.voxel), "cy": cell(F.col("py"), cfg.voxel)})
    return at.groupBy("layer", "cx", "cy").agg(F.sum("pz").alias("wz"), F.count("*").alias("w"), *(F.sum(c).alias(f"w{c}") for c in "rgb"))


def surface(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Cells of all layers together with their height z (millimetres)."""
    total = rows.groupBy("cx", "cy").agg(*(F.sum(c).alias(c) for c in ("wz", "w", "wr", "wg", "wb")))
    return total.where(F.col("w") >= cfg.min_weight).withColumn("z", F.col("wz") / F.col("w"))


def quads(seen: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(cx, cy, z00, z10, z11, z01) of quads over cells (cx, cy) .. (cx + 1, cy + 1): heights within twice the radius.

    Each cell goes to the up to four quads it is a corner of, so that one grouping replaces three self-joins.
    """
    corners = F.array(*(F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx in (0, 1) for dy in (0, 1)))
    to = seen.select("cx", "cy", "z", F.explode(corners).alias("o")).select((F.col("cx") - F.col("o.dx")).alias("cx"), (F.col("cy") - F.col("o.dy")).alias("cy"), (F.col("o.dx") * 2 + F.col("o.dy")).alias("k"), "z")
    pick = [F.max(F.when(F.col("k") == k, F.col("z"))).alias(n) for k, n in ((0, "z00"), (2, "z10"), (3, "z11"), (1, "z01"))]
    full = to.groupBy("cx", "cy").agg(F.count("*").alias("n"), *pick).where("n = 4").drop("n")
    z = ("z00", "z10", "z11", "z01")
    return full.where(F.greatest(*z) - F.least(*z) <= 2 * cfg.splat_radius)


def faces(seen: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The quads with tile (bx, by, 0) and corners q0..q3 in the form of surface.quads: vertices at cell centres, mean colours."""
    half = cfg.voxel * 500
    centre = {a: (F.col(f"c{a}") * (cfg.voxel * 1000) + half).cast("long") for a in "xy"}
    colour = {c: F.least(F.greatest(F.round(F.col(f"w{c}") / F.col("w")), F.lit(0.0)), F.lit(255.0)).cast("int") for c in "rgb"}
    named = seen.select("cx", "cy", F.lit(0).cast("long").alias("cz"), centre["x"].alias("x"), centre["y"].alias("y"), F.col("z").alias("h"), F.round(F.col("z") * 1000).cast("long").alias("z"), *(x.alias(c) for c, x in colour.items()))
    v = F.struct("cx", "cy", "cz", "x", "y", "z", "r", "g", "b")
    corners = F.array(*(F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))
    to = named.select("cx", "cy", "h", v.alias("v"), F.explode(corners).alias("o")).select((F.col("cx") - F.col("o.dx")).alias("gx"), (F.col("cy") - F.col("o.dy")).alias("gy"), F.col("o.k").alias("k"), "h", "v")
    full = to.groupBy("gx", "gy").agg(F.count("*").alias("n"), (F.max("h") - F.min("h")).alias("step"), *(F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"q{k}") for k in range(4)))
    close = full.where((F.col("n") == 4) & (F.col("step") <= 2 * cfg.splat_radius))
    zero = F.lit(0).cast("long")
    return close.select(cell(F.col("gx"), cfg.block_dim).alias("bx"), cell(F.col("gy"), cfg.block_dim).alias("by"), zero.alias("bz"), "gx", "gy", zero.alias("gz"), F.lit(0).alias("axis"), "q0", "q1", "q2", "q3")


def triangles(found: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Two triangles a quad, (a, b, c) and (a, c, d), with vertices at cell centres, in quad order per tile."""
    v = {n: F.struct(((F.col("cx") + dx) * cfg.voxel + cfg.voxel / 2).alias("x"), ((F.col("cy") + dy) * cfg.voxel + cfg.voxel / 2).alias("y"), F.col(z).alias("z")) for n, dx, dy, z in (("a", 0, 0, "z00"), ("b", 1, 0, "z10"), ("c", 1, 1, "z11"), ("d", 0, 1, "z01"))}
    both = F.array(*(F.struct(*(v[n].alias(f"v{i}") for i, n in enumerate(t))) for t in ("abc", "acd")))
    tiled = found.withColumns({"bx": cell(F.col("cx"), cfg.block_dim), "by": cell(F.col("cy"), cfg.block_dim), "t": both})
    w = Window.partitionBy("bx", "by").orderBy("cy", "cx", "half")
    return tiled.select("bx", "by", "cx", "cy", F.posexplode("t").alias("half", "t")).select("bx", "by", (F.row_number().over(w) - 1).alias("ord"), "t.v0", "t.v1", "t.v2")
