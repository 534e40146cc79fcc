"""Points to bins: grouped sums per (seg, level, cell), means and trusted normals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NORMAL_ONE, REFINED, Config
from ..functions.columns import cell, finite, mean, valid_normal

KEY = ["seg", "level", "kx", "ky", "kz"]


def quantise(points: DataFrame, metre: int = 1000) -> DataFrame:
    """Points in metres (float columns) to whole millimetres and thousandths; points that are not finite go, bad normals become 0."""
    ok = points.where(finite("x", "y", "z"))
    normal = finite("nx", "ny", "nz")
    zero = F.lit(0).cast("long")
    cols = {c: F.round(F.col(c).cast("double") * metre).cast("long") for c in ("x", "y", "z")}
    cols |= {c: F.when(normal & (F.abs(F.col(c)) < 1e6), F.round(F.col(c).cast("double") * 1000).cast("long")).otherwise(zero) for c in ("nx", "ny", "nz")}
    return ok.withColumns(cols)


def aggregate(points: DataFrame, cfg: Config = Config(), *more: Column) -> DataFrame:
    """Sums per bin: n, sx.., sr.., and nv, snx.. over points with a valid normal, and more. Partial sums are made before the shuffle."""
    ok = valid_normal("nx", "ny", "nz", 1000)
    keyed = points.withColumns({"kx": cell(F.col("x"), cfg.bin), "ky": cell(F.col("y"), cfg.bin), "kz": cell(F.col("z"), cfg.bin)})
    sums = [F.sum(c).alias(f"s{c}") for c in ("x", "y", "z", "r", "g", "b")]
    normals = [F.sum(F.when(ok, F.col(c)).otherwise(0)).alias(f"s{c}") for c in ("nx", "ny", "nz")]
    return keyed.groupBy(*KEY).agg(F.count("*").alias("n"), *sums, F.sum(ok.cast("long")).alias("nv"), *normals, *more)


def merged(sums: DataFrame) -> DataFrame:
    """Sums of parts of the points (aggregate), put together to the sums of all."""
    return sums.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in sums.columns if c not in KEY))


def finalise(sums: DataFrame, trust: str = "level") -> DataFrame:
    """Mean position and colour, and the unit normal (millionths) of refined bins whose normals agree: |sum| > 0.3 nv.

    fixed says whether the normal is trusted. trust: "level" (refined only), "always" or "never".
    """
    length = F.sqrt((F.col("snx") * F.col("snx") + F.col("sny") * F.col("sny") + F.col("snz") * F.col("snz")).cast("double"))
    agreed = (F.col("nv") > 0) & (length > F.col("nv") * 300.0)
    may = {"level": F.col("level") == REFINED, "always": F.lit(True), "never": F.lit(False)}[trust]
    fixed = may & agreed
    unit = [F.when(fixed, F.round(F.col(f"s{c}") / length * NORMAL_ONE).cast("long")).alias(c) for c in ("nx", "ny", "nz")]
    return sums.select(*KEY, "n", *(mean(f"s{c}", "n").alias(f"p{c}") for c in "xyz"), *unit, *(mean(f"s{c}", "n").alias(c) for c in "rgb"), fixed.alias("fixed"))


def bins(points: DataFrame, cfg: Config = Config(), trust: str = "level") -> DataFrame:
    return finalise(aggregate(points, cfg), trust)
