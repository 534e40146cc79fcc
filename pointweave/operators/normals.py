"""Normals of bins from the plane through their neighbours.

The window (Chebyshev distance of cells <= r) is a box, so its sums are built axis by axis: a cell's partial sums go to the
2 r + 1 cells along one axis and are added up there, three times over. No pair of bins is ever made, rows are narrow, and partial
aggregation works. Moments are whole numbers relative to the cell, at any distance from the origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NORMAL_ONE, Config
from .bins import KEY

MOMENTS = ("x", "y", "z", "xx", "yy", "zz", "xy", "xz", "yz")


def _along(sums: DataFrame, axis: str, r: int, size: int) -> DataFrame:
    """Sums (m, t..) per cell, relative to it, added up over the cells within r on one axis and moved to the cell they go to."""
    to = sums.withColumn("o", F.explode(F.array(*(F.lit(i).cast("long") for i in range(-r, r + 1)))))
    d, m = F.col("o") * -size, F.col("m")
    moved = {f"k{axis}": F.col(f"k{axis}") + F.col("o"), f"t{axis}": F.col(f"t{axis}") + m * d}
    for k in MOMENTS[3:]:
        if k == axis * 2:
            moved[f"t{k}"] = F.col(f"t{k}") + 2 * d * F.col(f"t{axis}") + m * d * d
        elif axis in k:
            moved[f"t{k}"] = F.col(f"t{k}") + d * F.col(f"t{k.replace(axis, '')}")
    to = to.select(*(moved.get(c, F.col(c)).alias(c) for c in sums.columns))
    return to.groupBy(*KEY).agg(F.sum("m").alias("m"), *(F.sum(f"t{k}").alias(f"t{k}") for k in MOMENTS))


def moments(bins: DataFrame, cfg: Config = Config()) -> DataFrame:
    """bins and, over their window: m (bins), mx.., mxx.., sums of differences to the bin's position and of their products."""
    own = {a: F.col(f"p{a}") - F.col(f"k{a}") * cfg.bin for a in "xyz"}
    sums = bins.select(*KEY, F.lit(1).cast("long").alias("m"), *((own[k] if len(k) == 1 else own[k[0]] * own[k[1]]).alias(f"t{k}") for k in MOMENTS))
    for a in "xyz":
        sums = _along(sums, a, cfg.normal_radius_bins, cfg.bin)
    m = F.col("m")
    out = {f"m{k}": F.col(f"t{k}") - m * own[k] for k in "xyz"}
    for k in MOMENTS[3:]:
        a, b = k
        out[f"m{k}"] = F.col(f"t{k}") - own[a] * F.col(f"t{b}") - own[b] * F.col(f"t{a}") + m * own[a] * own[b]
    return bins.join(sums, KEY).withColumns(out).drop(*(f"t{k}" for k in MOMENTS))


def covariance() -> dict[str, Column]:
    """E[d d'] - mean mean', in square millimetres."""
    m = F.col("m")
    return {k: F.col(f"m{k}") / m - (F.col(f"m{k[0]}") / m) * (F.col(f"m{k[1]}") / m) for k in MOMENTS[3:]}


PAIRS = ("xx", "yy", "zz", "xy", "xz", "yz")
#: Steps towards the least eigenvalue; how far below it to stay, as a part of the trace; squarings after that.
STEPS, BELOW, SQUARINGS = 6, 1e-7, 5


def _adjugate(m: dict[str, Column]) -> dict[str, Column]:
    return {
        "xx": m["yy"] * m["zz"] - m["yz"] * m["yz"], "yy": m["xx"] * m["zz"] - m["xz"] * m["xz"], "zz": m["xx"] * m["yy"] - m["xy"] * m["xy"],
        "xy": m["xz"] * m["yz"] - m["xy"] * m["zz"], "xz": m["xy"] * m["yz"] - m["xz"] * m["yy"], "yz": m["xy"] * m["xz"] - m["yz"] * m["xx"],
    }


def smallest_eigenvector(frame: DataFrame, out: tuple[str, str, str]) -> DataFrame:
    """Adds the unit eigenvector of the least eigenvalue of the positive semidefinite (xx, yy, zz, xy, xz, yz), z >= 0, in millionths.

    Laguerre's iteration climbs from 0 to the least root of the characteristic polynomial and never passes it. A little below, the
    shifted matrix still is positive, and its adjugate has the wanted direction as that of its greatest eigenvalue, by
    (l1 - shift) / (l2 - shift) before the next. Squaring the adjugate leaves that direction alone, and its greatest column is
    taken. Where least eigenvalues coincide, what is left is a projection on their space, so its greatest column is a vector of
    it: no case is apart but the zero matrix, which stands for equal eigenvalues. Of equal columns the one of z comes first.
    """
    names = {k: f"_{k}" for k in PAIRS}
    c = {k: F.col(n) for k, n in names.items()}
    trace = F.col("xx") + F.col("yy") + F.col("zz")
    f = frame.withColumn("_t", F.when(trace > 0, trace).otherwise(1.0)).withColumns({n: F.col(k) / F.col("_t") for k, n in names.items()})
    adj = _adjugate(c)
    f = f.withColumns({"_e1": c["xx"] + c["yy"] + c["zz"], "_e2": adj["xx"] + adj["yy"] + adj["zz"], "_e3": c["xx"] * adj["xx"] + c["xy"] * adj["xy"] + c["xz"] * adj["xz"], "_l": F.lit(0.0)})
    x = F.col("_l")
    for _ in range(STEPS):
        f = f.withColumns({"_p": ((F.col("_e1") - x) * x - F.col("_e2")) * x + F.col("_e3"), "_d": (3 * x - 2 * F.col("_e1")) * x + F.col("_e2"), "_c": 2 * F.col("_e1") - 6 * x})
        under = 4 * F.col("_d") * F.col("_d") - 6 * F.col("_p") * F.col("_c")
        root = F.when(under >= 0, F.sqrt(under))  # below zero by rounding only, at equal roots that are found
        f = f.withColumn("_l", x + F.greatest(F.coalesce(F.try_divide(3 * F.col("_p"), F.col("_d") + root), F.lit(0.0)), F.lit(0.0)))
    f = f.withColumns({names[k]: c[k] - (F.col("_l") - BELOW) for k in PAIRS[:3]})
    f = f.withColumns({names[k]: v for k, v in _adjugate(c).items()})
    f = f.withColumn("_n", c["xx"] + c["yy"] + c["zz"]).withColumns({n: F.col(n) / F.col("_n") for n in names.values()})
    side = lambda i, j: c["".join(sorted(i + j))]
    for _ in range(SQUARINGS):
        f = f.withColumns({names[k]: side(k[0], "x") * side("x", k[1]) + side(k[0], "y") * side("y", k[1]) + side(k[0], "z") * side("z", k[1]) for k in PAIRS})
    most = F.greatest(c["xx"], c["yy"], c["zz"])
    f = f.withColumns({f"_v{k}": F.when(c["zz"] == most, side(k, "z")).when(c["yy"] == most, side(k, "y")).otherwise(side(k, "x")) for k in "xyz"})
    size = F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy") + F.col("_vz") * F.col("_vz"))
    f = f.withColumn("_n", F.when(F.col("_vz") < 0, -size).otherwise(size))
    return f.withColumns({o: F.round(F.col(f"_v{k}") / F.col("_n") * NORMAL_ONE).cast("long") for o, k in zip(out, "xyz", strict=True)}).drop(*(n for n in f.columns if n.startswith("_")))


def estimate(bins: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Fills the normals of bins that have none; those whose window is too small are dropped.

    All bins count as neighbours, also trusted ones and those dropped later.
    """
    seen = moments(bins, cfg).where(F.col("fixed") | (F.col("m") >= cfg.normal_min_neighbors))
    solved = smallest_eigenvector(seen.withColumns(covariance()), ("ex", "ey", "ez"))
    pick = {f"n{k}": F.coalesce(f"n{k}", f"e{k}") for k in "xyz"}
    return solved.withColumns(pick).select(*KEY, "n", "px", "py", "pz", "nx", "ny", "nz", "r", "g", "b", "fixed")
