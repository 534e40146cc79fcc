"""Points from the driver's tables: a thin sheet of three segments, each as preview and refined, in whole millimetres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import ranked
from .lineage import cut


def point_view(spark: SparkSession, sf_dir: str, order: bool = False) -> DataFrame:
    """seg, level, x, y, z, nx, ny, nz (thousandths), r, g, b; with `order`, also ord within a segment and level."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seg = (F.col("l_suppkey") % 3).cast("int")
    trusted = F.col("l_returnflag") != "R"
    milli = lambda c: F.when(trusted, F.round(c * 1000).cast("long")).otherwise(F.lit(0).cast("long"))
    out = t.select(
        seg.alias("seg"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("level"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 97 * 70 - 3300 + seg * 4000).cast("long").alias("x"),
        ((F.col("l_orderkey") * 11 + F.col("l_linenumber")) % 89 * 70 - 3100).cast("long").alias("y"),
        ((F.col("l_quantity") - 25) * 2).cast("long").alias("z"),
        milli(F.col("l_discount") - 0.05).alias("nx"),
        milli(F.col("l_tax") - 0.04).alias("ny"),
        milli(F.lit(1.0)).alias("nz"),
        (F.col("l_quantity") * 5).cast("long").alias("r"),
        (F.col("l_linenumber") * 30).cast("long").alias("g"),
        F.round(F.col("l_discount") * 1000).cast("long").alias("b"),
        *((F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) if order else ()),
    )
    if order:
        by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        out = ranked(out, ["seg", "level"], by, cut, "ord").drop(*by)
    return out


def stride(points: DataFrame, step: int) -> DataFrame:
    """Every step-th point from the first on; points: with ord."""
    if step <= 0:
        raise ValueError("stride must be positive")
    return points.where(F.col("ord") % step == 0)


def synthetic_preview(points: DataFrame, step: int = 4) -> DataFrame:
    """A preview made of a stride of refined points, without normals."""
    return stride(points, step).withColumns({"level": F.lit(0), "nx": F.lit(0).cast("long"), "ny": F.lit(0).cast("long"), "nz": F.lit(0).cast("long")})
