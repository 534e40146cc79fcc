"""Dirty blocks, change detection and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import cell

BLOCK = ["bx", "by", "bz"]


def admitted(arrivals: DataFrame, refined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) arrivals (seg, level): nothing may follow a segment's refined version.

    rejected has a reason: AlreadyRefined or PreviewAfterRefined.
    """
    late = arrivals.join(refined.select("seg").distinct(), "seg", "left_semi")
    reason = F.when(F.col("level") == 1, "AlreadyRefined").otherwise("PreviewAfterRefined")
    return arrivals.join(refined.select("seg").distinct(), "seg", "left_anti"), late.withColumn("reason", reason)


def halo(touched: DataFrame, cfg: Config = Config(), upper_only: bool = False) -> DataFrame:
    """(bx, by, bz, direct): the blocks to extract again when the voxels (gx, gy, gz) change.

    A block reads voxels -1..dim of itself (0..dim with upper_only), so a voxel at local 0 also concerns the block before,
    and one at local dim - 1 the block after, on each axis; the one after on all three is never concerned. direct: the
    block's own voxels changed. The set is exact.
    """
    dim = cfg.block_dim
    local = touched.select("gx", "gy", "gz").distinct().withColumns({f"b{a}": cell(F.col(f"g{a}"), dim) for a in "xyz"})
    # what matters of a voxel is its block and on which sides it stands: few rows a block are left before they spread
    side = {f"s{a}": F.when(F.col(f"g{a}") == F.col(f"b{a}") * dim, -1).when(F.col(f"g{a}") == F.col(f"b{a}") * dim + dim - 1, 0 if upper_only else 1).otherwise(0) for a in "xyz"}
    sides = local.select(*BLOCK, *(v.alias(k) for k, v in side.items())).distinct()
    out = sides
    for a in "xyz":
        out = out.withColumn(f"o{a}", F.explode(F.array_distinct(F.array(F.lit(0), F.col(f"s{a}")))))
    out = out.where(~((F.col("ox") == 1) & (F.col("oy") == 1) & (F.col("oz") == 1)))
    return out.groupBy(*((F.col(f"b{a}") + F.col(f"o{a}")).alias(f"b{a}") for a in "xyz")).agg(F.max((F.col("ox") == 0) & (F.col("oy") == 0) & (F.col("oz") == 0)).alias("direct"))


def marked(*dirty: DataFrame) -> DataFrame:
    """Dirty sets together; a direct mark wins."""
    out = dirty[0]
    for d in dirty[1:]:
        out = out.unionByName(d)
    return out.groupBy(*BLOCK).agg(F.max("direct").alias("direct"))


def digests(meshes: DataFrame) -> DataFrame:
    """(bx, by, bz, digest): names a block's mesh by its exact content."""
    text = F.concat_ws(";", *(F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in ("positions", "colors", "indices")))
    return meshes.select(*BLOCK, F.md5(text).alias("digest"))


def apply(state: DataFrame, built: DataFrame, dirty: DataFrame) -> DataFrame:
    """The new state (bx, by, bz, version, digest, changed) after the dirty blocks were built again.

    A block whose mesh differs gets the next version; one that vanished keeps its row, with null digest. Others stay as they
    are. state: bx, by, bz, version, digest; built: digests of the dirty blocks' meshes.
    """
    again = dirty.select(*BLOCK).join(built, BLOCK, "left").withColumn("again", F.lit(True)).withColumnRenamed("digest", "new")
    both = state.select(*BLOCK, "version", "digest").join(again, BLOCK, "full_outer")
    changed = F.coalesce("again", F.lit(False)) & ~F.col("digest").eqNullSafe(F.col("new"))
    version = F.coalesce("version", F.lit(0).cast("long")) + changed.cast("long")
    out = both.select(*BLOCK, version.alias("version"), F.when(changed, F.col("new")).otherwise(F.col("digest")).alias("digest"), changed.alias("changed"))
    return out.where((F.col("version") > 0) | F.col("changed"))


def extract_stats(dirty: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counts over the dirty blocks; before and after: (bx, by, bz, digest), null or no digest for no mesh."""
    both = dirty.join(before.select(*BLOCK, F.col("digest").alias("o")), BLOCK, "left").join(after.select(*BLOCK, F.col("digest").alias("n")), BLOCK, "left")
    same, there, direct = F.col("o").eqNullSafe(F.col("n")), F.col("n").isNotNull(), F.col("direct")
    kinds = {"direct": direct, "updated": ~same, "unchanged_direct": same & direct & there, "unchanged_neighbor": same & ~direct & there, "unchanged_empty": same & ~there}
    return both.agg(F.count("*").alias("reextracted"), *(F.count(F.when(c, 1)).alias(k) for k, c in kinds.items()))


def halo_readers(voxels: DataFrame, dim: int) -> DataFrame:
    """(gx, gy, gz, bx, by, bz): each voxel with every block that reads it; voxels: gx.., and their own block bx..."""
    out = voxels.select("gx", "gy", "gz", *BLOCK).distinct()
    for a in "xyz":
        local = F.col(f"g{a}") - F.col(f"b{a}") * dim
        to = F.when(local == 0, F.array(F.col(f"b{a}"), F.col(f"b{a}") - 1)).when(local == dim - 1, F.array(F.col(f"b{a}"), F.col(f"b{a}") + 1)).otherwise(F.array(F.col(f"b{a}")))
        out = out.withColumn(f"b{a}", F.explode(to))
    return out
