"""Incremental meshing with state tables: ingest segments, extract the blocks whose mesh really changed.

State is a set of Parquet tables under one folder: the rows of the field, a part an arrival (seg, level), the dirty set, and the blocks
with their versions, digests and meshes, a part an extract. Parts are partitioned by regions (plans/regions.py), and a step reads
those around its dirty blocks. A preview's rows are a layer of their own, so replacing or refining a segment drops whole parts and
never subtracts. A block's row in the last part that has one holds; a part is merged with the one before it when that has at most
twice its rows, so parts stay few, and each row is written again only so often as the table doubles.

Every step writes its tables first and then a manifest that names them, so a mesher opened again on the folder goes on from the
last complete step. Steps may carry the number of the batch they belong to: what a batch did before it failed is not done
again, and its changes are returned again. vacuum() deletes what no manifest names any more.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BASE, REFINED, Config
from ..functions.columns import cell
from ..operators import bins as binning
from ..operators import field as fields
from ..operators import height, incremental, mesh, normals, orient, surface
from . import regions
from .lineage import cut

BLOCK = incremental.BLOCK
ARRAYS = "positions array<long>, colors array<int>, indices array<int>"
CHANGES = f"bx long, by long, bz long, version long, {ARRAYS}"
BLOCKS = f"bx long, by long, bz long, version long, digest string, {ARRAYS}"


class IngestError(ValueError):
    """AlreadyRefined or PreviewAfterRefined; nothing was changed."""


@dataclass(frozen=True)
class IngestStats:
    input_points: int = 0
    bins: int = 0
    normals_estimated: int = 0
    bins_dropped: int = 0
    removed_preview: bool = False
    dirty_blocks: int = 0


@dataclass(frozen=True)
class ExtractStats:
    reextracted: int = 0
    direct: int = 0
    updated: int = 0
    unchanged_direct: int = 0
    unchanged_neighbor: int = 0
    unchanged_empty: int = 0


@dataclass(frozen=True)
class BlockMesh:
    """One block; positions in thousandths of a millimetre as x y z, colours as r g b."""

    id: tuple[int, int, int]
    version: int
    positions: list[int]
    colors: list[int]
    indices: list[int]

    @property
    def vertex_count(self) -> int:
        return len(self.positions) // 3

    @property
    def tri_count(self) -> int:
        return len(self.indices) // 3

    @property
    def heap_bytes(self) -> int:
        return 4 * len(self.positions) + len(self.colors) + 4 * len(self.indices)


class Mesher:
    """What the surface and the height mesher share. They give rows() of an arrival, halo() of rows, and build() dirty blocks."""

    ROWS: str

    def __init__(self, spark: SparkSession, folder: str, cfg: Config = Config()):
        self.spark, self.folder, self.cfg = spark, folder.rstrip("/"), cfg
        self._rows = regions.Table(spark, f"{self.folder}/rows", self.ROWS)
        self._blocks = regions.Table(spark, f"{self.folder}/blocks", BLOCKS)
        self._kept: dict[str, Any] = self._last() or {"generation": 0, "layers": {}, "refined": [], "dirty": None, "parts": [], "arrivals": [], "extracted": None, "changes": None, "extract": asdict(ExtractStats())}

    def rows(self, sums: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """Rows to keep of an arrival (seg, level), from the sums of its bins, and its counts for IngestStats."""
        raise NotImplementedError

    def halo(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def block_of(self) -> dict[str, Column]:
        """The block that a row lies in."""
        raise NotImplementedError

    def build(self, dirty: DataFrame, rows: DataFrame) -> DataFrame:
        """(bx, by, bz, positions, colors, indices) of the dirty blocks that have a mesh, from the rows in and around them."""
        raise NotImplementedError

    # state

    def _found(self, pattern: str) -> list[str]:
        """Paths below the folder that match."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(f.getPath().toString() for f in found or [])

    def _manifests(self) -> list[str]:
        """The complete ones; files appear in their folders as they are committed."""
        return [f.rsplit("/", 1)[0] for f in self._found("manifest-*/part-*")]

    def _manifest(self, path: str) -> dict[str, Any]:
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _last(self) -> dict[str, Any] | None:
        found = self._manifests()
        return self._manifest(found[-1]) if found else None

    def _next(self) -> int:
        self._kept["generation"] += 1
        return self._kept["generation"]

    def _commit(self, kept: dict[str, Any]) -> None:
        kept["generation"] = self._kept["generation"] + 1
        self.spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest-{kept['generation']:08d}")
        self._kept = kept

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what the last `keep` steps do not name, and returns how many folders that were.

        DataFrames of earlier steps that were not read yet lose their files.
        """
        manifests = self._manifests()[-keep:]
        if not manifests:
            return 0
        named = {m.rsplit("/", 1)[-1] for m in manifests}
        for kept in map(self._manifest, manifests):
            named |= {f"rows/part={p['part']}" for parts in kept["layers"].values() for p in parts}
            named |= {f"blocks/part={p['part']}" for p in [*kept["parts"], *([kept["changes"]] if kept["changes"] else [])]}
            named |= {kept["dirty"].rsplit("/", 1)[-1]} if kept["dirty"] else set()
        gone = [f for pattern, depth in (("manifest-*", 1), ("dirty-*", 1), ("rows/part=*", 2), ("blocks/part=*", 2)) for f in self._found(pattern) if "/".join(f.split("/")[-depth:]) not in named]
        for f in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(gone)

    def _dirty(self) -> DataFrame | None:
        return self.spark.read.schema("bx long, by long, bz long, direct boolean").parquet(self._kept["dirty"]) if self._kept["dirty"] else None

    # ingest

    @staticmethod
    def refusal(level: int) -> str:
        """Why points of a refined segment are not taken."""
        return "AlreadyRefined" if level == REFINED else "PreviewAfterRefined"

    def done(self, batch: int | str) -> set[tuple[int, int]]:
        """The arrivals (seg, level) that are in from this batch, which is the last one or comes again."""
        return {(a[0], a[1]) for a in self._kept["arrivals"] if a[2] == batch}

    def ingest(self, seg: int, level: int, points: DataFrame, batch: int | str | None = None) -> IngestStats:
        """points: the columns of binning.aggregate in whole millimetres; seg and level are set here.

        IngestError if the segment was refined before. A preview of the segment is dropped first, whatever follows it.
        """
        return self.ingest_sums(seg, level, binning.aggregate(points.withColumns({"seg": F.lit(seg), "level": F.lit(level)}), self.cfg), batch)

    def ingest_sums(self, seg: int, level: int, sums: DataFrame, batch: int | str | None = None) -> IngestStats:
        """ingest of points that are binned already; sums: as binning.aggregate gives them for the arrival (seg, level)."""
        kept = json.loads(json.dumps(self._kept))
        for a in kept["arrivals"]:
            if batch is not None and a[:3] == [seg, level, batch]:
                return IngestStats(**a[3])
        if seg in kept["refined"]:
            raise IngestError(self.refusal(level))
        rows, counts = self.rows(sums)  # sees the base only
        part = self._rows.write(rows, self._next(), self.block_of())
        gone = kept["layers"].pop(str(seg), [])
        marks = [self.halo(self._rows.read([p])) for p in [*gone, part]]
        before = self._dirty()
        dirty = f"{self.folder}/dirty-{self._next():08d}"
        incremental.marked(*([before] if before is not None else []), *marks).write.mode("overwrite").parquet(dirty)
        if level == REFINED:
            kept["refined"].append(seg)
        kept["layers"].setdefault(str(BASE if level == REFINED else seg), []).append(part)
        kept["dirty"] = dirty
        stats = IngestStats(**counts, removed_preview=bool(gone), dirty_blocks=self.spark.read.parquet(dirty).count())
        kept["arrivals"] = [a for a in kept["arrivals"] if a[2] == batch] + ([[seg, level, batch, asdict(stats)]] if batch is not None else [])
        self._commit(kept)
        return stats

    def field(self, *layers: int, near: regions.Chosen | None = None) -> DataFrame:
        """Rows of the given layers (BASE, or the segment of a preview), or of all; with near, those of these regions."""
        return self._rows.read([p for layer, parts in self._kept["layers"].items() if not layers or int(layer) in layers for p in parts], near)

    def layers(self) -> list[int]:
        return sorted(int(x) for x in self._kept["layers"])

    def pending_segments(self) -> list[int]:
        return [x for x in self.layers() if x != BASE]

    def refined_segments(self) -> list[int]:
        return sorted(self._kept["refined"])

    def dirty_count(self) -> int:
        dirty = self._dirty()
        return 0 if dirty is None else dirty.count()

    # extract

    def extract(self, batch: int | str | None = None) -> DataFrame:
        """Changed blocks (CHANGES) in block order; null arrays: the block is gone. Clears the dirty set."""
        kept = json.loads(json.dumps(self._kept))
        if batch is None or kept["extracted"] != batch:
            dirty = self._dirty()
            if dirty is None:
                kept |= {"changes": None, "extract": asdict(ExtractStats())}
            else:
                near = regions.around(dirty)
                built = cut(self.build(dirty, self.field(near=near)))
                new = incremental.digests(built)
                state = self._state(near)
                after = cut(incremental.apply(state, new, dirty))
                changed = after.where("changed").join(built, BLOCK, "left").select(*BLOCK, "version", "digest", "positions", "colors", "indices")
                kept["extract"] = incremental.extract_stats(dirty, state, new).first().asDict()
                kept["changes"] = self._blocks.write(changed, self._next(), {b: F.col(b) for b in BLOCK})
                kept["parts"] = self._merged([*kept["parts"], *([kept["changes"]] if kept["changes"]["rows"] else [])])
                kept["dirty"] = None
            kept["extracted"] = batch
            self._commit(kept)
        return self._blocks.read([kept["changes"]] if kept["changes"] else []).select(*BLOCK, "version", "positions", "colors", "indices").orderBy(*BLOCK)

    def _merged(self, parts: list[regions.Part]) -> list[regions.Part]:
        """parts with the last ones put together, as far as none has twice the rows of all after it."""
        at, rows = len(parts) - 1, parts[-1]["rows"] if parts else 0
        while at > 0 and parts[at - 1]["rows"] <= 2 * rows:
            at -= 1
            rows += parts[at]["rows"]
        if at >= len(parts) - 1:
            return parts
        return [*parts[:at], self._blocks.write(self._newest(parts[at:]), self._next(), {b: F.col(b) for b in BLOCK})]

    def _newest(self, parts: list[regions.Part], near: regions.Chosen | None = None) -> DataFrame:
        """The row that holds of every block; a part has at most one."""
        rows = self._blocks.read(parts, near)
        if len(parts) < 2:
            return rows
        return rows.join(rows.groupBy(*BLOCK).agg(F.max("version").alias("version")), [*BLOCK, "version"], "left_semi")

    def extract_stats(self) -> ExtractStats:
        return ExtractStats(**self._kept["extract"])

    def _state(self, near: regions.Chosen | None = None) -> DataFrame:
        """(bx, by, bz, version, digest) of every block that ever had a mesh."""
        rows = self._blocks.read(self._kept["parts"], near)
        return rows.groupBy(*BLOCK).agg(F.max(F.struct("version", "digest")).alias("s")).select(*BLOCK, "s.*")

    def meshes(self, near: regions.Chosen | None = None) -> DataFrame:
        """All blocks that have a mesh, with their versions; with near, those of these regions."""
        return self._newest(self._kept["parts"], near).where("digest is not null").select(*BLOCK, "version", "positions", "colors", "indices")

    def _region(self, block: tuple[int, int, int]) -> regions.Chosen:
        at = [b // regions.REGION for b in block]
        name = "_".join(map(str, at))
        return regions.Chosen(self.spark.createDataFrame([(name,)], "region string"), [(a, a) for a in at], [name])

    def _at(self, block: tuple[int, int, int]) -> Any:
        return (F.col("bx") == block[0]) & (F.col("by") == block[1]) & (F.col("bz") == block[2])

    def mesh(self, block: tuple[int, int, int]) -> BlockMesh | None:
        r = self.meshes(self._region(block)).where(self._at(block)).first()
        return BlockMesh(tuple(block), r["version"], r["positions"], r["colors"], r["indices"]) if r else None

    def version(self, block: tuple[int, int, int]) -> int:
        """0 for a block that never had a mesh; a block that is gone keeps its last version."""
        r = self._state(self._region(block)).where(self._at(block)).select("version").first()
        return r[0] if r else 0

    def block_ids(self) -> DataFrame:
        return self.meshes().select(*BLOCK)

    def block_count(self) -> int:
        return self.meshes().where(F.size("indices") > 0).count()

    def total_tris(self) -> int:
        return mesh.statistics(self.meshes()).first()["triangles"]

    def mesh_bytes(self) -> int:
        return mesh.statistics(self.meshes()).first()["bytes"]

    def field_bytes(self) -> int:
        """Bytes of the sums that the field keeps, eight a number."""
        return sum(p["rows"] for parts in self._kept["layers"].values() for p in parts) * 8 * len(self.ROWS.split(","))


class SurfaceMesher(Mesher):
    """The 3-D surface. orientation: "propagate" or "up"; the oracle is asked if there is a base."""

    ROWS = "layer int, gx long, gy long, gz long, wd long, w long, wr long, wg long, wb long"

    def __init__(self, spark: SparkSession, folder: str, cfg: Config = Config(), orientation: str = "propagate", oracle: bool = True):
        super().__init__(spark, folder, cfg)
        self.orientation, self.oracle = orientation, oracle

    def prepare_bins(self, points: DataFrame) -> DataFrame:
        """Bins as ingest accumulates them."""
        return self._prepared(binning.aggregate(points, self.cfg))

    def _prepared(self, sums: DataFrame) -> DataFrame:
        b = cut(normals.estimate(binning.finalise(sums), self.cfg))
        base = None
        if self.oracle and BASE in self.layers():
            # the oracle looks at voxels within three of a bin; a block has eight at least
            side = float(self.cfg.voxel * self.cfg.block_dim)
            asked = b.where(~F.col("fixed")).select(*(F.floor(F.col(f"p{a}") / side).cast("long").alias(f"b{a}") for a in "xyz"))
            base = self.field(BASE, near=regions.around(asked.distinct()))
        return orient.orient(b, cut, base, self.orientation, self.cfg)

    def contributions(self, bins: DataFrame) -> DataFrame:
        return fields.field(bins, self.cfg)

    def rows(self, sums: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        sums = cut(sums)
        b = cut(self._prepared(sums))
        every = binning.finalise(sums).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if("fixed")).first()
        used = b.count()
        return self.contributions(b), {"input_points": every[0], "bins": used, "normals_estimated": used - every[2], "bins_dropped": every[1] - used}

    def halo(self, rows: DataFrame) -> DataFrame:
        return incremental.halo(rows, self.cfg)

    def layer_ranges(self) -> DataFrame:
        """(layer, first and last voxel on each axis, voxels) of every layer."""
        return self.field().groupBy("layer").agg(*(f(f"g{a}").alias(f"g{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))), F.count("*").alias("voxels"))

    def block_of(self) -> dict[str, Column]:
        return {f"b{a}": cell(F.col(f"g{a}"), self.cfg.block_dim) for a in "xyz"}

    def build(self, dirty: DataFrame, rows: DataFrame) -> DataFrame:
        # a block reads its own voxels and one layer around: rows go to the blocks that read them, then leave again
        near = incremental.halo_readers(rows.withColumns(self.block_of()), self.cfg.block_dim)
        voxels = near.join(dirty.select(*BLOCK), BLOCK, "left_semi").select("gx", "gy", "gz").distinct()
        seen = cut(fields.observed(fields.layer_sum(rows.join(voxels, ["gx", "gy", "gz"], "left_semi")), self.cfg))
        found = surface.quads(seen, surface.vertices(seen, self.cfg), self.cfg).join(dirty.select(*BLOCK), BLOCK, "left_semi")
        if not self.cfg.simplify_error:
            return surface.meshes(found)
        found = cut(found)
        seams = surface.seam(surface.block_vertices(found), self.cfg).select(*BLOCK, "idx")
        return mesh.simplify(surface.meshes(found), seams, float(self.cfg.simplify_error))


class HeightMesher(Mesher):
    """The 2.5-D surface, in tiles (bx, by, 0): a tile reads its own cells and the first ones of the tiles after it."""

    ROWS = "layer int, cx long, cy long, wz long, w long, wr long, wg long, wb long"

    def rows(self, sums: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        b = cut(binning.finalise(sums, trust="never"))
        every = b.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        return height.cells(b, self.cfg), {"input_points": every[0], "bins": every[1]}

    @staticmethod
    def _cells(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"gx": F.col("cx"), "gy": F.col("cy"), "gz": F.lit(0).cast("long")})

    def halo(self, rows: DataFrame) -> DataFrame:
        return incremental.halo(self._cells(rows), self.cfg, upper_only=True).where("bz = 0")

    def block_of(self) -> dict[str, Column]:
        return {"bx": cell(F.col("cx"), self.cfg.block_dim), "by": cell(F.col("cy"), self.cfg.block_dim), "bz": F.lit(0).cast("long")}

    def build(self, dirty: DataFrame, rows: DataFrame) -> DataFrame:
        near = incremental.halo_readers(self._cells(rows).withColumns(self.block_of()), self.cfg.block_dim)
        cells = near.join(dirty.select(*BLOCK), BLOCK, "left_semi").select(F.col("gx").alias("cx"), F.col("gy").alias("cy")).distinct()
        found = height.faces(height.surface(rows.join(cells, ["cx", "cy"], "left_semi"), self.cfg), self.cfg)
        return surface.meshes(found.join(dirty.select(*BLOCK), BLOCK, "left_semi"))
