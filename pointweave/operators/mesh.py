"""Operators on finished meshes: welding, distance to the input, simplification, counts."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cell, offsets
from .rank import ranked

BLOCK = ["bx", "by", "bz"]


def weld(verts: DataFrame) -> DataFrame:
    """(x, y, z, r, g, b, uses): vertices of all blocks with equal positions become one; the first block's colour stays."""
    first = F.min(F.struct(*BLOCK, "idx", "r", "g", "b"))
    one = verts.groupBy("x", "y", "z").agg(first.alias("f"), F.count("*").alias("uses"))
    return one.select("x", "y", "z", "f.r", "f.g", "f.b", "uses")


def numbered(welded: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """welded with dense numbers from 0 by position."""
    return ranked(welded, [], ["x", "y", "z"], cut)


def exploded(meshes: DataFrame) -> DataFrame:
    """(bx, by, bz, idx, x, y, z, r, g, b): the vertices of meshes in arrays."""
    at = lambda c, k: F.get(c, F.col("idx") * 3 + k)
    each = meshes.where(F.size("positions") > 0).select(*BLOCK, "positions", "colors", F.explode(F.sequence(F.lit(0), (F.size("positions") / 3 - 1).cast("int"))).alias("idx"))
    return each.select(*BLOCK, "idx", *(at("positions", k).alias(a) for k, a in enumerate("xyz")), *(at("colors", k).alias(c) for k, c in enumerate("rgb")))


def welded_faces(meshes: DataFrame, verts: DataFrame, numbers: DataFrame) -> DataFrame:
    """(bx, by, bz, k, i0, i1, i2): each block's triangles with the numbers of the welded vertices; verts as from exploded."""
    corner = meshes.where(F.size("indices") > 0).select(*BLOCK, F.posexplode("indices").alias("c", "idx"))
    named = corner.join(verts.select(*BLOCK, "idx", "x", "y", "z"), [*BLOCK, "idx"]).join(numbers.select("x", "y", "z", F.col("idx").alias("to")), ["x", "y", "z"])
    pick = [F.max(F.when(F.col("c") % 3 == i, F.col("to"))).alias(f"i{i}") for i in range(3)]
    return named.groupBy(*BLOCK, F.floor(F.col("c") / 3).alias("k")).agg(*pick)


def far(verts: DataFrame, points: DataFrame, distance: int) -> DataFrame:
    """Vertices (x, y, z in millimetres, columns kept) without a point within distance.

    Points lie in cells twice as wide as distance, so what a vertex can reach lies in two cells an axis: eight copies of it. A
    copy is done at its first near point.
    """
    side = 2 * distance
    grid = points.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz")).distinct()
    grid = grid.withColumns({f"k{a}": cell(F.col(f"q{a}"), side) for a in "xyz"})
    named = verts.withColumn("vid", F.struct("x", "y", "z"))
    reach = named.select("vid").distinct().select("vid", "vid.*", F.explode(F.array(*offsets(0, 1, "dx", "dy", "dz"))).alias("o"))
    reach = reach.withColumns({f"k{a}": cell(F.col(a) - distance, side) + F.col(f"o.d{a}") for a in "xyz"})
    d2 = sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in "xyz"), F.lit(0))
    r, g = reach.alias("r"), grid.alias("g")
    met = [F.col(f"r.k{a}") == F.col(f"g.k{a}") for a in "xyz"]
    hit = r.join(g, met[0] & met[1] & met[2] & (d2 <= distance * distance), "left_semi").select("vid").distinct()
    return named.join(hit, "vid", "left_anti").drop("vid")


def far_fraction(verts: DataFrame, points: DataFrame, distance: int) -> DataFrame:
    """One row (vertices, far, fraction); the fraction of no vertices is 0."""
    lost = far(verts, points, distance).agg(F.count("*").alias("far"))
    return verts.agg(F.count("*").alias("vertices")).crossJoin(lost).withColumn("fraction", F.when(F.col("vertices") > 0, F.try_divide("far", "vertices")).otherwise(0.0))


def statistics(meshes: DataFrame) -> DataFrame:
    """One row: blocks, vertices, triangles and bytes (12 a position, 3 a colour, 4 an index)."""
    v, t = F.size("positions") / 3, F.size("indices") / 3
    return meshes.agg(
        F.count("*").alias("blocks"), F.coalesce(F.sum(v).cast("long"), F.lit(0)).alias("vertices"), F.coalesce(F.sum(t).cast("long"), F.lit(0)).alias("triangles"),
        F.coalesce(F.sum(F.size("positions") * 4 + F.size("colors") + F.size("indices") * 4).cast("long"), F.lit(0)).alias("bytes"),
    )


def collapse(points: np.ndarray, triangles: np.ndarray, locked: np.ndarray, error: float) -> np.ndarray:
    """Triangles left after quadric edge collapses onto existing vertices; locked vertices stay, distances stay within error.

    Least cost first, then least vertex numbers, so the result depends on the mesh only. A collapse that would turn a triangle
    over is skipped.
    """
    n = len(points)
    quadric = np.zeros((n, 4, 4))
    a, b, c = (points[triangles[:, i]] for i in range(3))
    normal = np.cross(b - a, c - a)
    length = np.linalg.norm(normal, axis=1)
    ok = length > 0
    plane = np.concatenate([normal[ok] / length[ok, None], -((normal[ok] / length[ok, None]) * a[ok]).sum(axis=1)[:, None]], axis=1)
    outer = plane[:, :, None] * plane[:, None, :]
    for i in range(3):
        np.add.at(quadric, triangles[ok, i], outer)
    faces = {i: tuple(t) for i, t in enumerate(triangles.tolist())}
    around: list[set[int]] = [set() for _ in range(n)]
    for i, t in faces.items():
        for v in t:
            around[v].add(i)
    count = np.zeros(n)
    np.add.at(count, triangles[ok].reshape(-1), 1.0)
    stamp = [0] * n

    def cost(u: int, v: int) -> float:
        p = np.append(points[v], 1.0)
        return float(max(0.0, p @ (quadric[u] + quadric[v]) @ p))  # sum of squared distances bounds the largest one

    heap: list[tuple[float, int, int, int, int]] = []

    def offer(u: int, v: int) -> None:
        if not locked[u] and (x := cost(u, v)) <= error * error:
            heapq.heappush(heap, (x, u, v, stamp[u], stamp[v]))

    for t in faces.values():
        for u, v in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            offer(u, v)
            offer(v, u)
    while heap:
        _, u, v, su, sv = heapq.heappop(heap)
        if stamp[u] != su or stamp[v] != sv or not around[u] & around[v]:
            continue
        keep = around[u] - around[v]
        turned = False
        for f in keep:
            before = [points[x] for x in faces[f]]
            after = [points[v if x == u else x] for x in faces[f]]
            if np.dot(np.cross(before[1] - before[0], before[2] - before[0]), np.cross(after[1] - after[0], after[2] - after[0])) <= 0:
                turned = True
                break
        shared = {x for f in around[u] for x in faces[f]} & {x for f in around[v] for x in faces[f]} - {u, v}
        if turned or len(shared) > len(around[u] & around[v]):  # the second would pinch the surface
            continue
        for f in list(around[u] & around[v]):
            for x in faces.pop(f):
                around[x].discard(f)
        for f in keep:
            faces[f] = tuple(v if x == u else x for x in faces[f])
            around[v].add(f)
        around[u] = set()
        quadric[v] += quadric[u]
        stamp[u] = -1
        stamp[v] += 1
        for f in around[v]:
            for x in faces[f]:
                if x != v:
                    offer(v, x)
                    offer(x, v)
    return np.array([faces[i] for i in sorted(faces)], np.int64).reshape(-1, 3)


def simplify(meshes: DataFrame, seams: DataFrame, error_mm: float) -> DataFrame:
    """meshes with fewer triangles, block by block; seams lists the fixed vertices (bx, by, bz, idx). Order of vertices stays.

    A block is a bounded unit (block_dim cubed cells), so a row at a time is a bounded task.
    """
    fixed = seams.groupBy(*BLOCK).agg(F.collect_list("idx").alias("locked"))
    rows = meshes.join(fixed, BLOCK, "left").select(*BLOCK, "positions", "colors", "indices", F.coalesce("locked", F.array().cast("array<int>")).alias("locked"))
    schema = "bx long, by long, bz long, positions array<long>, colors array<int>, indices array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                p, t = np.array(r["positions"], np.int64).reshape(-1, 3), np.array(r["indices"], np.int64).reshape(-1, 3)
                locked = np.zeros(len(p), bool)
                locked[r["locked"]] = True
                t = collapse(p / 1000.0, t, locked, error_mm)
                used = np.unique(t)
                new = np.full(len(p), -1)
                new[used] = np.arange(len(used))
                colors = np.array(r["colors"]).reshape(-1, 3)[used]
                out.append((r["bx"], r["by"], r["bz"], p[used].reshape(-1).tolist(), colors.reshape(-1).tolist(), new[t].reshape(-1).tolist()))
            types = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(types)], [*BLOCK, "positions", "colors", "indices"])

    return rows.mapInArrow(run, schema)
