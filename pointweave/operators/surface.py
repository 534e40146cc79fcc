"""Surface Nets as joins and groupings over global voxel keys; no padded blocks are needed.

Positions come out in thousandths of a millimetre, as whole numbers, so that meshes can be compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import cell

CORNERS = [(i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
#: Pairs of corners (numbers in CORNERS) that an edge of a cell joins.
EDGES = [(a, a | 1 << k) for k in range(3) for a in range(8) if not a >> k & 1]


def _inside(d: Column) -> Column:
    return d < 0


def vertices(seen: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(cx, cy, cz, x, y, z, r, g, b): a vertex per cell whose 8 corners are observed, on both sides of the surface.

    It is the mean of the crossings of the cell's edges; so is its colour. Cells without a sign change go before colours
    are mixed.
    """
    to = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip("xyz", c, strict=True)), F.lit(i).alias("k")) for i, c in enumerate(CORNERS)))
    colour = {c: F.col(f"w{c}") / F.col("w") for c in "rgb"}
    parts = seen.select("gx", "gy", "gz", "d", *(v.alias(c) for c, v in colour.items()), F.explode(to).alias("o"))
    parts = parts.select(*((F.col(f"g{a}") - F.col(f"o.{a}")).alias(f"c{a}") for a in "xyz"), F.col("o.k").alias("k"), F.struct("d", "r", "g", "b").alias("v"))
    pick = [F.max(F.when(F.col("k") == i, F.col("v"))).alias(f"v{i}") for i in range(8)]
    inside = F.sum(_inside(F.col("v.d")).cast("int"))
    cells = parts.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), inside.alias("inside"), *pick).where("n = 8 and inside between 1 and 7")
    d = [F.col(f"v{i}.d") for i in range(8)]
    crossing = {e: _inside(d[e[0]]) != _inside(d[e[1]]) for e in EDGES}
    cells = cells.withColumns({f"t{i}": F.when(crossing[e], F.try_divide(d[e[0]], d[e[0]] - d[e[1]])) for i, e in enumerate(EDGES)})
    count = sum((F.col(f"t{i}").isNotNull().cast("int") for i in range(12)), F.lit(0))

    def mean(at: list[Column]) -> Column:
        zero = F.lit(0.0)
        total = zero
        for i, (a, b) in enumerate(EDGES):
            total = total + F.when(F.col(f"t{i}").isNotNull(), at[a] + F.col(f"t{i}") * (at[b] - at[a])).otherwise(zero)
        return total / F.col("count")

    cells = cells.withColumn("count", count)
    out = {}
    for axis, name in enumerate("xyz"):
        out[name] = F.round((F.col(f"c{name}") + mean([F.lit(float(c[axis])) for c in CORNERS])) * (cfg.voxel * 1000.0)).cast("long")
    for c in "rgb":
        out[c] = F.least(F.greatest(F.round(mean([F.col(f"v{i}.{c}") for i in range(8)])), F.lit(0.0)), F.lit(255.0)).cast("int")
    return cells.select("cx", "cy", "cz", *(v.alias(n) for n, v in out.items()))


def sign_edges(seen: DataFrame) -> DataFrame:
    """(gx, gy, gz, axis, flip): voxel edges towards +x, +y, +z that the surface crosses; flip where the near end is outside.

    Each voxel stands for itself on three edges and for the far end of three others: one grouping, no join.
    """
    near = [F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"), F.lit(k).alias("axis"), F.lit(True).alias("near")) for k in range(3)]
    far = [F.struct(*(F.lit(int(a == k)).cast("long").alias(n) for a, n in enumerate("xyz")), F.lit(k).alias("axis"), F.lit(False).alias("near")) for k in range(3)]
    parts = seen.select("gx", "gy", "gz", _inside(F.col("d")).alias("s"), F.explode(F.array(*near, *far)).alias("o"))
    parts = parts.select(*((F.col(f"g{a}") - F.col(f"o.{a}")).alias(f"g{a}") for a in "xyz"), "o.axis", "o.near", "s")
    both = parts.groupBy("gx", "gy", "gz", "axis").agg(F.max(F.when(F.col("near"), F.col("s"))).alias("a"), F.max(F.when(~F.col("near"), F.col("s"))).alias("b"))
    return both.where(F.col("a") != F.col("b")).select("gx", "gy", "gz", "axis", (~F.col("a")).alias("flip"))


def quads(seen: DataFrame, verts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(bx, by, bz, gx, gy, gz, axis, q0..q3): the ring of cells about each crossed edge, where all four have a vertex.

    q are structs (cx, cy, cz, x, y, z, r, g, b); q1 and q3 change places for flipped edges. The edge's voxel names the block.
    """
    ring = []
    for axis in range(3):
        i, j = (axis + 1) % 3, (axis + 2) % 3
        for k, (di, dj) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))):
            o = [0, 0, 0]
            o[i], o[j] = di, dj
            ring.append(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip("xyz", o, strict=True)), F.lit(axis).alias("axis"), F.lit(k).alias("k")))
    edge = sign_edges(seen)
    asked = edge.withColumn("o", F.explode(F.filter(F.array(*ring), lambda o: o["axis"] == F.col("axis"))))
    asked = asked.withColumns({f"c{a}": F.col(f"g{a}") - F.col(f"o.{a}") for a in "xyz"} | {"k": F.col("o.k")})
    met = asked.join(verts.withColumn("v", F.struct("cx", "cy", "cz", "x", "y", "z", "r", "g", "b")).select("cx", "cy", "cz", "v"), ["cx", "cy", "cz"])
    pick = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"p{k}") for k in range(4)]
    full = met.groupBy("gx", "gy", "gz", "axis", "flip").agg(F.count("*").alias("n"), *pick).where("n = 4")
    turn = lambda a, b: F.when(F.col("flip"), F.col(b)).otherwise(F.col(a))
    return full.select(*(cell(F.col(f"g{a}"), cfg.block_dim).alias(f"b{a}") for a in "xyz"), "gx", "gy", "gz", "axis", F.col("p0").alias("q0"), turn("p1", "p3").alias("q1"), F.col("p2").alias("q2"), turn("p3", "p1").alias("q3"))


def block_vertices(found: DataFrame) -> DataFrame:
    """(bx, by, bz, idx, cx.., x.., r..): a block's used vertices, numbered by cell z, y, x."""
    used = found.select("bx", "by", "bz", F.explode(F.array("q0", "q1", "q2", "q3")).alias("v")).select("bx", "by", "bz", "v.*").distinct()
    return used.withColumn("idx", F.row_number().over(Window.partitionBy("bx", "by", "bz").orderBy("cz", "cy", "cx")) - 1)


def seam(verts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Block vertices in the layer of cells before the block, or in its last one, on any axis: other blocks can share them."""
    local = [F.col(f"c{a}") - F.col(f"b{a}") * cfg.block_dim for a in "xyz"]
    return verts.where((F.least(*local) == -1) | (F.greatest(*local) == cfg.block_dim - 1))


def meshes(found: DataFrame) -> DataFrame:
    """(bx, by, bz, positions, colors, indices) as arrays: vertices by number, triangles (q0, q1, q2), (q0, q2, q3) by z, y, x, axis."""
    block = ["bx", "by", "bz"]
    verts = block_vertices(found)
    lists = verts.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y", "z", "r", "g", "b"))).alias("v"))
    number = verts.select(*block, "cx", "cy", "cz", "idx")
    corners = found.select(*block, "gz", "gy", "gx", "axis", F.posexplode(F.array("q0", "q1", "q2", "q3")).alias("k", "q")).select(*block, "gz", "gy", "gx", "axis", "k", F.col("q.cx").alias("cx"), F.col("q.cy").alias("cy"), F.col("q.cz").alias("cz"))
    at = corners.join(number, [*block, "cx", "cy", "cz"])
    pick = [F.max(F.when(F.col("k") == k, F.col("idx"))).alias(f"i{k}") for k in range(4)]
    quad = at.groupBy(*block, "gz", "gy", "gx", "axis").agg(*pick)
    order = quad.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("gz", "gy", "gx", "axis", "i0", "i1", "i2", "i3"))).alias("q"))
    return lists.join(order, block).select(
        *block,
        F.flatten(F.transform("v", lambda v: F.array(v["x"], v["y"], v["z"]))).alias("positions"),
        F.flatten(F.transform("v", lambda v: F.array(v["r"], v["g"], v["b"]))).alias("colors"),
        F.flatten(F.transform("q", lambda q: F.array(q["i0"], q["i1"], q["i2"], q["i0"], q["i2"], q["i3"]))).alias("indices"),
    )
