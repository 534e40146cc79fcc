"""Signs of estimated normals: an oracle read from the base field, then propagation along a graph of near bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BASE, NORMAL_ONE, Config
from ..functions.columns import cell, offsets
from ..plans.lineage import Scratch
from .bins import KEY
from .rank import ranked

GROUP = ["seg", "level"]


def undecided(bins: DataFrame, cfg: Config = Config()) -> DataFrame:
    """bins with need: not fixed and not steep enough to be a seed."""
    return bins.withColumn("need", ~(F.col("fixed") | (F.abs(F.col("nz")) >= cfg.seed_nz * NORMAL_ONE)))


def edges(bins: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(seg, level, src key, dst key, dst_need, v): from undecided bins to all within the radius; v is the agreement.

    Where two normals are nearly at right angles, the first is reflected in the plane between the bins.
    """
    r = cfg.orient_radius
    b = undecided(bins, cfg).withColumn("o", F.struct("kx", "ky", "kz", "px", "py", "pz", "nx", "ny", "nz"))
    # in blocks twice as wide as the radius a bin reaches two an axis, so eight copies of it meet all its neighbours once
    src = b.where("need").select(*GROUP, F.col("o").alias("s"), F.explode(F.array(*offsets(0, 1, "dx", "dy", "dz"))).alias("d"))
    src = src.select(*GROUP, "s", *((cell(F.col(f"s.k{a}") - r, 2 * r) + F.col(f"d.d{a}")).alias(f"b{a}") for a in "xyz"))
    dst = b.select(*GROUP, F.col("o").alias("t"), F.col("need").alias("dst_need"), *(cell(F.col(f"k{a}"), 2 * r).alias(f"b{a}") for a in "xyz"))
    gap = [F.abs(F.col(f"t.k{a}") - F.col(f"s.k{a}")) for a in "xyz"]
    met = src.join(dst, [*GROUP, "bx", "by", "bz"]).where((gap[0] <= r) & (gap[1] <= r) & (gap[2] <= r) & (gap[0] + gap[1] + gap[2] > 0))
    one = float(NORMAL_ONE)
    n = {a: F.col(f"s.n{a}") / one for a in "xyz"}
    m = {a: F.col(f"t.n{a}") / one for a in "xyz"}
    e = {a: F.col(f"t.p{a}") - F.col(f"s.p{a}") for a in "xyz"}
    dot = lambda x, y: x["x"] * y["x"] + x["y"] * y["y"] + x["z"] * y["z"]
    e2 = dot(e, e)
    plain = dot(n, m)
    mirrored = plain - F.try_divide(2 * dot(n, e) * dot(m, e), e2)
    v = F.when((F.abs(plain) < cfg.crease) & (e2 > 0), mirrored).otherwise(plain)
    return met.select(*GROUP, *(F.col(f"s.k{a}").alias(f"sk{a}") for a in "xyz"), *(F.col(f"t.k{a}").alias(f"tk{a}") for a in "xyz"), "dst_need", F.round(v, 6).alias("v"))


def seed_edges(graph: DataFrame) -> DataFrame:
    """For each undecided bin the decided neighbour it trusts most, min(|v|, 1); the first in cell order of equals."""
    src = [*GROUP, "skx", "sky", "skz"]
    best = Window.partitionBy(*src).orderBy(F.least(F.abs("v"), F.lit(1.0)).desc(), "tkx", "tky", "tkz")
    return graph.where(~F.col("dst_need")).withColumn("rn", F.row_number().over(best)).where("rn = 1").select(*src, "tkx", "tky", "tkz", "v")


def components(graph: DataFrame, nodes: DataFrame, cut) -> DataFrame:  # noqa: ANN001
    """(seg, level, kx, ky, kz, cx, cy, cz): the least cell of each undecided bin's connected component.

    Labels take the least of their neighbours' and jump to their label's own label until nothing changes. cut truncates
    lineage (a checkpoint).
    """
    key = F.struct("kx", "ky", "kz")
    links = cut(graph.where("dst_need").select(*GROUP, F.struct(*(F.col(f"sk{a}").alias(f"k{a}") for a in "xyz")).alias("s"), F.struct(*(F.col(f"tk{a}").alias(f"k{a}") for a in "xyz")).alias("t")))
    labels = cut(undecided(nodes).where("need").select(*GROUP, key.alias("key"), key.alias("label")))
    while True:
        near = links.join(labels.select(*GROUP, F.col("key").alias("t"), "label"), [*GROUP, "t"]).groupBy(*GROUP, F.col("s").alias("key")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, [*GROUP, "key"], "left").select(*GROUP, "key", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(*GROUP, F.col("key").alias("label"), F.col("label").alias("far"))
        new = cut(hooked.join(jump, [*GROUP, "label"], "left").select(*GROUP, "key", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select(*GROUP, "key.*", *(F.col(f"label.k{a}").alias(f"c{a}") for a in "xyz"))
        labels = new.select(*GROUP, "key", "label")


ROOT = -1  # stands for all seeds


def _least(rows: DataFrame, by: list[str], *more: str) -> DataFrame:
    """The first link in (cost, lo, hi) for each value of by."""
    return rows.groupBy(*by).agg(F.min(F.struct("cost", "lo", "hi", *more)).alias("e")).select(*by, "e.*")


def _odd(*signs: str) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out != F.coalesce(F.col(s), F.lit(False))
    return out


def _shortened(hooks: DataFrame, keep) -> DataFrame:  # noqa: ANN001
    """hooks (a, p, odd) with every a pointing to the end of its chain; ends point to themselves or are not in a. odd adds up on the way."""
    while True:
        for _ in range(2):
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("pp"), F.col("odd").alias("up"))
            hooks = hooks.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), _odd("odd", "up").alias("odd"), (F.coalesce("pp", "p") == F.col("p")).alias("done"))
        hooks = keep(hooks)
        if hooks.where(~F.col("done")).isEmpty():
            return hooks.drop("done")


def spanning_signs(links: DataFrame, seeds: DataFrame, keep) -> DataFrame:  # noqa: ANN001
    """(a, top, odd): the sign of every linked a against its tree's top: ROOT, or a member of the tree if it has no seed.

    links (a, b, cost, lo, hi, odd): undirected, both ways round; odd: the two differ in sign; (cost, lo, hi) orders links and names them.
    seeds (a, cost, lo, hi, odd): links to ROOT, one for an a at most. The tree is the minimum spanning tree in that order, by
    Boruvka's rounds: every fragment chooses its first link, the fragments that so hang together become one, parallel links
    between two fragments are one from then on. Fragments halve with each round at least, so all rounds together move about as
    many rows as the first; what a fragment's members are to it is put together at the end, from the last round to the first.
    What reaches a seed is decided: its links are seeds for the others, so no fragment grows around ROOT. keep writes a table and
    reads it (plans.lineage.Scratch).
    """
    rounds = []
    while not links.isEmpty():
        picks = keep(_least(links.unionByName(seeds.withColumn("b", F.lit(ROOT).cast("long"))), ["a"], "b", "odd"))
        back = picks.select(F.col("a").alias("b"), F.col("b").alias("back"))
        # of two that choose each other (the same link, as links are in strict order) the smaller one stays
        stays = F.coalesce((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.lit(False))
        hooks = picks.join(back, "b", "left").select("a", F.when(stays, F.col("a")).otherwise(F.col("b")).alias("p"), (F.col("odd") & ~stays).alias("odd"))
        to = _shortened(hooks, keep)
        rounds.append(to)
        here, there = (to.select(F.col("a").alias(x), F.col("p").alias(f"n{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
        moved = links.join(here, "a").join(there, "b").where((F.col("na") != F.col("nb")) & (F.col("na") != ROOT))
        moved = keep(_least(moved.select(F.col("na").alias("a"), F.col("nb").alias("b"), "cost", "lo", "hi", _odd("odd", "oa", "ob").alias("odd")), ["a", "b"], "odd"))
        held = seeds.join(here, "a").where(F.col("na") != ROOT).select(F.col("na").alias("a"), "cost", "lo", "hi", _odd("odd", "oa").alias("odd"))
        seeds = keep(_least(held.unionByName(moved.where(F.col("b") == ROOT).drop("b")), ["a"], "odd"))
        links = moved.where(F.col("b") != ROOT)
    found = seeds.select("a", F.lit(ROOT).cast("long").alias("top"), "odd")
    for to in reversed(rounds):
        above = found.select(F.col("a").alias("p"), "top", F.col("odd").alias("up"))
        found = keep(to.join(above, "p", "left").select("a", F.coalesce("top", "p").alias("top"), _odd("odd", "up").alias("odd")))
    return found


def propagate(bins: DataFrame, graph: DataFrame, cut, cfg: Config = Config()) -> DataFrame:  # noqa: ANN001
    """(seg, level, kx, ky, kz, flip) for every undecided bin.

    Signs follow a maximum spanning forest that grows from the seeds, most trusted link first (then the one whose bins come first in
    cell order, seeds before all). A component without a seed starts at its steepest bin, made to point up. Links of no agreement at
    all (v = 0) carry no sign and link nothing.
    """
    nodes = cut(ranked(undecided(bins, cfg).where("need").select(*KEY, "nz"), [], KEY, cut, "id"))
    src, dst = (nodes.select(*GROUP, *(F.col(f"k{x}").alias(f"{e}k{x}") for x in "xyz"), F.col("id").alias(i)) for e, i in (("s", "a"), ("t", "b")))
    cost = (-F.least(F.abs("v"), F.lit(1.0))).alias("cost")
    inner = graph.where(F.col("dst_need") & (F.col("v") != 0)).join(src, [*GROUP, "skx", "sky", "skz"]).join(dst, [*GROUP, "tkx", "tky", "tkz"])
    links = cut(inner.select("a", "b", cost, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("v") < 0).alias("odd")))
    seeds = seed_edges(graph.where(F.col("v") != 0)).join(src, [*GROUP, "skx", "sky", "skz"])
    seeds = cut(seeds.select("a", cost, F.lit(ROOT).cast("long").alias("lo"), F.col("a").alias("hi"), (F.col("v") < 0).alias("odd")))
    with Scratch(bins.sparkSession) as scratch:
        found = cut(spanning_signs(links, seeds, scratch.keep).withColumnRenamed("a", "id"))
    signs = nodes.join(found, "id", "left").withColumn("top", F.coalesce("top", "id"))
    free = signs.where(F.col("top") != ROOT).groupBy("top").agg(F.max(F.struct(F.abs("nz").alias("h"), (-F.col("id")).alias("first"), (F.col("nz") < 0).alias("down"), "odd")).alias("start"))
    free = free.select("top", _odd("start.down", "start.odd").alias("turn"))
    return signs.join(free, "top", "left").select(*KEY, _odd("odd", "turn").alias("flip"))


def flipped(bins: DataFrame, flips: DataFrame) -> DataFrame:
    """bins with the normals turned that flips says."""
    turn = F.when(F.coalesce("flip", F.lit(False)), -1).otherwise(1)
    joined = bins.join(flips, KEY, "left")
    return joined.withColumns({f"n{a}": F.col(f"n{a}") * turn for a in "xyz"}).drop("flip")


def base_agreement(bins: DataFrame, field: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(seg, level, kx, ky, kz, a): half the rise of the base distance from p - 1.5 voxel n to p + 1.5 voxel n, per length, in -1..1.

    The distance is trilinear over eight observed voxels of the base layer; without all of them on both sides there is no row.
    """
    h = 1.5 * cfg.voxel
    base = field.where((F.col("layer") == BASE) & (F.col("w") >= cfg.min_weight_units)).select("gx", "gy", "gz", (F.col("wd") / F.col("w") / 1000.0).alias("d"))
    corners = F.array(*(F.struct(F.lit(float(s)).alias("s"), *(F.lit(v).cast("long").alias(n) for n, v in zip("xyz", (i & 1, i >> 1 & 1, i >> 2 & 1), strict=True))) for s in (-1, 1) for i in range(8)))
    asked = bins.where(~F.col("fixed")).select(*KEY, "px", "py", "pz", "nx", "ny", "nz", F.explode(corners).alias("o"))
    u = {a: (F.col(f"p{a}") + F.col("o.s") * h * (F.col(f"n{a}") / float(NORMAL_ONE))) / float(cfg.voxel) for a in "xyz"}
    asked = asked.withColumns({f"u{a}": v for a, v in u.items()})
    weight = F.lit(1.0)
    for a in "xyz":
        part = F.col(f"u{a}") - F.floor(f"u{a}")
        weight = weight * F.when(F.col(f"o.{a}") == 1, part).otherwise(1.0 - part)
    asked = asked.select(*KEY, F.col("o.s").alias("s"), *((F.floor(f"u{a}") + F.col(f"o.{a}")).cast("long").alias(f"g{a}") for a in "xyz"), weight.alias("wt"))
    # whole numbers add up alike in any order
    term = F.round(F.col("wt") * F.col("d") * F.col("s") * 1000000.0).cast("long")
    met = asked.join(base, ["gx", "gy", "gz"]).groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(term).alias("rise")).where("n = 16")
    return met.select(*KEY, F.round(F.least(F.greatest(F.col("rise") / (2 * h * 1000000.0), F.lit(-1.0)), F.lit(1.0)), 6).alias("a"))


def apply_oracle(bins: DataFrame, answers: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Bins with a sure answer (|a| >= oracle_min) take its sign and are fixed."""
    sure = F.coalesce(F.abs(F.col("a")) >= cfg.oracle_min, F.lit(False)) & ~F.col("fixed")
    turn = F.when(sure & (F.col("a") < 0), -1).otherwise(1)
    return bins.join(answers, KEY, "left").withColumns({f"n{a}": F.col(f"n{a}") * turn for a in "xyz"} | {"fixed": F.col("fixed") | sure}).drop("a")


def orient(bins: DataFrame, cut, field: DataFrame | None = None, mode: str = "propagate", cfg: Config = Config()) -> DataFrame:  # noqa: ANN001
    """The whole step: oracle (with a field), then propagation (mode "propagate") or none ("up")."""
    if field is not None:
        bins = cut(apply_oracle(bins, base_agreement(bins, field, cfg), cfg))
    if mode == "up" or undecided(bins, cfg).where("need").isEmpty():
        return bins
    return flipped(bins, propagate(bins, cut(edges(bins, cfg)), cut, cfg))
