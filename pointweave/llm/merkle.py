"""A Merkle manifest of a table: a tree per group, a tree over the groups' roots, and a proof for every row.

A leaf is the hash of a row's columns. In each group leaves ascend by key; every ARITY consecutive nodes become their parent, the
last ones of a level too, even one alone, until one node is left: the group's root. These form the last tree in the same way.

Levels are built by windows: partitioned by group and parent index, an ordered collect_list over the full frame gives a node
its run, which is the parent's preimage and holds the node's siblings. One row of each run goes on as the parent. A run has
at most ARITY nodes, so a group that holds most rows is no larger to any task; places in a group come from ranges (operators/rank).
Proofs come down the same levels: a node's path is its run and place, then its parent's path. Every level is an ARITY-th of the
one below, so all of it costs little more than the leaves do.

Defined cases: a null group is a group, before all others; null keys come first; rows alike in all columns are leaves of their own
(which of them stands first makes no difference); rows of one key stand by their leaf's hash; an empty table gives no rows and has no
root. Other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import ranked
from ._common import cut

ARITY = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = ["path", "subroot", "root"]


def tagged(value: Column) -> Column:
    """`-` for null, else its length in UTF-8 bytes, a colon and the value: no two rows give the same text."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(tagged(v) for v in values)), 256)


def lowered(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed; texts without them are not gone through letter by letter."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(text)


def _runs(level: DataFrame) -> DataFrame:
    """level (g, i, h) with p, the index of a node's parent, its run, its place (at) in it, and whether it is its group's last node."""
    own = Window.partitionBy("g", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = level.withColumn("p", F.floor(F.col("i") / F.lit(float(ARITY))).cast("long")).withColumn("run", F.collect_list("h").over(own))
    return out.withColumns({"at": (F.col("i") - F.col("p") * ARITY).cast("int"), "last": (F.col("p") == 0) & (F.size("run") == 1)})


def climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots): leaves (g, i, h) and the levels above them; roots (g, level, h): each group's last node and its level."""
    levels, roots = [leaves], None
    while True:
        runs = _runs(levels[-1].select("g", "i", "h"))
        ends = runs.where("last").select("g", F.lit(len(levels) - 1).alias("level"), "h")
        roots = ends if roots is None else roots.unionByName(ends)
        parents = cut(runs.where("at = 0 and not last").select("g", F.col("p").alias("i"), F.sha2(F.concat_ws("", "run"), 256).alias("h")))
        if parents.isEmpty():
            return levels, cut(roots)
        levels.append(parents)


def descend(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """Leaves with path (runs and places up to the top), subroot and root; ends: (g, level, path, subroot, root) of each group's last node."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        up = ends.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("p"), *_PATH)
        if above is not None:
            up = up.unionByName(above.select("g", F.col("i").alias("p"), *_PATH))
        step = F.array(F.struct(F.concat_ws("", "run").alias("run"), F.col("at").alias("at")))
        above = _runs(levels[k]).join(up, ["g", "p"]).withColumn("path", F.when(F.col("last"), F.col("path")).otherwise(F.concat(step, "path"))).drop("p", "run", "at", "last")
    return above


def _halves(e: Column) -> tuple[Column, Column]:
    """The digests before and after a node's own in its run."""
    return F.substring(e["run"], F.lit(1), e["at"] * 64), F.substring(e["run"], e["at"] * 64 + 65, F.length(e["run"]))


def proof(path: Column) -> Column:
    """The hash of all siblings on a path."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda e: F.concat(*_halves(e)))), 256)


def fold(path: Column, start: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    step = lambda h, e: F.sha2(F.concat(_halves(e)[0], h, _halves(e)[1]), 256)
    return F.aggregate(path, start, step)


def manifest(rows: DataFrame, group: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None, leaf_of: Column | None = None, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(key, kept columns, leaf, path, subroot, root) for every row. keep: further columns by name, made from rows' own.

    leaf_of: the leaf's hash; by default that of all COLUMNS. proof and fold read path.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # never null; the null group comes first
    leaf_of = leaf(*(F.col(c) for c in COLUMNS)) if leaf_of is None else leaf_of
    kept = keep or {}
    flat = rows.select(F.col(key).alias("k"), named.alias("g"), leaf_of.alias("h"), F.monotonically_increasing_id().alias("copy"), *(v.alias(f"keep_{c}") for c, v in kept.items()))
    levels, roots = climb(cut(ranked(flat, ["g"], ["k", "h", "copy"], cut, "i").drop("copy")))
    tops, top = climb(cut(ranked(roots.withColumnsRenamed({"g": "name"}).withColumn("g", F.lit("")), ["g"], ["name"], cut, "i")))
    ends = top.select("g", "level", F.array().cast("array<struct<run:string,at:int>>").alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    groups = cut(descend([tops[0].select("g", "i", "h", "name", F.col("level").alias("of")), *tops[1:]], ends).select(F.col("name").alias("g"), F.col("of").alias("level"), "path", F.col("h").alias("subroot"), "root"))
    out = descend(levels, groups)
    return out.select(F.col("k").alias(key), *(F.col(f"keep_{c}").alias(c) for c in kept), F.col("h").alias("leaf"), *_PATH)


def verified(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest of docs, and for every row the root that follows from it after tampering where `tampered` holds.

    Tampering puts the A-Z of text in lower case; verified says whether the root still comes out.
    """
    columns = [F.col(c) for c in COLUMNS]
    changed = F.when(tampered, leaf(*columns[:-1], lowered(F.col("text"))))
    rows = manifest(docs.select(*COLUMNS), keep={"changed": changed})
    folded = rows.withColumns({"proof_sha256": proof(F.col("path")), "folded_root": fold(F.col("path"), F.coalesce("changed", "leaf"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
