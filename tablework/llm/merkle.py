"""A manifest of a table as a tree of digests, and proofs that a row belongs to it.

Rows are leaves, ranked within their tree; every ``RUN`` consecutive nodes have the digest of their digests as parent. The
manifest is content-addressed: a record says which children a digest has, and nothing else is needed to find a leaf.
Leaf requests descend from the root by the digits of their ranks, to the base ``RUN``. At every level the records are
joined by digest, the child of the next digit is selected and the others are collected; requests with equal digits so far
are one request, so no record is asked for more often than the manifest has its digest. At the leaves the collected
segments are reversed, which gives the siblings from the leaf to the root.

Everything is DataFrame functions; a run is the largest group there is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.llm import common as C
from tablework.session import stage

RUN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_MOST_LEVELS = 21


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value so that no two lists of values read alike: its bytes after their number, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(df: DataFrame, tree: str, *order: str) -> DataFrame:
    """``df`` with ``idx``, the row's place in its tree from 0, and ``n``, the rows of the tree.

    Rows are range-partitioned by tree and order and counted by partition, so a tree of most rows is spread like any other.
    """
    ordered = df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = stage(ordered.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    parts = placed.groupBy(F.col(tree).alias("t"), part.alias("part")).agg(
        F.min("place").alias("first"), F.count("*").alias("rows")
    )
    before = F.sum("rows").over(Window.partitionBy("t").orderBy("part")) - F.col("rows")
    parts = parts.select(
        "t", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("t")).alias("n")
    )
    parts = C.sized(stage(parts, "parts"))
    same = F.col(tree).eqNullSafe(F.col("t")) & (part == F.col("part"))
    return placed.join(parts, same).withColumn("idx", F.col("place") + F.col("shift")).drop("t", "part", "shift", "place")


@dataclass(frozen=True)
class Forest:
    """Trees over ranked leaves: ``levels[k]`` has the nodes ``tree, depth, idx, digest, children`` of height ``k + 1``,
    and ``tops`` the ``tree, depth, digest`` of every tree."""

    levels: list[DataFrame]
    tops: DataFrame


def forest(leaves: DataFrame) -> Forest:
    """Trees over the staged ``leaves``: ``tree, idx, n, digest``. The only leaf of a tree is its top itself."""
    depth = sum((F.when(F.col("n") > RUN**k, 1).otherwise(0) for k in range(_MOST_LEVELS)), F.lit(0))
    nodes = leaves.select("tree", depth.alias("depth"), "idx", "digest")
    deepest = nodes.agg(F.max("depth").alias("depth")).first()["depth"] or 0
    levels, tops = [], nodes.filter("depth = 0").select("tree", "depth", "digest")
    for height in range(1, deepest + 1):
        child = F.struct("idx", "digest")
        runs = nodes.filter(F.col("depth") >= height).groupBy("tree", "depth", F.expr(f"idx div {RUN}").alias("idx"))
        runs = runs.agg(F.array_sort(F.collect_list(child))["digest"].alias("children"))
        runs = runs.select("tree", "depth", "idx", digest(F.array_join("children", "")).alias("digest"), "children")
        nodes = stage(runs, f"level{height}")
        levels.append(nodes)
        tops = tops.unionByName(nodes.filter(F.col("depth") == height).select("tree", "depth", "digest"))
    return Forest(levels, stage(tops, "tops"))


def _segment(children: Column, digit: Column) -> Column:
    """The siblings before and after the child that is selected."""
    place = digit.cast("int")
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), place), "").alias("left"),
        F.array_join(F.slice(children, place + 2, F.lit(RUN)), "").alias("right"),
    )


def _records(level: DataFrame) -> DataFrame:
    """The children of each digest; equal runs of leaves share a record."""
    held = level.groupBy(F.col("digest").alias("key")).agg(F.any_value("children").alias("children"))
    return F.broadcast(held) if C.fits(level) else held


def descended(trees: Forest, start: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (``tree, idx`` and more) with ``path``: what was collected on the way to each leaf, from ``start``,
    the ``tree, path`` that each tree begins with."""
    tree = start.select(F.col("tree").alias("of"), "path")
    at = trees.tops.join(C.sized(stage(tree, "start")), F.col("tree").eqNullSafe(F.col("of"))).drop("of")
    at = at.select("tree", F.col("depth").alias("height"), F.lit(0).cast("long").alias("idx"), "digest", "path")
    for height in range(len(trees.levels), 0, -1):
        here = (F.col("digest") == F.col("key")) & (F.col("height") == height)
        at = at.join(_records(trees.levels[height - 1]), here, "left").drop("key")
        if height == 1:
            break
        down = F.transform(
            "children",
            lambda c, i: F.struct(
                (F.col("idx") * RUN + i).alias("idx"),
                c.alias("digest"),
                F.array_append("path", _segment(F.col("children"), i)).alias("path"),
            ),
        )
        stay = F.array(F.struct("idx", "digest", "path"))
        moved = F.col("children").isNotNull()
        at = at.select(
            "tree",
            F.when(moved, F.col("height") - 1).otherwise(F.col("height")).alias("height"),
            F.explode(F.when(moved, down).otherwise(stay)).alias("next"),
        ).select("tree", "height", "next.idx", "next.digest", "next.path")
    if not trees.levels:
        at = at.withColumn("children", F.lit(None).cast("array<string>"))
    runs = at.select(F.col("tree").alias("of"), F.col("idx").alias("run"), "children", "path")
    place = F.col("of").eqNullSafe(F.col("tree")) & (F.col("run") == F.expr(f"idx div {RUN}"))
    last = F.when(
        F.col("children").isNotNull(), F.array_append("path", _segment(F.col("children"), F.col("idx") % RUN))
    ).otherwise(F.col("path"))
    return requests.join(runs, place).withColumn("path", last).drop("of", "run", "children")


def siblings(path: Column) -> Column:
    """The collected digests from the leaf to the root, joined."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of ``path``."""
    return F.aggregate(F.reverse(path), leaf, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (``tree, idx, n, digest`` and what else they were made with), a tree per group, and one over these."""

    leaves: DataFrame
    groups: Forest
    ranks: DataFrame
    top: Forest

    def records(self) -> DataFrame:
        """All ``digest, children`` of the manifest."""
        levels = [level.select("digest", "children") for level in [*self.groups.levels, *self.top.levels]]
        empty = self.leaves.select("digest", F.array("digest").alias("children")).limit(0)
        out = empty
        for level in levels:
            out = out.unionByName(level)
        return out.groupBy("digest").agg(F.any_value("children").alias("children"))

    def root(self) -> DataFrame:
        return self.top.tops.select(F.col("digest").alias("root"))


def manifest(leaves: DataFrame, group: str, *order: str) -> Manifest:
    """The manifest of ``leaves`` with a column ``digest``: a tree for each value of ``group``, null being one, whose
    leaves are in ``order``, and a tree over the tops of these."""
    ranks = stage(ranked(leaves.withColumnRenamed(group, "tree"), "tree", *order), "leaves")
    groups = forest(ranks)
    tops = groups.tops.select(F.lit(0).alias("tree"), F.col("tree").alias("group"), "digest")
    tops = stage(ranked(tops, "tree", "group"), "tops")
    return Manifest(ranks, groups, tops, forest(tops))


def proven(made: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (``tree, idx`` and more) with their ``path`` to the root, the top of their tree and the root."""
    start = made.top.tops.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    root = made.top.tops.select(F.col("tree").alias("of"), F.col("digest").alias("root"))
    above = descended(made.top, start, made.ranks).join(F.broadcast(root), F.col("tree") == F.col("of")).drop("of")
    above = stage(above.select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "above")
    found = descended(made.groups, above.select("tree", "path"), requests)
    tops = above.select(F.col("tree").alias("of"), "subroot", "root")
    return found.join(C.sized(stage(tops, "roots")), F.col("of").eqNullSafe(F.col("tree"))).drop("of")


def leaf(text: Column) -> Column:
    return digest(F.concat(*[encoded(text if name == "text" else col(name)) for name in FIELDS]))


def verified(docs: DataFrame, presented_text: Column | None = None) -> DataFrame:
    """Every row against the manifest of all: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``presented_text`` is the text that each row shows when it asks for its proof, ``text`` itself unless given. Leaves
    of one ``lang`` ascend by ``doc_id``, a null one first, and by digest where ids repeat; equal rows are leaves of
    their own, in any order. Null and empty values have digests of their own. Languages without rows have no tree, and an
    empty table has no root and no rows. Columns beyond ``FIELDS`` are not read.
    """
    shown = col("text") if presented_text is None else presented_text
    text = leaf(col("text"))
    rows = docs.select(
        "doc_id",
        "lang",
        text.alias("digest"),
        F.when(shown.eqNullSafe(col("text")), text).otherwise(leaf(shown)).alias("presented"),
        F.monotonically_increasing_id().alias("row"),
    )
    made = manifest(stage(rows, "rows"), "lang", "doc_id", "digest", "row")
    found = proven(made, made.leaves.select("tree", "idx", "doc_id", "digest", "presented"))
    back = folded(F.col("presented"), F.col("path"))
    return found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        digest(siblings(F.col("path"))).alias("proof_sha256"),
        back.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_if(docs_text: Column, condition: Column) -> Column:
    """The text with A-Z in lower case where the condition holds."""
    return F.when(condition, C.lower_ascii(docs_text)).otherwise(docs_text)
