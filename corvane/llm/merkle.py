"""Merkle manifests of a dataset: one tree for each source, and one over the sources' roots.

Only every third level of a tree is persisted. A stored level holds its digests in aligned blocks of
27, the leaves of a subtree of three levels. Proof extraction goes from the top to the leaves: each
block makes its two missing interior levels again, gives its members their siblings, followed by
those of the block's own top, and keeps none of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.ranks import ranked
from corvane.llm.shared import col, stored

#: Nodes of a run that become their parent, and levels of which one is stored.
ARITY, SPAN = 3, 3
BLOCK = ARITY**SPAN
#: More levels than any table's count of rows (a long) can need.
MOST_LEVELS = 40


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(values: list[Column]) -> Column:
    """Of the values' text forms, each headed by its length in bytes; a null is a dash."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _height(rows: Column) -> Column:
    """Levels above the leaves of a tree: its runs are joined until one node is left."""
    powers = F.array(*[F.lit(ARITY**k) for k in range(MOST_LEVELS) if ARITY**k < 1 << 63])
    return F.size(F.filter(powers, lambda p: p < rows))


def _parents(digests: Column) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / ARITY).cast("int"))
    return F.transform(starts, lambda r: F.sha2(F.array_join(F.slice(digests, r * ARITY + 1, ARITY), ""), 256))


def _siblings(digests: Column, at: Column) -> Column:
    """The run's digests left and right of a place, as hex text."""
    within = at % ARITY
    return F.struct(F.array_join(F.slice(digests, at - within + 1, within), "").alias("left"), F.array_join(F.slice(digests, at + 2, ARITY - 1 - within), "").alias("right"))


def _levels_of(blocks: DataFrame, level: int) -> DataFrame:
    """Blocks with all digests of their levels again: d0 (stored), d1 and d2; steps: levels to the block's top."""
    made = blocks.withColumn("d0", F.col("members.digest")).withColumn("d1", _parents(F.col("d0"))).withColumn("d2", _parents(F.col("d1")))
    return made.withColumn("steps", F.least(F.lit(SPAN), F.col("height") - level))


def _top() -> Column:
    d = [F.col(f"d{k}") for k in range(SPAN)]
    inner = F.when(F.col("steps") == 0, d[0][0]).when(F.col("steps") == 1, d[1][0]).when(F.col("steps") == 2, d[2][0])
    return inner.otherwise(_parents(d[2])[0])


@dataclass
class Manifest:
    """levels: the stored blocks of levels 0, 3, 6, ... (tree, height, block, members); tops: (tree, height, top)."""

    levels: list[DataFrame]
    tops: DataFrame


def _grow(leaves: DataFrame, order: list[str]) -> Manifest:
    """leaves: tree, digest and what is carried along; each tree's leaves are taken in this order."""
    carried = [c for c in leaves.columns if c != "tree"]
    nodes = ranked(leaves, ["tree"], order).withColumn("height", _height(F.col("total"))).drop("total")
    levels, tops, level = [], None, 0
    while True:
        block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
        members = F.array_sort(F.collect_list(F.struct("pos", *(carried if level == 0 else ["digest"]))))  # 27 at most
        blocks = stored(nodes.groupBy("tree", "height", block).agg(members.alias("members")))
        levels.append(blocks)
        whole = _levels_of(blocks, level).select("tree", "height", F.col("block").alias("pos"), _top().alias("digest"))
        done = whole.where(F.col("height") <= level + SPAN).select("tree", "height", F.col("digest").alias("top"))
        tops = done if tops is None else tops.unionByName(done)
        highest = blocks.agg(F.max("height")).first()[0]
        level += SPAN
        if highest is None or highest <= level:
            return Manifest(levels, tops)
        nodes = whole.where(F.col("height") > level)


def _descend(manifest: Manifest, above: DataFrame) -> DataFrame:
    """The leaves of all trees with path: siblings from the leaf to the tree's top, then those of above.

    above: (tree, height, top, path) with what lies over each tree.
    """
    from_blocks = None
    for k in reversed(range(len(manifest.levels))):
        level = k * SPAN
        low = F.lit(-1) if level == 0 else F.lit(level)
        paths = above.where((F.col("height") > low) & (F.col("height") <= level + SPAN)).select("tree", F.lit(0).cast("long").alias("block"), "top", "path")
        if from_blocks is not None:
            paths = paths.unionByName(from_blocks.select("tree", F.col("pos").alias("block"), "top", "path"))
        paths = paths.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "top", F.col("path").alias("over"))
        blocks = _levels_of(manifest.levels[k], level)
        joined = blocks.join(paths, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))

        def own(m, j):
            places = [j, F.floor(j / ARITY).cast("int"), F.floor(j / ARITY**2).cast("int")]
            inside = F.slice(F.array(*[_siblings(F.col(f"d{s}"), p) for s, p in enumerate(places)]), F.lit(1), F.col("steps"))
            return F.struct(m.alias("m"), F.concat(inside, F.col("over")).alias("path"))

        exploded = joined.select("tree", "top", F.explode(F.transform("members", own)).alias("e"))
        from_blocks = exploded.select("tree", "top", "e.m.*", "e.path")
    return from_blocks


def prove(docs: DataFrame, fields: list[str], tree: str, order: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """(tree and order columns, leaf, subroot, root, path and the carried columns) of each row.

    A leaf is the digest of the fields; a tree's leaves are in order of the order column (nulls first,
    then by leaf), and the trees' tops in order of the tree column (nulls first, bytewise) are the
    leaves of the tree whose top is root. path: the siblings (left, right as joined hex text) of each
    level from the leaf to the root; fold(leaf, path) gives the root. carry: further columns by name,
    computed from docs. A null is a value of its own in every column; repeated rows are leaves each; an
    empty table gives no row. Other columns of docs may have any names and are left out.

    A tree may hold any share of the rows: places come from range partitions, and every later join is
    by tree and block of 27. Level tables are written to the shared folder, each 1/27 of the one below.
    """
    extra = carry or {}
    leaves = docs.select(col(tree).alias("tree"), col(order).alias("row_order"), leaf_digest([col(c) for c in fields]).alias("digest"), *[c.alias(f"x_{n}") for n, c in extra.items()])
    leaves = stored(leaves)
    trees = _grow(leaves, ["row_order", "digest"])
    tops = stored(trees.tops)
    forest = _grow(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"), F.col("height").alias("below")), ["name"])
    root = forest.tops.first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = _descend(forest, forest.tops.select("tree", "height", "top", none.alias("path")))
    above = over.select(F.col("name").alias("tree"), F.col("below").alias("height"), F.col("digest").alias("top"), "path")
    found = _descend(trees, above)
    return found.select(
        F.col("tree").alias(tree),
        F.col("row_order").alias(order),
        F.col("digest").alias("leaf"),
        F.col("top").alias("subroot"),
        F.lit(root["top"] if root else None).cast("string").alias("root"),
        "path",
        *[F.col(f"x_{n}").alias(n) for n in extra],
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda a, s: digest(s["left"], a, s["right"]))


def path_digest(path: Column) -> Column:
    """The digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
