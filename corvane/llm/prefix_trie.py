"""Prefix tries of conversations, with totals over subtrees by centroid decomposition.

A node is a distinct sequence of first turns. It is named by the exclusive or of its turns' digests,
each of which covers the turn's place, so that a conversation of any length is named in parallel. The
rollup takes the trie apart: in each component the deepest node that holds more than half of the
component's weight is its centroid; the component's total from the centroid down is added to the nodes
from the centroid to the component's top, and the centroid's children and what is left above become
components of their own. Weights halve each round. Components that have become small are taken apart
to the end within a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.ranks import ranked, runs_of, with_runs
from corvane.llm.shared import cut, stored

#: The most nodes of a component that one task takes apart.
TASK_NODES = 5_000
#: Components whose centroids are broadcast at most (about 100 bytes each); beyond, they are joined by shuffle.
MAX_BROADCAST_COMPONENTS = 100_000
#: Ids that are joined to one piece of text at most.
PIECE_IDS = 100_000


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation in order, pos from 1.

    Order is by turn, nulls first, then by role and text; null roles and texts are empty, turns of a
    null conversation belong to none and are left out.
    """
    clean = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    return ranked(clean, ["conv_id"], ["turn", "role", "text"]).select("conv_id", (F.col("pos") + 1).alias("pos"), "role", "text")


def rebuilt_turns(placed: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, origin, pos, role, text) where each conversation c has, before its own turns after its
    first h, the first h of c - c % family (origin 0); h is crc32(c) % most. At most `family`
    conversations take from one, and less than `most` turns each."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    takers = placed.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    heads = placed.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    taken = takers.join(heads, "base").where("pos <= h").select("conv_id", F.lit(0).alias("origin"), "pos", "role", "text")
    return taken.unionByName(placed.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("origin"), "pos", "role", "text"))


def _name(words: list) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))


def prefix_rows(turns: DataFrame, conversations: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, depth, node, parent, chars, length): a row for each first d turns of each conversation, d
    from 0. node names the sequence (16 bytes), parent that of one turn less; chars is the length of its
    last text. A conversation's turns may be spread over partitions."""
    rows, runs = runs_of(turns, ["conv_id"], order)
    ordered = Window.partitionBy("conv_id").orderBy("part")
    runs = runs.select("conv_id", "part", "first", F.coalesce(F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("conv_id")).alias("length"))
    placed = with_runs(rows, runs, ["conv_id"]).select("conv_id", "part", "length", (F.col("at") - F.col("first") + F.col("before") + 1).alias("depth"), "role", "text")
    of = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    words = {f"w{k}": F.conv(F.substring(of, 1 + 15 * k, 15), 16, 10).cast("long") for k in (0, 1)}
    worded = placed.withColumns(words).select("conv_id", "part", "length", "depth", F.length("text").cast("long").alias("chars"), *words)
    # Exclusive or of all words up to each turn: within the run, and of the conversation's earlier runs.
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = worded.withColumns({f"x{k}": F.bit_xor(f"w{k}").over(inside) for k in (0, 1)})
    whole = worded.groupBy("conv_id", "part").agg(*[F.bit_xor(f"w{k}").alias(f"r{k}") for k in (0, 1)])
    earlier = whole.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"r{k}").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias(f"e{k}") for k in (0, 1)])
    both = local.join(earlier, ["conv_id", "part"])
    here = [F.col(f"x{k}").bitwiseXOR(F.col(f"e{k}")) for k in (0, 1)]
    named = both.select("conv_id", "depth", _name(here).alias("node"), _name([x.bitwiseXOR(F.col(f"w{k}")) for k, x in enumerate(here)]).alias("parent"), "chars", "length")
    lengths = runs.groupBy("conv_id").agg(F.first("length").alias("length"))
    zero = F.lit(0).cast("long")
    tops = conversations.join(lengths, "conv_id", "left").select("conv_id", zero.alias("depth"), F.lit(bytes(16)).alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("chars"), F.coalesce("length", zero).alias("length"))
    return named.unionByName(tops)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_COMPONENTS else df


def settle(parents: list[int], own: list[list[int]]) -> list[list[int]]:
    """Totals of each node's subtree in one component, by centroids. parents: earlier places, -1 for the top."""
    out = [[0] * len(x) for x in own]
    waiting = [list(range(len(parents)))]
    while waiting:
        nodes = waiting.pop()
        top, size = nodes[0], dict.fromkeys(nodes, 1)
        for v in reversed(nodes[1:]):
            size[parents[v]] += size[v]
        centroid = next(v for v in reversed(nodes) if 2 * size[v] > size[top])  # the heavy nodes are a path: its last
        heads, totals = {centroid: centroid}, list(own[centroid])
        parts: dict[int, list[int]] = {}
        for v in nodes:
            if v != centroid:
                if parents[v] in heads:
                    heads[v] = v if parents[v] == centroid else heads[parents[v]]
                    totals = [a + b for a, b in zip(totals, own[v], strict=True)]
                parts.setdefault(heads.get(v, -1), []).append(v)
        waiting += parts.values()
        v = centroid
        while True:
            out[v] = [a + b for a, b in zip(out[v], totals, strict=True)]
            if v == top:
                break
            v = parents[v]
    return out


def _settle_tasks(small: DataFrame, values: list[str]) -> DataFrame:
    """(node, values) of components (comp, node, parent, depth, values, sum_ values so far) of bounded size."""
    names = ["node", *values]
    source = small.select("comp", "node", "parent", *[F.col(v).cast("long") for v in values], *[F.col(f"sum_{v}").cast("long") for v in values], "depth")
    schema = source.select(*names).schema

    def finished(rows: list[tuple]) -> pa.RecordBatch:
        at = {r[1]: i for i, r in enumerate(rows)}
        width = len(values)
        totals = settle([-1, *[at[r[2]] for r in rows[1:]]], [list(r[3 : 3 + width]) for r in rows])
        columns = [[r[3 + width + k] + t[k] for r, t in zip(rows, totals, strict=True)] for k in range(width)]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), *[pa.array(c, pa.int64()) for c in columns]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if open_rows and row[0] != open_rows[0][0]:
                    yield finished(open_rows)
                    open_rows = []
                open_rows.append(row)
        if open_rows:
            yield finished(open_rows)

    return source.repartition("comp").sortWithinPartitions("comp", "depth").mapInArrow(run, schema)


def subtree_totals(nodes: DataFrame, rows: DataFrame, values: list[str], task_nodes: int = TASK_NODES) -> DataFrame:
    """(node, values): the sums of the values (long) over each node's subtree, by centroid decomposition.

    nodes: node, parent, depth, rep (a conversation that passes through it), weight (of its subtree) and
    the values; rows: (conv_id, depth, node, parent) of the conversations, which tell a node's ancestors.
    Components of more than task_nodes nodes are split in rounds over all of them at once.
    """
    state = nodes.select(F.lit(bytes(16)).alias("comp"), "node", "parent", "depth", "rep", "weight", *values, *[F.lit(0).cast("long").alias(f"sum_{v}") for v in values])
    found, small = [], []
    kept = state.columns
    while True:
        comps = state.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("whole"), F.min("depth").alias("top")).where(F.col("n") > task_nodes)
        comps = cut(comps.drop("n"))
        n_comps = comps.count()
        if n_comps == 0:
            small.append(state)
            break
        small.append(state.join(_bounded(comps.select("comp"), n_comps), "comp", "left_anti"))
        inside = state.join(_bounded(comps, n_comps), "comp")
        deepest = F.max_by(F.struct("node", "depth", "rep", "weight"), F.struct("depth", "node")).alias("c")
        centroids = cut(inside.where(2 * F.col("weight") > F.col("whole")).groupBy("comp", "top").agg(deepest))
        one = _bounded(centroids.select("comp", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "depth", "weight")]), n_comps)
        # Below the centroid: the ancestor one step under its depth is a child of it, and names the new component.
        looked = rows.select(F.col("conv_id").alias("rep"), (F.col("depth") - 1).alias("c_depth"), F.col("node").alias("child"), F.col("parent").alias("over"))
        marked = state.join(one, "comp").join(looked, ["rep", "c_depth"], "left")
        under = (F.col("depth") > F.col("c_depth")) & F.col("over").eqNullSafe(F.col("c_node"))
        marked = cut(marked.select(*kept, "c_node", "c_weight", F.when(under, F.col("child")).alias("child")))
        holds = F.col("child").isNotNull() | (F.col("node") == F.col("c_node"))
        totals = marked.where(holds).groupBy("comp").agg(*[F.sum(v).alias(f"add_{v}") for v in values])
        totals = _bounded(totals, n_comps)
        done = marked.where(F.col("node") == F.col("c_node")).join(totals, "comp")
        found.append(done.select("node", *[(F.col(f"sum_{v}") + F.col(f"add_{v}")).alias(v) for v in values]))
        # Above it: the places of its own conversation from the component's top on.
        steps = centroids.where("c.depth > top").select(F.col("c.rep").alias("conv_id"), F.explode(F.sequence("top", F.col("c.depth") - 1)).alias("depth"))
        path = steps.join(rows, ["conv_id", "depth"]).select("node", F.lit(True).alias("above"))
        left = marked.where(F.col("node") != F.col("c_node")).join(totals, "comp").join(path, "node", "left")
        above = F.coalesce("above", F.lit(False))
        sums = {f"sum_{v}": F.col(f"sum_{v}") + F.when(above, F.col(f"add_{v}")).otherwise(0) for v in values}
        moved = {"comp": F.coalesce("child", "comp"), "weight": F.col("weight") - F.when(above, F.col("c_weight")).otherwise(0)}
        state = cut(left.withColumns(sums | moved).select(*kept))
    out = _settle_tasks(_all(small), values)
    return out.unionByName(_all(found)) if found else out


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def ids_digests(ids: DataFrame) -> DataFrame:
    """(node, sha256) of (node, conv_id): lowercase hex of the ascending ids, comma-joined.

    The ids are sorted by range, so those of one node may lie in many partitions; each partition makes
    pieces of text of them, and one pass over a node's pieces in order feeds its digest.
    """
    pieces_schema = "node binary, first long, ids string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PIECE_IDS):
                batch = whole.slice(start, PIECE_IDS)
                found: list[list] = []
                for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not found or found[-1][0] != node:
                        found.append([node, conv, []])
                    found[-1][2].append(str(conv))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array([",".join(f[2]) for f in found])], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + text.encode())
                    continue
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "sha256"])

    dealt = ids.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, pieces_schema)
    return dealt.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, sha256 string")


def prefix_trie(turns: DataFrame, family: int = 100, most: int = 6, task_nodes: int = TASK_NODES) -> DataFrame:
    """The trie of the rebuilt conversations of turns (conv_id, turn, role, text), a row for each node.

    conv_id (the least member), depth, parent_conv_id (null for the top), n_convs, n_children, n_leaves
    and saved_tokens (over the node's subtree: see the module), and ends (digest of the ids that end at
    the node; null if none does). Order and nulls: see ordered_turns; repeated turns count each, ties
    are in order of role and text; other columns may have any names; an empty table gives no row.

    A conversation may hold any share of the turns and a node any share of the conversations. Sequences
    are told apart by 120 bits of digests.
    """
    placed = cut(ordered_turns(turns))
    ids = placed.select("conv_id").distinct()
    rows = stored(prefix_rows(rebuilt_turns(placed, family, most), ids, ["origin", "pos"]))
    weight = F.sum(F.col("length") - F.col("depth") + 1)
    found = rows.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"), weight.alias("weight"))
    found = stored(found)
    children = found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")))
    totals = subtree_totals(nodes, rows, ["n_leaves", "saved_tokens"], task_nodes)
    ends = ids_digests(rows.where("depth = length")).select("node", F.col("sha256").alias("ends"))
    over = nodes.select(F.col("node").alias("parent"), F.col("rep").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, "node").join(ends, "node", "left").join(over, "parent", "left")
    return out.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", "ends")
