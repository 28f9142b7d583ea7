"""A Merkle manifest of a table: a hash tree for each partition value, one over their roots, a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passel.llm.tables import checkpoint

FAN = 2
# Levels of a tree that one block nests: a block has FAN ** LEVELS nodes at its bottom, whatever the table's size.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PLACE_BITS = 33


def encoded(value: Column) -> Column:
    """A field as its UTF-8 length, a colon and itself, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank``, the place in its tree from 0, and ``n``, the nodes of that tree.

    The rows are range-partitioned, a last key parts equal ones, and stored sorted. The rows of each tree in
    each partition, at most one for each partition and tree, give the offsets; they meet their rows in a join by
    both, whose large partitions adaptive execution can split.
    """
    keys = [F.col(c) for c in ["tree", *order]]
    salted = nodes.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys, "salt")
    stored = checkpoint(salted.sortWithinPartitions(*keys, "salt").drop("salt").withColumn("at", F.monotonically_increasing_id()))
    stored = stored.withColumn("part", F.shiftright("at", _PLACE_BITS))
    counts = stored.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"), "first",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    met = stored.join(offsets, stored["tree"].eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part")))
    return met.withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before", "_tree", "_part")


def _blocks(nodes: DataFrame, level: int, fan: int, levels: int) -> DataFrame:
    """Nodes (tree, n, rank, node) of one level as blocks (tree, n, rank, node), nested ``levels`` levels higher.

    Each rank is a block number and digits. All rows of a block are dealt to one task; there the digit columns are
    grouped away one after the other, the lowest first, and the structs of what a group held become the children of
    its struct. The groups of each step are runs of the sort for the first, so nothing is sorted or shuffled again.
    """
    digits = [F.floor(F.col("rank") / fan**k).cast("long") % fan for k in range(levels)]
    rows = nodes.select(
        "tree", "n", F.floor(F.col("rank") / fan**levels).cast("long").alias("block"), "node", *[d.alias(f"d{k}") for k, d in enumerate(digits)]
    ).repartition("tree", "block")
    for k in range(levels):
        keys = ["tree", "n", "block", *[f"d{j}" for j in range(levels - 1, k, -1)]]
        each = [F.first(F.when(F.col(f"d{k}") == d, F.col("node")), ignorenulls=True) for d in range(fan)]
        grouped = rows.groupBy(*keys).agg(*[e.alias(f"c{d}") for d, e in enumerate(each)])
        kids = F.filter(F.array(*[F.col(f"c{d}") for d in range(fan)]), lambda c: c.isNotNull())
        whole = F.sha2(F.concat(*[F.coalesce(F.col(f"c{d}.h"), F.lit("")) for d in range(fan)]), 256)
        # A tree that has come to one node is not hashed again.
        own = F.when(F.col("n") > fan ** (level + k), whole).otherwise(F.col("c0.h"))
        rows = grouped.select(*keys, F.struct(own.alias("h"), kids.alias("kids")).alias("node"))
    return rows.withColumnRenamed("block", "rank")


def _hashes(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda c: c["h"]), "")


def _step(kids: Column, i: Column, path: Column, real: Column) -> Column:
    """``path`` with what stands beside child ``i`` put before it."""
    beside = F.struct(_hashes(F.slice(kids, 1, i)).alias("left"), _hashes(F.slice(kids, i + 2, F.size(kids))).alias("right"))
    return F.when(real, F.concat(F.array(beside), path)).otherwise(path)


def _unfolded(blocks: DataFrame, level: int, fan: int, levels: int) -> DataFrame:
    """The bottom nodes of blocks (tree, n, rank, node, path) as (tree, n, rank, node, path): one transform and one explode."""

    def down(node: Column, k: int, rank: Column, path: Column) -> Column:
        if k == 0:
            return F.array(F.struct(rank.alias("rank"), node.alias("node"), path.alias("path")))
        kids, real = node["kids"], F.col("n") > fan ** (level + k - 1)
        return F.flatten(F.transform(kids, lambda c, i: down(c, k - 1, rank * fan + i, _step(kids, i, path, real))))

    found = blocks.select("tree", "n", F.explode(down(F.col("node"), levels, F.col("rank"), F.col("path"))).alias("one"))
    return found.select("tree", "n", "one.*")


def _met(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Each block with the path above it: both are grouped by their place, a row each."""
    both = blocks.unionByName(paths.select("tree", "rank", "path"), allowMissingColumns=True)
    one = {c: F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path")}
    return both.groupBy("tree", "rank").agg(*one.values())


def _tree(nodes: DataFrame, fan: int, levels: int) -> list[tuple[DataFrame, int]]:
    """Rollups of ranked nodes, from the bottom up to one block for each tree, each with the level of its bottom."""
    # One number: the nodes of the largest tree.
    size = nodes.agg(F.max("n")).first()[0] or 0
    rounds, level = [], 0
    while True:
        nodes = checkpoint(_blocks(nodes, level, fan, levels))
        rounds.append((nodes, level))
        level += levels
        if fan**level >= size:
            return rounds
        nodes = nodes.select("tree", "n", "rank", F.struct(F.col("node.h").alias("h")).alias("node"))


def _paths(rounds: list[tuple[DataFrame, int]], tops: DataFrame, fan: int, levels: int) -> DataFrame:
    """(tree, n, rank, node, path) of the bottom nodes; ``tops`` (tree, rank, path) are the paths above the trees."""
    for blocks, level in reversed(rounds):
        tops = _unfolded(_met(blocks, tops), level, fan, levels)
    return tops


def merkle_manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", tampered: Column | None = None,
    tampered_fields: dict[str, Column] | None = None, fan: int = FAN, levels: int = LEVELS,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, ``path`` (hashes left and right of it, from the
    leaf up to the root), proof_sha256, folded_root and verified.

    A leaf is the SHA-256 of the ``fields``. The leaves of each value of ``tree_col``, by id, form a tree whose nodes
    hash up to ``fan`` nodes below; the roots of all trees, null first, then bytewise, form another. Rows where
    ``tampered`` holds are folded from a leaf with the columns of ``tampered_fields`` in place of the true ones.

    Null ids come first. Rows of the same id follow one another by their leaf; equal rows are leaves of their own,
    each with a proof. A tree of one leaf has that leaf as its root. An empty table has no rows. Columns beyond the
    fields play no part, whatever their names. A text is hashed whole, in the scan, and shuffled by none of the steps.

    A third of all rows may lie in one tree: ranks come from a range partitioning by tree and id, and blocks hold
    ``fan ** levels`` nodes at most. Only structs of block size are nested; of the levels above, one row a block
    meets the block in a grouping.
    """
    given = {f: F.col(f"`{f}`") for f in fields}
    leaf = leaf_hash(*given.values())
    other = leaf
    if tampered is not None:
        other = F.when(tampered, leaf_hash(*(given | (tampered_fields or {})).values())).otherwise(leaf)
    leaves = docs.select(F.col(f"`{tree_col}`").alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf.alias("h"), other.alias("other"))
    # The other leaf is kept where it differs.
    leaves = leaves.withColumn("other", F.when(F.col("other") != F.col("h"), F.col("other")))
    ranked = _ranked(leaves, ["id", "h"]).select("tree", "n", "rank", F.struct("h", "id", "other").alias("node"))
    trees = _tree(ranked, fan, levels)
    roots = trees[-1][0].select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("node.h").alias("h"))
    named = _ranked(roots, ["name"]).select("tree", "n", "rank", F.struct("h", "name").alias("node"))
    crown = _tree(named, fan, levels)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    peak = crown[-1][0].select("tree", "rank", empty.alias("path"))
    above = _paths(crown, peak, fan, levels)
    tops = above.select(F.col("node.name").alias("tree"), F.lit(0).cast("long").alias("rank"), "path")
    found = _paths(trees, tops, fan, levels)

    def fold(path: Column, start: Column) -> Column:
        return F.aggregate(path, start, lambda done, s: F.sha2(F.concat(s["left"], done, s["right"]), 256))

    # A tree's own part of a path is as long as it has levels; what follows is of the tree of roots.
    own, depth = F.lit(0), 0
    largest = ranked.agg(F.max("n")).first()[0] or 0
    while fan**depth < largest:
        own = own + (F.col("n") > fan**depth).cast("int")
        depth += 1
    subroot = fold(F.slice("path", 1, own), F.col("leaf"))
    folded = found.select(
        F.col("node.id").alias("doc_id"), F.col("node.h").alias("leaf"), "path", "n", F.coalesce("node.other", "node.h").alias("start")
    ).select(
        "doc_id", "leaf", subroot.alias("subroot"), fold(F.col("path"), F.col("leaf")).alias("root"), "path",
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"),
        fold(F.col("path"), F.col("start")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
