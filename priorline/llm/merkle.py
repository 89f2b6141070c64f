"""A Merkle manifest of a table: one hash tree for each value of a column, and one over their roots.

A leaf is a digest of a row. Within a tree leaves come in the order of a key (then of their digests); of every ``ARITY``
consecutive nodes of a level, the last run being shorter, one node of the next level is made, until one is left. The
trees' roots, in the order of their values (null first), are the leaves of a last tree; its root stands for the table.

Checkpoint and recompute: only every ``STRIDE``-th level is written, as blocks of the ARITY ** STRIDE nodes that share
their next written ancestor. Proofs go down from the root: a block meets its ancestor's path, regenerates the levels
between from its stored nodes, and gives each node its siblings there; what was regenerated is not kept. So a job
reads each written level once, and no task ever holds more than blocks of 64 nodes.

Places: rows are sorted by range over all tasks, and a tree's rows in earlier ranges are counted, so a tree that holds most
rows is spread over many tasks, as are rows with one key. Every step is built of column expressions and shuffles digests.

Null values have a mark of their own in a leaf; a null key comes first in its tree, and null values of the tree's column
make a tree of their own. Repeated rows are leaves of their own, side by side. An empty table has no rows and no root.
Columns beside those that are named are left out, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import durable, release, rows_of, seen_in
from priorline.llm.native import let

ARITY, STRIDE = 8, 2
#: Most (range, tree) counts that are broadcast, some 60 bytes each; beyond, they are joined by shuffle.
BROADCAST_COUNTS = 200_000


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' UTF-8, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*columns: Column) -> Column:
    """The leaf of a row: the digest of its fields."""
    return digest(*[field(c) for c in columns])


def _count(level: int) -> Column:
    """How many nodes a tree of ``n`` leaves has on a level."""
    step = ARITY**level
    return F.expr(f"(n + {step - 1}L) div {step}L")


def _above(nodes: Column, level: int) -> Column:
    """A block's nodes one level up: of each run its digest; a tree's last node stays."""
    runs = let(nodes, lambda a: F.transform(F.sequence(F.lit(1), F.size(a), F.lit(ARITY)), lambda k: F.sha2(F.array_join(F.slice(a, k, ARITY), ""), 256)))
    return F.when(_count(level) > 1, runs).otherwise(nodes)


def _levels(level: int) -> list[Column]:
    """A block's nodes on its own level and on the STRIDE levels above."""
    out = [F.col("members.h")]
    for i in range(STRIDE):
        out.append(_above(out[-1], level + i))
    return out


@dataclass
class Trees:
    """The written levels of all trees, lowest first, and (tree, n, h) of each tree's root."""

    blocks: list[DataFrame]
    roots: DataFrame

    def release(self) -> None:
        for written in [*self.blocks, self.roots]:
            release(written)


def placed(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (tree, key, h, ...) with n, its tree's rows, and pos, its place in its tree; and what to release after use."""
    read = durable(rows, "leaves")  # ranges are sampled first, and digests are not made twice
    ordered = read.withColumn("row", F.monotonically_increasing_id())  # parts equal rows too
    ordered = ordered.repartitionByRange("tree", "key", "h", "row").drop("row").sortWithinPartitions("tree", "key", "h")
    ordered = durable(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    release(read)
    part = F.shiftright("at", 33)
    counts = ordered.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = durable(counts.select("tree", "part", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(tree).alias("n")), "ranges")
    small = F.broadcast(counts) if rows_of(counts) <= BROADCAST_COUNTS else counts
    out = ordered.withColumn("part", part).join(small, ["tree", "part"])
    return out.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "first", "before", "at"), [ordered, counts]


def grown(rows: DataFrame) -> Trees:
    """Trees over ``rows``: tree, key, h (the leaves) and any further columns, which stay with the leaves."""
    nodes, spare = placed(rows)
    blocks, roots, level = [], [], 0
    while True:
        members = F.array_sort(F.collect_list(F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "n", "pos")])))
        block = F.expr(f"pos div {ARITY**STRIDE}L").alias("block")
        own = durable(nodes.groupBy("tree", "n", block).agg(members.alias("members")), "blocks", sums=F.max("n"))
        for used in spare:
            release(used)
        blocks.append(own)
        top = own.select("tree", "n", F.col("block").alias("pos"), _levels(level)[-1].getItem(0).alias("h"))
        level += STRIDE
        roots.append(top.where(_count(level) == 1).select("tree", "n", "h"))
        nodes, spare = top.where(_count(level) > 1), []
        if (seen_in(own) or 0) <= ARITY**level:
            break
    every = roots[0]
    for more in roots[1:]:
        every = every.union(more)
    return Trees(blocks, durable(every, "roots"))


def paths(trees: Trees, above: DataFrame) -> DataFrame:
    """Every leaf with its columns, tree, subroot (its tree's root), those of ``above``, and path.

    ``above``: tree, path from the tree's root on, and further columns, one row a tree. A step of a path is what stands
    left of the node in its run and what stands right, so its parent is the digest of left, node and right.
    """
    step = "array<struct<left:string,right:string>>"
    tops = above.join(trees.roots.select("tree", F.col("h").alias("subroot")), "tree")
    also = [c for c in tops.columns if c not in ("tree", "path")]
    down = None
    for k in reversed(range(len(trees.blocks))):
        level, own = STRIDE * k, trees.blocks[k]
        last = own.where(_count(level + STRIDE) == 1).join(tops.withColumnRenamed("path", "rest"), "tree")
        if down is not None:
            rest = down.select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), *also)
            last = last.unionByName(own.where(_count(level + STRIDE) > 1).join(rest, ["tree", "block"]))
        between = [nodes.alias(f"nodes{i}") for i, nodes in enumerate(_levels(level)[:-1])]
        each = last.select("tree", "n", "rest", *also, *between, F.posexplode("members").alias("place", "member"))
        steps = []
        for i in range(STRIDE):
            at = F.expr(f"place div {ARITY**i}").cast("int")
            first = F.expr(f"place div {ARITY ** (i + 1)} * {ARITY}").cast("int")
            side = lambda start, size, i=i: F.array_join(F.slice(F.col(f"nodes{i}"), start, size), "")
            run = F.struct(side(first + 1, at - first).alias("left"), side(at + 2, first + ARITY - at - 1).alias("right"))
            steps.append(F.when(_count(level + i) > 1, F.array(run)).otherwise(F.array().cast(step)))
        path = F.concat(*steps, F.col("rest").cast(step)).alias("path")
        down = each.select("tree", "n", F.col("member.pos").alias("pos"), *([] if k else [F.col("member")]), *also, path)
    leaf = [c.name for c in trees.blocks[0].schema["members"].dataType.elementType.fields if c.name not in ("pos", "key", "h")]
    return down.select("tree", F.col("member.key").alias("key"), F.col("member.h").alias("leaf"), *[F.col("member")[c].alias(c) for c in leaf], *also, "path")


def proofs(docs: DataFrame, leaf: Column, tree: Column, key: Column, **also: Column) -> DataFrame:
    """Of every row: key, leaf, subroot, root, path and the columns ``also`` names, which are expressions of ``docs``."""
    taken = {"tree", "key", "h", "n", "pos", "at", "part", "row", "first", "before", "leaf", "subroot", "root", "path"} & set(also)
    if taken:
        raise ValueError(f"names in use: {sorted(taken)}")
    named = F.when(tree.isNull(), "-").otherwise(F.concat(F.lit("="), tree.cast("string")))
    rows = docs.select(named.alias("tree"), key.alias("key"), leaf.alias("h"), *[c.alias(n) for n, c in also.items()])
    forest = grown(rows)
    last = grown(forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "h"))
    over = docs.sparkSession.createDataFrame([("", [])], "tree string, path array<struct<left:string,right:string>>")
    tops = durable(paths(last, over).select(F.col("key").alias("tree"), "path", F.col("subroot").alias("root")), "tops")
    return paths(forest, tops).drop("tree")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))
