"""A Merkle manifest of a table: leaves by source, subroots, one root, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs' concatenation, digests taken as hex text. A row's leaf is
H of its columns, each ``-`` if null, else UTF-8 byte count, ``:`` and value. Per source the leaves ascend
by id; while more than one node remains, every three consecutive ones (in the last run fewer, even one)
become their H. What remains is the source's subroot. The subroots, by source (null first, UTF-8
bytewise), give the root in the same way.

1. One pass over the texts makes the leaves. They are sorted by (source, id, leaf) into ranges; a leaf's
   position in its source is its offset in its range and the counts of the ranges before, so a source
   with a third of all rows lies in many ranges and no task sees a source as a whole.
2. 3**6 consecutive leaves of a source are one ordered array, in which ``sequence``, ``transform`` and
   ``slice`` build each level from the one below and ``aggregate`` goes through the levels. The blocks'
   roots are the leaves of the next round, of 3**6 times fewer rows, until each source has one block.
3. The other way round every block gets the path of its own root from the block above, and its leaves
   get theirs from the levels that the array holds. Only block roots move; the paths of leaves don't.
4. A leaf that is folded along its path must give the root. With ``tampered`` another leaf is folded, so
   the manifest shows which rows are no longer what they were.

Defined results: null columns count as above; ids that are null come first; rows with one id are in the
order of their leaves, and equal rows have leaves of their own; an empty table gives an empty result;
other columns aren't read. A table of one row has the leaf as its root and the H of nothing as its proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, partitions

DEPTH = 6  # levels that a block collapses
BLOCK = 3**DEPTH
RANGE_ROWS = 1 << 18
OFFSET_BITS = 33  # of monotonically_increasing_id: the rest is the partition

POWERS = f"array({', '.join(str(3**i) for i in range(DEPTH))})"
#: The next level: every three nodes of ``x`` become their digest.
UP = "transform(sequence(0, (size({x}) - 1) div 3), j -> sha2(array_join(slice({x}, 3 * j + 1, 3), ''), 256))"
#: All levels of a block, the leaves first; a block of a tree with few leaves ends at one node.
LEVELS = f"aggregate(slice(sequence(1, {DEPTH}), 1, size(filter({POWERS}, p -> p < width))), array(nodes), (a, i) -> concat(a, array({UP.format(x='element_at(a, -1)')})))"
#: The siblings of node ``at`` of a block, level by level.
SIBLINGS = f"""transform(slice(sequence(0, {DEPTH - 1}), 1, size(levels) - 1), l -> named_struct(
    'left', array_join(slice(get(levels, l), (at div get({POWERS}, l)) div 3 * 3 + 1, (at div get({POWERS}, l)) % 3), ''),
    'right', array_join(slice(get(levels, l), at div get({POWERS}, l) + 2, 2 - (at div get({POWERS}, l)) % 3), '')))"""
PROOF = "sha2(array_join(transform(path, p -> concat(p.left, p.right)), ''), 256)"
FOLDED = "aggregate(path, coalesce(tampered, node), (h, p) -> sha2(concat(p.left, h, p.right), 256))"
NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def framed(column: Column) -> Column:
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*(framed(c) for c in columns)), 256)


def without_newlines(row_id: Column, text: Column) -> tuple[Column, Column]:
    """Whether a row is tampered with, and its text then: where 2 divides the CRC-32 of the id, its line ends go."""
    return (F.crc32(row_id.cast("string")) % 2 == 0) & text.contains("\n"), F.replace(text, F.lit("\n"), F.lit(""))


def positioned(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (with ``tree``) with ``pos``, their position in their tree by ``order``, and ``width``, the number of leaves of the tree."""
    leaves = cut(leaves)
    ranges = max(partitions(leaves.sparkSession), -(-leaves.count() // RANGE_ROWS))
    dealt = leaves.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(ranges, "tree", *order, "nth").sortWithinPartitions("tree", *order, "nth")
    placed = cut(dealt.drop("nth").withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", OFFSET_BITS)))
    # one row for each tree and range: what comes before it in its tree
    parts = placed.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = W.partitionBy("tree")
    parts = parts.select("tree", "range", "first", (F.sum("n").over(tree.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(tree).alias("width"))
    return placed.join(parts, ["tree", "range"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "range", "first", "before")


def rounds(leaves: DataFrame) -> list[DataFrame]:
    """Blocks (tree, block, items, levels, width, root) of each round, from leaves (tree, pos, width, node, item)."""
    found = []
    while True:
        blocks = leaves.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block"), "width").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "item"))).alias("items"))
        blocks = blocks.withColumn("nodes", F.col("items.node")).withColumn("levels", F.expr(LEVELS)).withColumn("root", F.expr("element_at(element_at(levels, -1), 1)"))
        found.append(cut(blocks.select("tree", "block", "width", F.col("items.item").alias("items"), "levels", "root")))
        above = found[-1].where(F.col("width") > BLOCK)
        if above.isEmpty():
            return found
        leaves = above.select("tree", F.col("block").alias("pos"), F.expr(f"(width + {BLOCK - 1}) div {BLOCK}").alias("width"), F.col("root").alias("node"), F.lit(None).cast("boolean").alias("item"))


def roots(found: list[DataFrame]) -> DataFrame:
    """(tree, root) of all trees."""
    out = None
    for blocks in found:
        whole = blocks.where(F.col("width") <= BLOCK).select("tree", "root")
        out = whole if out is None else out.union(whole)
    return out


def paths(found: list[DataFrame], top: DataFrame | None) -> DataFrame:
    """(tree, pos, item, node, subroot, path) of every leaf; ``top`` has tree, subroot and the path from a tree's root upwards, or is none where nothing is above."""
    nodes = None
    for blocks in reversed(found):
        above = blocks.where(F.col("width") <= BLOCK)
        above = above.select("*", F.col("root").alias("subroot"), F.expr(NO_PATH).alias("path")) if top is None else above.join(top, "tree")
        if nodes is not None:
            ours = nodes.select("tree", F.col("pos").alias("block"), "subroot", "path")
            above = above.unionByName(blocks.where(F.col("width") > BLOCK).join(ours, ["tree", "block"]))
        each = above.select("*", F.posexplode("items").alias("at", "item"))
        nodes = each.select("tree", F.expr(f"block * {BLOCK} + at").alias("pos"), "item", F.expr("get(levels[0], at)").alias("node"), "subroot", F.concat(F.expr(SIBLINGS), "path").alias("path"))
    return nodes


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered=without_newlines, text_col: str = "text") -> DataFrame:
    """doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root and verified of every row.

    ``tampered`` gives, from id and text, whether and how a row's text was changed after the manifest was made.
    """
    own = [F.col(c) for c in columns]
    hit, text = tampered(F.col(id_col), F.col(text_col))
    changed = leaf_of(*(text if c == text_col else F.col(c) for c in columns))
    # a source's name after a mark that puts null first
    tree = F.when(F.col(group_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf_of(*own).alias("node"), F.when(hit, changed).alias("tampered"))
    leaves = positioned(leaves, ["doc_id", "node"])
    by_source = rounds(leaves.select("tree", "pos", "width", "node", F.struct("doc_id", "tampered").alias("item")))
    sources = positioned(roots(by_source).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")), ["name"])
    over = rounds(sources.select("tree", "pos", "width", "node", F.col("name").alias("item")))
    root = (roots(over).first() or [None, None])[1]
    top = cut(paths(over, None).select(F.col("item").alias("tree"), F.col("node").alias("subroot"), "path"))
    rows = paths(by_source, top).select("item.*", F.when(F.col("tree") != "0", F.expr("substr(tree, 2)")).alias("source"), "node", "subroot", "path")
    rows = rows.withColumn("folded_root", F.expr(FOLDED))
    return rows.select("doc_id", "source", F.col("node").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", F.expr(PROOF).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
