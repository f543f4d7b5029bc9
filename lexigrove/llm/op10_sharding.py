"""Sharding by a hierarchical weighted hash tree.

Each document descends region, rack and shard. At a node every child draws
``-ln(u) / weight`` from a hash of (document, child) and the least draw wins, so
a child is taken in proportion to the weight below it, and a change of weight
moves rows only between the changed subtree and its siblings. A shard that is
added opens a subtree of its own at the top and can only take rows into itself.
From BASE shards on, and among trees of fewer than BASE (whose shards have a
region each), the tree of n + 1 shards and the grown tree of n are the same; a
tree that was laid out for BASE - 1 shards and grown is not the one laid out for
BASE, which has racks: a tree is laid out once and grown from there.

Null ids: all hash alike, so they share a shard; their slots are spread by size
and content. Null texts: no bytes (size 1, crc 0). Very long texts count whole.
Ties of draws go to the earlier child; repeated rows are placed alike and get
slots of their own. Empty table: no rows. Other columns of the input are not
looked at, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .op5_mixing import hashed, uniform

#: Shards of a rack and racks of a region in a tree of BASE shards; later shards have a region each.
RACK, REGION, BASE = 4, 2, 16
#: Slots are counted in ranges of about so many rows of a shard; there are at most MOST ranges.
RANGE_ROWS, MOST = 512, 65_536
SEED, SLOT = "shard", "slot"

Tree = dict[str, dict[str, dict[int, float]]]


def layout(n_shards: int, weights: dict[int, float] | None = None, base: int = BASE) -> Tree:
    """Region -> rack -> shard -> weight for so many shards (weight 1 unless given).

    The first ``base`` shards are laid out in racks and regions, every later one
    in a region of its own. With fewer than ``base``, each has its own.
    """
    tree: Tree = {}
    full = base if n_shards >= base else 0
    for s in range(n_shards):
        region, rack = (f"region{s // RACK // REGION}", f"rack{s // RACK}") if s < full else (f"shard{s}", f"shard{s}")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = (weights or {}).get(s, 1.0)
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own: only that subtree's weight changes."""
    n = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return tree | {f"shard{n}": {f"shard{n}": {n: weight}}}


def _weight(node: object) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _nodes(tree: Tree) -> Column:
    """Every inner node's path with its children (path, weight below), as a map; nothing is drawn for a weight of 0."""
    out: list[Column] = []

    def visit(node: dict, at: str) -> None:
        children = [(f"{at}/{name}", _weight(child), child) for name, child in node.items()]
        out.extend((F.lit(at), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w, _ in children if w > 0])))
        for p, w, child in children:
            if w > 0 and isinstance(child, dict):
                visit(child, p)

    visit(tree, SEED)
    return F.create_map(*out)


def place(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """``df`` with the shard of each row in ``out``: a descent of three levels, no shuffle."""
    nodes = _nodes(tree)

    def child(at: Column) -> Column:
        """The child with the least weighted draw; ties go to the earlier one."""
        draw = lambda c, i: F.struct((-F.log(uniform(c["path"], F.col(key))) / c["weight"]).alias("d"), i.alias("i"), c["path"].alias("path"))
        return F.array_min(F.transform(F.element_at(nodes, at), draw))["path"]

    path = f"_path_{out}"
    df = df.withColumn(path, child(F.lit(SEED)))
    for _ in range(2):
        df = df.withColumn(path, child(F.col(path)))
    return df.withColumn(out, F.substring_index(path, "/", -1).cast("int")).drop(path)


def slots(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Gapless slots from 0 within each shard, in order of (hash range, ``order``), without one task holding a shard.

    Rows are counted by (shard, range) first; a range's first slot is the sum of
    the ranges before it. At most MOST ranges a shard, so the counts stay small
    enough to broadcast, whatever the input.
    """
    n = max(1, min(MOST, -(-df.count() // (BASE * RANGE_ROWS))))
    # the hash takes in all that the order looks at, so that a hot id doesn't fill a range
    df = df.withColumn("_range", (hashed(SLOT, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]) % n).cast("int"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(shard, "_range").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(shard, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard, "_range").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(first), [shard, "_range"])
        .withColumn("slot", (F.col("_first") + F.col("_row") - 1).cast("long"))
        .drop("_range", "_row", "_first")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and shard after growth by one for every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tree = layout(n_shards)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(place(rows, "doc_id", tree, "shard"), "doc_id", grow(tree), "grown_shard")
    return slots(rows, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
