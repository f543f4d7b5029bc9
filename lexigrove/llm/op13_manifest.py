"""Merkle manifest of a dataset, with inclusion proofs by pointer jumping.

A row's leaf is the hash of its fields. The leaves of a language, in order of
id, are hashed in runs of ARITY until one node, the subroot, is left; the
subroots, in order of language, are hashed likewise to the root.

Places in that order come from range partitions and their counts, so no task
sorts a whole language. Every inner node then holds a segment, the siblings on
its way to an ancestor, at first its parent; in each round the nodes are joined
with themselves on that ancestor, the two segments are put end to end and the
distance doubles, so that all paths reach the root after log2(height) rounds.
Many nodes share an ancestor near the root: each node knows how many nodes lie
below it, and one with more than FAN of them is copied under several salts, its
descendants being dealt over those. The leaves of a run stay together beside
their parent, so that a segment is stored once a run, and take its finished
segment after their own siblings.

Null fields hash as ``-``; null languages come first; null ids come first in
their language, equal ids in order of their leaves, and repeated rows get leaves
of their own. Null and empty texts and very long ones: as any other value. A
language of one row: its leaf is the subroot. Empty table: no rows. Other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, forget, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: Nodes that one copy of an ancestor serves in a round.
FAN = 1_000
#: The tree over the subroots; languages' trees are named "=" and the language, or "" for none.
TOP = "+"


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hash of fields, each ``-`` if null, else its length in UTF-8 bytes, a colon and its value."""
    each = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*each), 256)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the row's place in its group from 0 in the given order, and ``total``, the group's rows.

    Rows are dealt by ranges of (group, order) and sorted there; only the counts
    of (group, range) are summed, so a group may fill any number of ranges.
    """
    laid = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")  # the partition's number is in the upper bits
    counts = laid.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    return laid.withColumn("_part", part).join(first, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _joined(run: str | Column, start: Column | int = 1, length: Column | None = None) -> Column:
    run = F.col(run) if isinstance(run, str) else run
    return F.array_join(F.slice(run, start, F.size(run) if length is None else length), "")


def _hop(run: Column, i: Column) -> Column:
    """The digests of a run to the left and to the right of place i."""
    return F.struct(_joined(run, 1, i).alias("left"), _joined(run, i + 2).alias("right"))


def _climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Edges to the parents and the top nodes of the trees over nodes (tree, count, level, pos, node, digest, below, subroot).

    ``count`` is the number of nodes of the tree on that level; a tree ends where
    it is 1. ``below`` counts the nodes of a subtree.
    """
    edges, tops = [], []
    for _ in range(height):
        tops.append(nodes.where("count = 1"))
        at = F.floor(F.col("pos") / ARITY)
        runs = cut(
            nodes.where("count > 1")
            .groupBy("tree", "count", "level", at.alias("up"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "node", "digest", "below", "subroot"))).alias("run"), (F.sum("below") + 1).alias("below"))
            .select("tree", F.ceil(F.col("count") / ARITY).alias("count"), (F.col("level") + 1).alias("level"), F.col("up").alias("pos"), F.col("below"), "run")
            .withColumn("node", F.concat_ws("/", "tree", "level", "pos"))
        )
        digests = F.col("run.digest")
        edges.append(
            runs.select("node", "below", digests.alias("digests"), F.posexplode("run").alias("_i", "x")).select(
                F.col("x.node").alias("node"),
                F.col("x.below").alias("below"),
                F.col("node").alias("up"),
                F.col("below").alias("up_below"),
                F.array(_hop(F.col("digests"), F.col("_i"))).alias("hops"),
                F.col("x.subroot").alias("subroot"),
            )
        )
        nodes = runs.select("tree", "count", "level", "pos", "node", F.sha2(_joined(digests), 256).alias("digest"), "below", F.lit(None).cast("string").alias("subroot"))
    return edges, [*tops, nodes.where("count = 1")]


def _height(most: int) -> int:
    """Levels above so many nodes."""
    n = 0
    while most > 1:
        most, n = -(-most // ARITY), n + 1
    return n


def jump(edges: DataFrame, root: str, height: int, fan: int = FAN) -> DataFrame:
    """Edges (node, below, up, up_below, hops, subroot) with every ``up`` moved to the root, hops being all on the way.

    Each round joins the nodes that aren't there yet with the table itself on
    their present ancestor, which doubles its distance.
    """
    now, distance = cut(edges), 1
    salts = lambda below: F.ceil(below / fan).cast("int")
    while distance < height:
        open_ = now.where(F.col("up") != root).withColumn("_salt", F.pmod(F.xxhash64("node"), salts(F.col("up_below"))).cast("int"))
        ahead = now.select(
            F.col("node").alias("up"), F.col("up").alias("_up"), F.col("up_below").alias("_up_below"), F.col("hops").alias("_hops"), F.col("subroot").alias("_subroot"), F.explode(F.sequence(F.lit(0), salts(F.col("below")) - 1)).alias("_salt")
        )
        further = open_.join(ahead, ["up", "_salt"]).select(
            "node", "below", F.col("_up").alias("up"), F.col("_up_below").alias("up_below"), F.concat("hops", "_hops").alias("hops"), F.coalesce("subroot", "_subroot").alias("subroot")
        )
        new = cut(now.where(F.col("up") == root).unionByName(further))
        forget(now)
        now, distance = new, distance * 2
    return now


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof make."""
    return F.aggregate(proof, leaf, lambda x, hop: F.sha2(F.concat(hop["left"], x, hop["right"]), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) of every row; ``proof`` has the siblings' digests left and right of each level's node.

    ``carry``: further columns of the result, computed from a row beside its leaf.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit(""))
    more = carry or {}
    rows = cut(docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf_of([F.col(f) for f in fields]).alias("leaf"), F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in more.items()]).alias("more"), F.monotonically_increasing_id().alias("tie")))
    laid = numbered(rows, "tree", ["doc_id", "leaf", "tie"])
    forget(rows)
    runs = cut(
        laid.groupBy("tree", "total", F.floor(F.col("pos") / ARITY).alias("pos"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", "more"))).alias("run"))
        .withColumn("node", F.concat_ws("/", "tree", F.lit(1), "pos"))
    )
    forget(laid)
    first = runs.select(
        "tree",
        F.ceil(F.col("total") / ARITY).alias("count"),
        F.lit(1).alias("level"),
        "pos",
        "node",
        F.when(F.col("total") == 1, F.col("run")[0]["leaf"]).otherwise(F.sha2(_joined("run.leaf"), 256)).alias("digest"),
        F.lit(1).cast("long").alias("below"),
        F.lit(None).cast("string").alias("subroot"),
    )
    height = _height(first.agg(F.max("count")).first()[0] or 0)
    edges, tops = _climb(first, height)
    subroots = numbered(reduce(DataFrame.unionByName, tops).select(F.lit(TOP).alias("top"), "tree", "node", "digest", "below"), "top", ["tree"])
    subroots = subroots.select(F.col("top").alias("tree"), F.col("total").alias("count"), F.lit(0).alias("level"), "pos", "node", "digest", "below", F.col("digest").alias("subroot"))
    above = _height(subroots.count())
    more_edges, top = _climb(subroots, above)
    node, root = reduce(DataFrame.unionByName, top).select("node", "digest").first() or ("", None)
    edges += more_edges
    out = runs.withColumns({"hops": F.array().cast("array<struct<left:string,right:string>>"), "subroot": F.lit(None).cast("string")})
    if edges:
        done = jump(reduce(DataFrame.unionByName, edges), node, height + above, fan)
        # runs right below the root, or the root itself, have no edge
        out = runs.join(done.select("node", F.col("hops").alias("_hops"), "subroot"), "node", "left").withColumn("hops", F.coalesce("_hops", F.array().cast("array<struct<left:string,right:string>>")))
    own = F.when(F.col("total") == 1, F.array().cast("array<struct<left:string,right:string>>")).otherwise(F.array(_hop(F.col("leaves"), F.col("_i"))))
    return out.select("total", "hops", "subroot", F.col("run.leaf").alias("leaves"), F.posexplode("run").alias("_i", "x")).select(
        F.col("x.doc_id").alias("doc_id"),
        F.col("x.leaf").alias("leaf"),
        F.coalesce("subroot", F.lit(root)).alias("subroot"),
        F.lit(root).alias("root"),
        F.concat(own, F.col("hops")).alias("proof"),
        *[F.col("x.more")[k].alias(k) for k in more],
    )


def op13_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; every third one (by a checksum of its id) is checked with its text lower-cased."""
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_of([F.translate(f, upper, upper.lower()) if f == "text" else F.col(f) for f in FIELDS]))
    out = manifest(docs, carry={"tampered": tampered})
    siblings = F.array_join(F.transform("proof", lambda hop: F.concat(hop["left"], hop["right"])), "")
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
