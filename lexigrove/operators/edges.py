"""Edges between files from their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import roles as R
from ..functions import text as T


def with_roles(files: DataFrame) -> DataFrame:
    return files.select("path").withColumn("role", R.index_role(F.col("path")))


def area_pairs(files: DataFrame) -> DataFrame:
    """(area, n_files, n_edges): same-area edges per area, counted; every pair of its source files is one."""
    keyed = with_roles(files).where("role = 'source'").groupBy(R.area_key(F.col("path")).alias("area")).agg(F.count(F.lit(1)).alias("n_files"))
    return keyed.withColumn("n_edges", (F.col("n_files") * (F.col("n_files") - 1) / 2).cast("long"))


def area_edges(files: DataFrame, focus: DataFrame) -> DataFrame:
    """(src, dst): same-area edges that touch the focus paths; src sorts first."""
    keyed = with_roles(files).where("role = 'source'").select("path", R.area_key(F.col("path")).alias("area"))
    mine = keyed.join(focus, "path", "left_semi").select(F.col("path").alias("mine"), "area")
    both = keyed.join(mine, "area").where(F.col("path") != F.col("mine"))
    return both.select(F.least("path", "mine").alias("src"), F.greatest("path", "mine").alias("dst")).distinct()


def test_edges(files: DataFrame, limit: int = 3) -> DataFrame:
    """(src, dst, confidence, reason): tests and the first source files, by path, whose stem they share.

    An equal stem or a shared stem token makes a pair. A test's first sources
    are among the first of each of its tokens, so only these are joined: no
    token, however common, makes more than ``limit`` pairs a test.
    """
    roles = with_roles(files)
    keys = lambda stem: F.array_distinct(F.concat(T.path_tokens(stem), F.array(F.concat(F.lit("="), stem))))
    sources = roles.where("role = 'source'").select(F.col("path").alias("dst"), F.explode(keys(T.stem(F.col("path")))).alias("key"))
    first = sources.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("dst"))).where(F.col("rn") <= limit).drop("rn")
    tests = roles.where("role = 'test'").select(F.col("path").alias("src"), F.explode(keys(T.test_stem(F.col("path")))).alias("key"))
    pairs = tests.join(first, "key").select("src", "dst").distinct()
    nearest = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("rn") <= limit)
    left, right = T.test_stem(F.col("src")), T.stem(F.col("dst"))
    shared = T.let(T.path_tokens(right), lambda r: F.size(F.filter(T.path_tokens(left), lambda t: F.array_contains(r, t))))
    found = nearest.select("src", "dst", (left == right).alias("exact"), shared.alias("overlap"))
    return found.select(
        "src",
        "dst",
        F.when(F.col("exact"), "extracted").when(F.col("overlap") >= 2, "inferred").otherwise("ambiguous").alias("confidence"),
        F.when(F.col("exact"), "filename stem matches").otherwise(F.concat(F.lit("shared stem tokens: "), F.col("overlap").cast("string"))).alias("reason"),
    )


def config_edges(files: DataFrame) -> DataFrame:
    """(src, dst): config and lock files and the source root: a well-known entry point, or the first source path."""
    roles = with_roles(files)
    order = F.lit(len(S.SOURCE_ROOTS))
    for i, root in reversed(list(enumerate(S.SOURCE_ROOTS))):
        order = F.when(F.col("path") == root, F.lit(i)).otherwise(order)
    root = roles.where("role = 'source'").agg(F.min_by("path", F.struct(order, "path")).alias("dst")).where("dst is not null")
    return roles.where("role in ('config', 'lockfile')").select(F.col("path").alias("src")).join(F.broadcast(root))  # one row


def resolve(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(from_file, spec, target): the first of each import's candidate paths that exists.

    ``candidates``: from_file, spec, options (array of paths in order).
    """
    options = candidates.select("from_file", "spec", F.posexplode("options").alias("pos", "path"))
    return options.join(known.select("path").distinct(), "path").groupBy("from_file", "spec").agg(F.min_by("path", "pos").alias("target"))
