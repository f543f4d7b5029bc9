"""Shared pieces of the training-data operators: tables, lineage cuts, blocks, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session; they may run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lexigrove_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="lexigrove-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._lexigrove_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A session in one process that names none, as in tests, gets a temporary
    folder of its own; on a cluster that is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="lexigrove-")
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` has written once nothing reads them any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished steps go: Spark drops them once the driver has collected the plans that made them."""
    gc.collect()
    spark._jvm.System.gc()


def tasks(df: DataFrame) -> int:
    """Shuffle partitions that the session is set to use."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocks(df: DataFrame, key: list[str], id_col: str, block: int) -> DataFrame:
    """Split the groups of ``key`` into blocks so that every pair of a group meets in one block pair.

    Adds ``bi`` and ``bj`` (``bi <= bj``). A group of at most ``block`` rows
    stays whole; a larger one is dealt by hash into n blocks, each row is
    copied into the n block pairs that its block is part of, and so no task
    gets more than two blocks of any group at once. ``own`` is the row's block.
    """
    large = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    dealt = (
        df.join(large, key, "left")
        .withColumn("_b", F.coalesce(F.ceil(F.col("_n") / F.lit(block)), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.col("_b")).cast("int"))
    )
    return (
        dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .withColumn("bi", F.least("own", "_o"))
        .withColumn("bj", F.greatest("own", "_o"))
        .drop("_n", "_b", "_o")
    )


def by_group(
    df: DataFrame, key: list[str], run: Callable[[pa.Table], Iterator[pa.RecordBatch] | list[pa.RecordBatch]], schema: str, parts: int | None = None
) -> DataFrame:
    """Sorted groups of ``key`` through ``run``, many whole groups at a time.

    ``run`` gets an Arrow table of whole groups in key order, so it can work on
    all of them at once; only one batch and one unfinished group are held.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
            end = tuple(x[-1] for x in ids)
            if held and last != tuple(x[0] for x in ids):
                yield from run(pa.Table.from_batches(held))
                held = []
            same = np.ones(len(ids[0]), bool)
            for x, e in zip(ids, end, strict=True):
                same &= x == e
            cut_at = int(same.argmax()) if same.any() else 0
            if cut_at:
                held.append(batch.slice(0, cut_at))
                yield from run(pa.Table.from_batches(held))
                held = [batch.slice(cut_at)]
            else:
                held.append(batch)
            last = end
        if held:
            yield from run(pa.Table.from_batches(held))

    n = parts or tasks(df)
    return df.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(stream, schema)


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of the vertices of ``edges`` (a, b), component being the smallest vertex that each can reach; those smallest ones have no row.

    Alternating large-star and small-star steps; each step is a few shuffles of
    at most the edges, and each round is written to the shared folder, so a lost
    executor costs one round at most. The number of rounds is logarithmic, and
    none for edges that are stars already.
    """
    cur = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        # settled when every vertex has one smaller neighbour at most and that one has none
        ends = cur.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(cur.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        ends = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
        if not ends.agg(F.max((F.col("low") > 1) | (F.col("low") > 0) & (F.col("high") > 0))).first()[0]:
            return cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = cut(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        forget(cur)
        cur = new
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b), component being its smallest vertex."""
    found = stars(edges, rounds)
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
