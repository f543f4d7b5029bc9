"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its
share of the input. Each document draws its count by inverting the Poisson
distribution at a uniform number hashed from (seed, id), is exploded by that
count, and the copies are ordered over the whole corpus by a second hash. A
document with more than SPREAD copies is dealt out first, as ranges of its copy
numbers, so no task multiplies a row by more than that in one step.

Null sources are a source of their own; a source with no weight given gets
``default`` (nothing if it is 0). Null ids hash alike. Repeated rows draw alike
and get equal keys; the order among rows with equal keys (one id, one copy
number) is left open. Null, empty and very long texts pass through. Empty table: no rows. All columns of the input stay;
``copy_no`` and ``shuffle_key`` are added, in place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tasks

#: Rates up to this many sources are sent to all tasks; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Copies that one task makes of a row in one step.
SPREAD = 256
#: Production parameter: the total stays as it is, and every source gets an equal part of it.
EPOCHS = 1.0


def hashed(seed: str | Column, *cols: Column) -> Column:
    """52 bits of an MD5 over (seed, cols) as a long, which any engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, str) else seed, *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def uniform(seed: str | Column, *cols: Column) -> Column:
    """A double in (0, 1) from such a hash."""
    return (hashed(seed, *cols).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _outermost(rate: Column) -> tuple[Column, Column]:
    """Counts that a Poisson of the rate falls below or exceeds with a probability below 1e-15 (Chernoff bound)."""
    reach = F.lit(9.0) * F.sqrt(rate) + F.lit(20.0)
    return F.greatest(F.floor(rate - reach), F.lit(0)).cast("int"), F.ceil(rate + reach).cast("int")


def law(rate: Column) -> Column:
    """(low, p, high): the outermost counts of a Poisson, and the probability of the lowest.

    Up to a rate of about 118 the lowest is 0. From there on exp(-rate) nears the
    smallest double, so terms are taken relative to the mode's and scaled to sum to 1.
    """
    low, high = _outermost(rate)
    mode = F.floor(rate).cast("int")
    # of the mode's term, the lowest one's share
    share = F.aggregate(F.when(mode > low, F.sequence(low + 1, mode)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda acc, i: acc * i / rate)
    start = F.struct(share.alias("p"), share.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), (acc["total"] + p).alias("total"))

    total = F.aggregate(F.sequence(low + 1, high), start, step, lambda acc: acc["total"])
    return F.struct(low.alias("low"), F.when(low > 0, share / total).otherwise(F.exp(-rate)).alias("p"), high.alias("high"))


def poisson(u: Column, rate: Column, law: Column) -> Column:
    """The least k with P(X <= k) >= u. The unit is added up term by term, over as many terms as the rate needs."""
    start = F.struct(law["p"].alias("p"), law["p"].alias("total"), law["low"].alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        more = u > acc["total"]
        return F.struct(F.when(more, p).otherwise(acc["p"]).alias("p"), F.when(more, acc["total"] + p).otherwise(acc["total"]).alias("total"), F.when(more, i).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(law["low"] + 1, law["high"]), start, step, lambda acc: acc["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None, default: float, epochs: float, source_col: str) -> DataFrame:
    """(source, n, rate, law) of every source; the counts are over all documents."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    sums = counts.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    out = counts.join(F.broadcast(sums)).select("_source", "n", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") * F.lit(float(epochs)) / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))
    return out.withColumn("law", law(F.col("rate")))


def _copied(drawn: DataFrame) -> DataFrame:
    """``drawn`` with a row for each ``copy_no`` from 1 to ``_copies``.

    The largest count (one number) says how often ranges have to be cut: each
    step cuts a row's range into at most SPREAD parts, and deals them out by hash.
    """
    most = drawn.agg(F.max("_copies")).first()[0] or 0
    rows = drawn.where("_copies > 0").withColumn("_from", F.lit(1)).withColumn("_to", F.col("_copies"))
    step = SPREAD
    while step * SPREAD < most:
        step *= SPREAD
    if most > SPREAD:
        many, rows = rows.where(F.col("_copies") > SPREAD), rows.where(F.col("_copies") <= SPREAD)
        while step >= SPREAD:
            many = many.withColumn("_from", F.explode(F.sequence("_from", "_to", F.lit(step)))).withColumn("_to", F.least(F.col("_to"), F.col("_from") + (step - 1)))
            many = many.repartition(tasks(drawn), "_id", "_from")
            step //= SPREAD
        rows = rows.unionByName(many)
    return rows.withColumn("copy_no", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to", "_copies")


def _mixed(docs: DataFrame, weights: dict[str, float] | None, default: float, epochs: float, seed: str, id_col: str, source_col: str) -> DataFrame:
    """(doc, copy_no, shuffle_key) in the global order; the row is one struct, so that no name of its columns can clash."""
    by_source = rates(docs, weights, default, epochs, source_col)
    by_source = F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"))
    drawn = rows.join(by_source.select("_source", "rate", "law"), "_source").withColumn("_copies", poisson(uniform(seed, F.col("_id")), F.col("rate"), F.col("law")))
    keyed = _copied(drawn).withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.col("_id"), F.col("copy_no").cast("string")).cast("binary")))
    return keyed.select("doc", "copy_no", "shuffle_key").orderBy("shuffle_key")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, epochs: float = EPOCHS, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", marks: bool = True
) -> DataFrame:
    """``docs`` replicated to the target weights in one global random order.

    ``weights``: source -> share of the output, scaled to sum to 1. ``marks``:
    add ``copy_no`` and ``shuffle_key``, in place of columns of these names.
    """
    out = _mixed(docs, weights, default, epochs, seed, id_col, source_col)
    if not marks:
        return out.select("doc.*")
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in ("copy_no", "shuffle_key")], "copy_no", "shuffle_key")


def op5_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "copy_no", "shuffle_key", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


ORACLE = f"""
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM n) * (SELECT sum(n) FROM n) * {EPOCHS}::DOUBLE / n AS rate FROM n),
k AS (SELECT s, rate, unnest(range(0, ceil(rate + 9 * sqrt(rate) + 21)::BIGINT)) AS k FROM r),
t AS (SELECT s, rate, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p FROM k),
c AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS total FROM t),
u AS (SELECT *, (('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
d AS (SELECT u.doc_id, u.source, u.text, count(*) FILTER (WHERE c.total < u.u) AS copies FROM u JOIN c ON c.s = coalesce(u.source, '') GROUP BY ALL),
e AS (SELECT doc_id, source, text, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM d WHERE copies > 0)
SELECT doc_id, source, copy_no, md5('mix-order:' || doc_id || ':' || copy_no) AS shuffle_key, coalesce(strlen(text), 0)::BIGINT AS n_bytes, md5(coalesce(text, '')) AS text_md5 FROM e
"""
