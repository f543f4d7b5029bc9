"""Retrieval quality: per-task metrics, groups, comparisons, gates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .graph import weight_of

METRICS = ["hit1", "hit3", "hit8", "rr", "ndcg8", "precision8", "recall8", "unnecessary"]
K = 8


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def per_task(ranked: DataFrame, judged: DataFrame, runs: DataFrame) -> DataFrame:
    """Metrics of every run whose task has labels; hits may lie anywhere in the list, gains count to K."""
    graded = judged.withColumn("gain", weight_of(F.col("label"), S.GAIN))
    ideal_order = Window.partitionBy("task_id").orderBy(F.desc("gain"), "path")
    ideal = graded.withColumn("pos", F.row_number().over(ideal_order)).groupBy("task_id").agg(
        F.sum(F.when(F.col("pos") <= K, F.col("gain") / F.log2(F.col("pos") + 1.0))).alias("idcg"),
        F.sum(F.col("label").isin(S.RELEVANT_LABELS).cast("int")).alias("relevant"),
    )
    hit, rel, top = F.col("label").isin(S.HIT_LABELS), F.col("label").isin(S.RELEVANT_LABELS), F.col("pos") <= K
    lists = ranked.join(graded, ["task_id", "path"], "left").groupBy("task_id", "mode").agg(
        F.min(F.when(hit, F.col("pos"))).alias("first"),
        F.sum(F.when(top, F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("pos") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(top & rel, 1).otherwise(0)).alias("rel_top"),
        F.sum(F.when(top, 1).otherwise(0)).alias("n_top"),
    )
    first = F.col("first")
    at = lambda k: F.when(first <= k, 1.0).otherwise(0.0)
    n_top = F.coalesce("n_top", F.lit(0))
    return (
        runs.join(ideal, "task_id").join(lists, ["task_id", "mode"], "left").select(
            "task_id", "mode", "repo_id", "task_type", "query", "latency_ms", "json_parse_ok",
            at(1).alias("hit1"), at(3).alias("hit3"), at(8).alias("hit8"),
            r6(F.coalesce(1.0 / first, F.lit(0.0)), "rr"),
            r6(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")), "ndcg8"),
            r6(F.when(n_top > 0, F.col("rel_top") / n_top).otherwise(0.0), "precision8"),
            r6(F.when(F.col("relevant") > 0, F.coalesce("rel_top", F.lit(0)) / F.col("relevant")), "recall8"),
            (first - 1).cast("double").alias("unnecessary"),
            first.isNull().alias("miss"),
        )
    )


def summary(scored: DataFrame) -> DataFrame:
    """Means over three groupings in one pass: by mode, by repository and mode, by task type and mode."""
    means = [r6(F.avg(m) + 1e-9, m) for m in METRICS]  # a tie of the last digit can't go either way
    mode, repo, kind = map(F.col, ("mode", "repo_id", "task_type"))
    return scored.groupingSets([(mode,), (repo, mode), (kind, mode)], repo, kind, mode).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("miss").cast("int")).alias("misses"), *means, r6(F.avg(F.when(F.col("json_parse_ok"), 1.0).otherwise(0.0)), "json_ok")
    )


def percentiles(scored: DataFrame, by: list[str], value: str = "latency_ms", points: dict[str, float] | None = None, ranges: int = 1024) -> DataFrame:
    """Percentiles by linear interpolation between two ranks (p50 and p95 unless given), exact; rows without a value don't count.

    Equal values are counted before anything is shuffled, and a group's values
    are parted into ranges between its least and its greatest. Running sums over
    the ranges' counts tell which range holds a rank; only those ranges' values
    are put in order, so no task gets all values of a group.
    """
    points = points or {"p50_ms": 0.5, "p95_ms": 0.95}
    v, n = F.col("v"), F.col("n")
    counted = scored.groupBy(F.struct(*by).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))  # nulls inside a struct are equal in a join
    totals = counted.groupBy("g").agg(F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("n_timed"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * ranges)).otherwise(0).cast("int")
    timed = counted.where("v is not null").join(totals.select("g", "low", "high"), "g").select("g", "v", "n", place.alias("part"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of ranges, at most so many
    parts = timed.groupBy("g", "part").agg(F.sum("n").alias("in_part")).withColumn("before", F.coalesce(F.sum("in_part").over(before), F.lit(0)))
    rank = lambda p: F.lit(float(p)) * (F.col("n_timed") - 1)
    sides = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(i).alias("side"), f(rank(p)).cast("long").alias("at")) for name, p in points.items() for i, f in enumerate((F.floor, F.ceil))])
    asked = totals.where("n_timed > 0").select("g", F.explode(sides).alias("a")).select("g", "a.*")
    held = parts.join(asked, "g").where("before <= at and at < before + in_part").select("g", "part", "before", "name", "side", "at")
    so_far = F.col("before") + F.sum("n").over(Window.partitionBy("g", "part", "name", "side").orderBy("v"))
    at_rank = timed.join(held, ["g", "part"]).withColumn("so_far", so_far).where("so_far > at").groupBy("g", "name", "side").agg(F.min("v").cast("double").alias("v"))
    wide = at_rank.groupBy("g").agg(*[F.max(F.when((F.col("name") == name) & (F.col("side") == i), v)).alias(f"_{name}_{i}") for name in points for i in (0, 1)])
    found = totals.join(wide, "g", "left")
    between = lambda name, p: F.col(f"_{name}_0") + (F.col(f"_{name}_1") - F.col(f"_{name}_0")) * (rank(p) - F.floor(rank(p)))
    return found.select(*[F.col("g")[c].alias(c) for c in by], *[r6(between(name, p), name) for name, p in points.items()], "n_timed")


def mode_lists(scored: DataFrame, ranked: DataFrame, judged: DataFrame, base: str = "C", other: str = "D", limit: int = 20) -> DataFrame:
    """(list, place, task_id, repo_id, task_type, query, base_hit, other_hit, base_top, other_top, latency_delta, irrelevant): one mode against another.

    ``win``: the other mode finds what the base misses, by task type and task;
    ``regression``: the base is right at once and the other isn't, by task;
    ``bad_promotion``: irrelevant files that only the other brings up, by
    repository and task. Each list ends after ``limit`` rows.
    """
    top = ranked.where(F.col("mode").isin(base, other) & (F.col("pos") <= K)).join(judged.select("task_id", "path", "label"), ["task_id", "path"], "left")
    paths = top.groupBy("task_id", "mode").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") <= 3, F.struct("pos", "path")))), lambda x: x["path"]), "\n").alias("top"), F.collect_set(F.when(F.col("label") == "irrelevant", F.col("path"))).alias("bad")
    )
    side = lambda m, name: scored.where(F.col("mode") == m).join(paths, ["task_id", "mode"], "left").select(
        "task_id", *[F.col(c).alias(f"{c}_{name}") for c in ("repo_id", "task_type", "query", "miss", "hit1", "hit8", "latency_ms")], F.coalesce("top", F.lit("")).alias(f"top_{name}"), F.coalesce("bad", F.array().cast("array<string>")).alias(f"bad_{name}")
    )
    both = side(base, "a").join(side(other, "b"), "task_id").withColumn("new", F.array_sort(F.array_except("bad_b", "bad_a")))
    none = F.lit(None)

    def listed(name: str, when: Column, order: list[str], *columns: Column) -> DataFrame:
        rows = both.where(when).orderBy(*order).limit(limit)
        place = F.row_number().over(Window.orderBy(*order)).alias("place")  # of at most ``limit`` rows
        return rows.select(F.lit(name).alias("list"), place, "task_id", F.col("repo_id_a").alias("repo_id"), F.col("task_type_a").alias("task_type"), F.col("query_a").alias("query"), *columns)

    details = lambda hit: [F.col(f"{hit}_a").alias("base_hit"), F.col(f"{hit}_b").alias("other_hit"), F.col("top_a").alias("base_top"), F.col("top_b").alias("other_top"), (F.col("latency_ms_b") - F.col("latency_ms_a")).alias("latency_delta"), F.lit("").alias("irrelevant")]
    wins = listed("win", F.col("miss_a") & ~F.col("miss_b"), ["task_type_a", "task_id"], *details("hit8"))
    losses = listed("regression", (F.col("hit1_a") == 1) & (F.col("hit1_b") != 1), ["task_id"], *details("hit1"))
    bad = listed("bad_promotion", F.size("new") > 0, ["repo_id_a", "task_id"], none.cast("double").alias("base_hit"), none.cast("double").alias("other_hit"), F.lit("").alias("base_top"), F.lit("").alias("other_top"), none.cast("long").alias("latency_delta"), F.array_join("new", "\n").alias("irrelevant"))
    return wins.unionByName(losses).unionByName(bad)


def compare(scored: DataFrame, ranked: DataFrame, judged: DataFrame, base: str = "C", other: str = "D") -> DataFrame:
    """(task_id, task_type, helpful, bad_promotion, regression, latency_delta): one mode against another, task by task."""
    tops = ranked.where(F.col("pos") <= K).join(judged, ["task_id", "path"]).groupBy("task_id", "mode").agg(
        F.max(F.col("label").isin(S.HIT_LABELS)).alias("has_hit"), F.collect_set(F.when(F.col("label") == "irrelevant", F.col("path"))).alias("bad")
    )
    side = lambda m: scored.where(F.col("mode") == m).join(tops, ["task_id", "mode"], "left").select(
        "task_id", "task_type", F.coalesce("has_hit", F.lit(False)).alias(f"hit_{m}"), F.coalesce("bad", F.array().cast("array<string>")).alias(f"bad_{m}"), F.col("hit1").alias(f"hit1_{m}"), F.col("latency_ms").alias(f"ms_{m}")
    )
    both = side(base).join(side(other).drop("task_type"), "task_id")
    return both.select(
        "task_id", "task_type",
        (F.col(f"hit_{other}") & ~F.col(f"hit_{base}")).alias("helpful"),
        (F.size(F.array_except(f"bad_{other}", f"bad_{base}")) > 0).alias("bad_promotion"),
        ((F.col(f"hit1_{base}") == 1) & (F.col(f"hit1_{other}") != 1)).alias("regression"),
        (F.col(f"ms_{other}") - F.col(f"ms_{base}")).alias("latency_delta"),
    )


def compare_rates(compared: DataFrame) -> DataFrame:
    """Rates of the comparison, overall (task_type null) and by task type."""
    rate = lambda c: r6(F.avg(F.col(c).cast("double")), f"{c}_rate")
    aggs = [F.count(F.lit(1)).alias("n"), rate("helpful"), rate("bad_promotion"), rate("regression"), r6(F.percentile("latency_delta", F.lit(0.5)), "delta_p50")]
    return compared.groupBy("task_type").agg(*aggs).unionByName(compared.agg(*aggs).withColumn("task_type", F.lit(None).cast("string")))


def gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, value, op, threshold, passed): rules (name, op, threshold) on metrics (name, value); a missing value fails."""
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") == F.col("threshold"))
    return rules.join(metrics, "name", "left").select("name", "value", "op", "threshold", F.coalesce(ok, F.lit(False)).alias("passed"))


def demotions(ranked: DataFrame, base: str, other: str, limit: int = 30) -> DataFrame:
    """(task_id, rank): tasks whose best file of one mode is lower in the other's list."""
    best = ranked.where((F.col("mode") == base) & (F.col("pos") == 1)).select("task_id", "path")
    there = ranked.where((F.col("mode") == other) & (F.col("pos") > 1)).select("task_id", "path", F.col("pos").alias("rank"))
    return best.join(there, ["task_id", "path"]).select("task_id", "rank").orderBy("task_id").limit(limit)


def no_hit(scored: DataFrame, limit: int = 30) -> DataFrame:
    """Tasks that every mode misses."""
    modes = F.array_join(F.array_sort(F.collect_set("mode")), ",")
    return scored.groupBy("task_id", "repo_id", "task_type").agg(F.min("miss").alias("all_miss"), modes.alias("modes")).where("all_miss").drop("all_miss").orderBy("repo_id", "task_id").limit(limit)


def slowest(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.where("latency_ms is not null").select("task_id", "mode", "latency_ms").orderBy(F.desc("latency_ms"), "task_id", "mode").limit(limit)


def violations(tasks: DataFrame, labels: DataFrame) -> DataFrame:
    """(severity, message) of tasks (task_id, repo_id, query) and label rows (task_id, repo_id, path, label)."""
    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    tid, missing = F.col("task_id"), lambda c: F.col(c).isNull() | (F.col(c) == "")
    error = lambda df, when, message: df.where(when).select(F.lit("error").alias("severity"), message.alias("message"))
    name = F.coalesce(tid, F.lit("None"))  # how a missing id is written
    known = tasks.where(tid.isNotNull()).select("task_id", F.col("repo_id").alias("task_repo"))
    joined = labels.join(known, "task_id", "left")
    path = F.col("path")
    absolute = path.startswith("/") | path.contains("\\") | (F.substring(path, 2, 1) == ":")
    rows = [
        error(tasks, missing("task_id"), F.lit("task missing task_id")),
        error(tasks, missing("repo_id"), text(name, ": missing repo_id")),
        error(tasks, missing("query"), text(name, ": missing query")),
        error(labels.join(known, "task_id", "left_anti"), F.lit(True), text("label references unknown task_id: ", tid)).distinct(),
        error(joined, F.col("task_repo").isNotNull() & ~F.col("repo_id").eqNullSafe(F.col("task_repo")), text(tid, ": label repo_id != task repo_id")).distinct(),
        error(labels, ~F.coalesce(F.col("label").isin(list(S.GAIN)), F.lit(False)), text(tid, ": invalid label '", F.coalesce("label", F.lit("")), "' for ", F.coalesce(path, F.lit("")))),
        error(labels, missing("path"), text(tid, ": label entry missing path")),
        error(labels, ~missing("path") & absolute, text(tid, ": path must be repo-relative forward-slash: ", path)),
        tasks.join(labels, "task_id", "left_anti").where(~F.upper(tid).startswith("EXAMPLE")).select(F.lit("warning").alias("severity"), text(tid, ": no labels").alias("message")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
