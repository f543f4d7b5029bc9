"""What evaluation reads and writes: lines of JSON, outputs of searches, filters of a run, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm_path(path: Column) -> Column:
    """A path with forward slashes and without a leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def json_rows(lines: DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines (value): a byte-order mark and blank lines are passed over; a line that is no JSON is an error, or is left out."""
    text = F.trim(F.regexp_replace("value", "^﻿", ""))
    some = lines.select(text.alias("value")).where("value <> ''")
    parsed = some.select("value", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    # a filter may be evaluated together with others, so a blank line is ruled out here too
    bad = (F.col("value") != "") & (F.col("r").isNull() | F.col("r._corrupt").isNotNull())
    rows = parsed.select(F.when(bad, F.raise_error(F.concat(F.lit("invalid JSON: "), "value"))).otherwise(F.col("r")).alias("r")) if strict else parsed.where(~bad).select("r")
    return rows.select("r.*").drop("_corrupt")


def required(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that have every required field."""
    return rows.dropna(subset=fields)


def selected(tasks: DataFrame, repos: list[str] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Tasks of the named repositories, and of those that have labels if only these are asked for."""
    out = tasks.where(F.col("repo_id").isin(repos)) if repos else tasks
    return out.join(labelled.select("task_id").distinct(), "task_id", "left_semi") if labelled is not None else out


def surviving_repos(repos: DataFrame, tasks: DataFrame) -> DataFrame:
    """The repositories that some selected task names."""
    return repos.join(tasks.select("repo_id").where("repo_id is not null").distinct(), "repo_id", "left_semi")


def found_paths(outputs: DataFrame) -> DataFrame:
    """(run, ok, paths, semantic_status) of search outputs (run, text); an empty or broken text is not ok and has no paths."""
    kind = "struct<candidates:array<struct<path:string>>,coverage:struct<semantic_status:string>,_corrupt:string>"
    r = F.from_json("text", kind, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = outputs.select("run", F.when(F.trim("text") != "", r).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    paths = F.transform("r.candidates", lambda c: norm_path(c["path"]))
    return parsed.select("run", ok.alias("ok"), F.when(ok, F.coalesce(paths, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("paths"), F.when(ok, F.col("r.coverage.semantic_status")).alias("semantic_status"))


def path_list(value: Column) -> Column:
    """A JSON value that is one path or a list of paths, as a list of normal paths without nulls."""
    many = F.filter(F.from_json(value, "array<string>"), lambda p: p.isNotNull())
    one = F.get_json_object(F.concat(F.lit('{"v": '), value, F.lit("}")), "$.v")
    return F.transform(F.when(value.isNull() | (value == "null"), F.array().cast("array<string>")).when(value.startswith("["), many).otherwise(F.array(one)), norm_path)


def fan_out(ranked: DataFrame, base: str, others: list[str]) -> DataFrame:
    """(task_id, path, pos_<mode>...): where the best file of one mode is in the lists of the others; 0 where it isn't."""
    best = ranked.where((F.col("mode") == base) & (F.col("pos") == 1)).select("task_id", "path")
    there = ranked.where(F.col("mode").isin(others)).join(best, ["task_id", "path"])
    at = there.groupBy("task_id", "path").agg(*[F.max(F.when(F.col("mode") == m, F.col("pos"))).alias(f"pos_{m}") for m in others])
    return best.join(at, ["task_id", "path"], "left").na.fill(0, [f"pos_{m}" for m in others])


def write_summary(summary: DataFrame, folder: str) -> None:
    """A summary as CSV with a header, and as JSON; it is a few rows."""
    few = summary.coalesce(1)
    few.write.mode("overwrite").option("header", "true").csv(f"{folder}/csv")
    few.write.mode("overwrite").json(f"{folder}/json")
