"""Line scans, match clusters and coverage."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T


@dataclass
class Query:
    """A query and what the operators derive from it once."""

    raw: str
    phrase: str = field(init=False)
    squashed: str = field(init=False)
    terms: list[str] = field(init=False)
    lex_tokens: list[str] = field(init=False)
    patterns: list[str] = field(init=False)
    identifier_like: bool = field(init=False)
    expansion: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.raw = self.raw.strip()
        self.phrase = " ".join(self.raw.lower().split())
        self.squashed = re.sub("[^A-Za-z0-9]", "", self.phrase).lower()
        parts = [t.translate(str.maketrans(T.UPPER, T.LOWER)) for t in re.split(T.BOUNDARY, self.raw)]
        parts = [t for t in parts if len(t.encode()) >= 2]
        self.lex_tokens = [t for t in parts if len(t.encode()) >= 3 and not re.fullmatch("[0-9]+", t)]
        self.terms = sorted(set(parts))
        self.patterns = list(dict.fromkeys(parts + ([self.phrase] if len(self.phrase) > 1 else [])))
        self.identifier_like = any(x in self.raw for x in ("_", "--", "::", "/")) or bool(re.search("[A-Z]", self.raw)) or any(len(t.encode()) >= 6 and t in self.raw for t in self.terms)
        self.expansion = self.terms if self.identifier_like and " " not in self.raw and len(self.terms) >= 2 else []


def lines_of(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, line_number, line) of the files that hold any of the strings; others are not split into lines."""
    text = F.lower(F.col("text"))
    some = files.where(reduce(or_, [text.contains(p) for p in patterns], F.lit(False)))
    return some.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_number"), "line")


def line_scan(lines: DataFrame, patterns: list[str], cap: int = S.MATCH_LIMIT) -> DataFrame:
    """(path, line_number, snippet): lines with any of the strings, case ignored, the first ``cap`` of each file."""
    line = F.lower(F.col("line"))
    hits = lines.where(reduce(or_, [line.contains(p) for p in patterns]))
    order = Window.partitionBy("path").orderBy("line_number")
    return hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).select("path", "line_number", F.col("line").alias("snippet"))


def two_pass(lines: DataFrame, query: Query, cap: int = S.MATCH_LIMIT) -> DataFrame:
    """Phrase matches and token matches, each with its own cap, as one scan and one shuffle."""
    line = F.lower(F.col("line"))
    phrase, token = line.contains(query.phrase), reduce(or_, [line.contains(p) for p in query.patterns], F.lit(False))
    hits = lines.where(phrase | token).withColumns({"phrase": phrase.cast("int"), "token": token.cast("int")})
    so_far = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = hits.withColumns({"n_phrase": F.sum("phrase").over(so_far), "n_token": F.sum("token").over(so_far)})
    kept = ((F.col("phrase") == 1) & (F.col("n_phrase") <= cap)) | ((F.col("token") == 1) & (F.col("n_token") <= cap))
    return counted.where(kept).select("path", "line_number", F.col("line").alias("snippet"))


def coverage(matches: DataFrame) -> DataFrame:
    """One row: distinct matches, files, and whether a file reached the cap."""
    per_file = matches.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_matches"), F.count(F.lit(1)).alias("files"), F.coalesce(F.max("n") >= S.MATCH_LIMIT, F.lit(False)).alias("limit_hit"))


def baseline_ranking(lines: DataFrame, query: Query) -> DataFrame:
    """(path, matches): the files with most matching lines."""
    line = F.lower(F.col("line"))
    counts = lines.where(reduce(or_, [line.contains(p) for p in query.patterns])).groupBy("path").agg(F.count(F.lit(1)).alias("matches"))
    return counts.orderBy(F.desc("matches"), "path").limit(S.CANDIDATE_LIMIT)


def clusters(matches: DataFrame) -> DataFrame:
    """(path, cluster, start_line, end_line, items): a match joins the cluster that ended at most two lines before it."""
    order = Window.partitionBy("path").orderBy("line_number", "snippet")
    gap = F.coalesce((F.col("line_number") > F.lag("line_number").over(order) + 2).cast("int"), F.lit(0))
    numbered = matches.withColumn("gap", gap).withColumn("cluster", F.sum("gap").over(order))
    return numbered.groupBy("path", "cluster").agg(
        F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"), F.array_sort(F.collect_list(F.struct("line_number", "snippet"))).alias("items")
    )


def line_ranges(matches: DataFrame) -> DataFrame:
    """(path, ranges): matched lines as runs of consecutive numbers, written ``a-b``."""
    distinct = matches.select("path", "line_number").distinct()
    island = F.col("line_number") - F.row_number().over(Window.partitionBy("path").orderBy("line_number"))
    runs = distinct.withColumn("island", island).groupBy("path", "island").agg(F.min("line_number").alias("a"), F.max("line_number").alias("b"))
    one = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    sorted_runs = F.array_sort(F.collect_list(F.struct("a", one.alias("text"))))
    return runs.groupBy("path").agg(F.array_join(F.transform(sorted_runs, lambda x: x["text"]), ", ").alias("ranges"))
