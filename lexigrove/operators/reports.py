"""Reports of the commands as nested rows, and their JSON form.

A report is one row (of ``map``, one a file) with arrays of structs; the schema
is that of the DataFrame, so a reader gets back what was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.roles import index_role
from . import graph


def to_json(report: DataFrame) -> DataFrame:
    """(json): each row as one line of JSON; nulls are written, so that every field is there."""
    return report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(lines: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of lines of JSON, with the schema of a report."""
    return lines.select(F.from_json("json", like.schema).alias("r")).select("r.*")


def write(report: DataFrame, folder: str) -> None:
    """Reports as files with a line of JSON each."""
    to_json(report).write.mode("overwrite").text(folder)


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return from_json(spark.read.text(folder).withColumnRenamed("value", "json"), like)


def map_documents(files: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = S.DISPLAY_LIMIT) -> DataFrame:
    """(path, role, symbols, outgoing_edges, incoming_edges, connection_counts) of every file: its first symbols and edges, and the numbers of all.

    Only the first of a file are collected; what they are is decided before.
    """

    def firsts(df: DataFrame, key: str, order: list, fields: list[str], name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        kept = df.withColumn("_p", place).where(F.col("_p") <= limit)
        rows = F.transform(F.array_sort(F.collect_list(F.struct("_p", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
        return kept.groupBy(F.col(key).alias("path")).agg(rows.alias(name))

    by_kind = [graph.rank_of(F.col("edge_type"), S.EDGE_ORDER), "edge_type"]
    ends = lambda side, inc: edges.select(F.col(side).alias("path"), "edge_type", F.lit(inc).alias("inc"))
    by_type = ends("src", 0).unionByName(ends("dst", 1)).groupBy("path", "edge_type").agg(F.sum("inc").alias("incoming"), F.sum(1 - F.col("inc")).alias("outgoing"))
    types = F.array_sort(F.collect_list(F.struct("edge_type", (F.col("incoming") + F.col("outgoing")).alias("n"))))  # a handful of types
    counts = by_type.groupBy("path").agg(F.struct(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"), types.alias("by_type")).alias("connection_counts"))
    fields = ["edge_type", "src", "dst", "confidence", "reason"]
    parts = [
        firsts(symbols, "file_path", ["line_number", "name", "kind"], ["line_number", "name", "kind", "visibility"], "symbols"),
        firsts(edges, "src", [*by_kind, "dst", "reason"], fields, "outgoing_edges"),
        firsts(edges, "dst", [*by_kind, "src", "reason"], fields, "incoming_edges"),
        counts,
    ]
    out = files.select("path", index_role(F.col("path")).alias("role"))
    for p in parts:
        out = out.join(p, "path", "left")
    return out.select("path", "role", *[F.coalesce(c, F.array()).alias(c) for c in ("symbols", "outgoing_edges", "incoming_edges")], "connection_counts")


def symbol_document(symbols: DataFrame, refs: DataFrame, name: str, limit: int = S.DISPLAY_LIMIT) -> DataFrame:
    """One row (query, match_mode, matches): the first definitions of the best tier, each with how often and from how many files it is used."""
    found = graph.lookup(symbols, name)
    order = Window.orderBy(graph.rank_of(F.col("kind"), S.KIND_ORDER), "file_path", "line_number", "name")
    first = found.orderBy(graph.rank_of(F.col("kind"), S.KIND_ORDER), "file_path", "line_number", "name").limit(limit).withColumn("rank", F.row_number().over(order))  # of ``limit`` rows
    uses = graph.symbol_uses(first, refs.join(F.broadcast(first.select(F.col("name").alias("symbol_name")).distinct()), "symbol_name", "left_semi"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "name", "kind", "file_path", "line_number", "visibility", "n_uses", "n_files")))
    modes = F.element_at(F.array(*map(F.lit, ("exact", "case_insensitive", "substring"))), F.min("tier") + 1)
    return first.join(uses, ["name", "file_path"]).agg(F.coalesce(modes, F.lit("none")).alias("match_mode"), rows.alias("matches")).select(F.lit(name).alias("query"), "match_mode", "matches")


def related_document(edges: DataFrame, refs: DataFrame, focus: DataFrame, query: str) -> DataFrame:
    """One row (query, related_files): the nearest files with every reason."""
    return _list(graph.related(edges, refs, focus, listed=True), query, "related_files")


def blast_document(edges: DataFrame, refs: DataFrame, focus: DataFrame, query: str, limit: int = S.DISPLAY_LIMIT) -> DataFrame:
    """One row (query, impacted_files): what a change reaches, nearest first, with every reason; ``limit`` of them."""
    nearest = [graph.rank_of(F.col("context"), S.IMPACT_ORDER), F.desc("score"), graph.rank_of(F.col("confidence"), ["high", "medium", "low"]), F.col("path")]
    return _list(graph.impact(edges, refs, focus, listed=True).orderBy(*nearest).limit(limit), query, "impacted_files")


def _list(rows: DataFrame, query: str, name: str) -> DataFrame:
    return rows.agg(F.array_sort(F.collect_list(F.struct("path", *[c for c in rows.columns if c != "path"]))).alias(name)).select(F.lit(query).alias("query"), name)
