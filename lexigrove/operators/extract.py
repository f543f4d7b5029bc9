"""Symbols of single source lines from patterns; ``items`` reads whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.roles import language
from ..functions.text import shorten

#: (language, pattern with the name as its group, kind), first match wins. Lines at item level only: no leading space.
PATTERNS = [
    ("rust", r"^(?:pub(?:\([a-z]+\))? )?(?:async |unsafe |const )*fn ([A-Za-z_][A-Za-z0-9_]*)", "function"),
    ("rust", r"^(?:pub(?:\([a-z]+\))? )?struct ([A-Za-z_][A-Za-z0-9_]*)", "struct"),
    ("rust", r"^(?:pub(?:\([a-z]+\))? )?enum ([A-Za-z_][A-Za-z0-9_]*)", "enum"),
    ("rust", r"^(?:pub(?:\([a-z]+\))? )?trait ([A-Za-z_][A-Za-z0-9_]*)", "trait"),
    ("rust", r"^(?:pub(?:\([a-z]+\))? )?type ([A-Za-z_][A-Za-z0-9_]*)", "type_alias"),
    ("rust", r"^(?:pub(?:\([a-z]+\))? )?const ([A-Za-z_][A-Za-z0-9_]*)", "const"),
    ("rust", r"^(?:pub(?:\([a-z]+\))? )?static (?:mut )?([A-Za-z_][A-Za-z0-9_]*)", "static"),
    ("rust", r"^(?:pub(?:\([a-z]+\))? )?mod ([A-Za-z_][A-Za-z0-9_]*)", "module"),
    ("rust", r"^impl(?:<[^>]*>)? (?:[A-Za-z0-9_:<>]+ for )?([A-Za-z_][A-Za-z0-9_]*)", "impl"),
    ("python", r"^class ([A-Za-z_][A-Za-z0-9_]*)", "struct"),
    ("python", r"^(?:async )?def ([A-Za-z_][A-Za-z0-9_]*)", "function"),
    ("script", r"^(?:export )?(?:default )?(?:async )?function\*? ([A-Za-z_$][A-Za-z0-9_$]*)", "function"),
    ("script", r"^(?:export )?(?:default )?class ([A-Za-z_$][A-Za-z0-9_$]*)", "struct"),
    ("script", r"^(?:export )?const ([A-Za-z_$][A-Za-z0-9_$]*) = (?:async )?(?:\(|function)", "function"),
    ("script", r"^(?:export )?const ([A-Za-z_$][A-Za-z0-9_$]*) = class", "struct"),
    ("go", r"^func (?:\([^)]*\) )?([A-Za-z_][A-Za-z0-9_]*)", "function"),
    ("go", r"^type ([A-Za-z_][A-Za-z0-9_]*) struct", "struct"),
    ("go", r"^type ([A-Za-z_][A-Za-z0-9_]*) interface", "trait"),
    ("go", r"^type ([A-Za-z_][A-Za-z0-9_]*)", "type_alias"),
    ("go", r"^const ([A-Za-z_][A-Za-z0-9_]*)", "const"),
    ("go", r"^var ([A-Za-z_][A-Za-z0-9_]*)", "static"),
]


def family(path: Column) -> Column:
    lang = language(path)
    return F.when(lang.isin("typescript", "tsx", "javascript"), "script").otherwise(lang)


def _first(hits: list[Column]) -> Column:
    """The first match as a generated row: lines with none give none, and the patterns stay one expression in the plan."""
    return F.explode(F.slice(F.array_compact(F.array(*hits)), 1, 1)).alias("hit")


def symbols(lines: DataFrame) -> DataFrame:
    """(path, line_number, name, kind, visibility, signature) of item-level definitions in source lines (path, line_number, line)."""
    of = lines.withColumn("family", family(F.col("path")))
    hits = [F.when((F.col("family") == lang) & F.col("line").rlike(p), F.struct(F.regexp_extract("line", p, 1).alias("name"), F.lit(what).alias("kind"))) for lang, p, what in PATTERNS]
    found = of.select("path", "line_number", "line", "family", _first(hits)).select("path", "line_number", "line", "family", "hit.name", "hit.kind")
    public = (
        F.when(F.col("family") == "rust", F.col("line").startswith("pub ") | F.col("line").startswith("pub("))
        .when(F.col("family") == "python", ~F.col("name").startswith("_"))
        .when(F.col("family") == "script", F.col("line").startswith("export ") & ~F.col("name").startswith("_"))
        .otherwise(True)
    )
    return found.select("path", "line_number", "name", "kind", F.when(public, "public").otherwise("private").alias("visibility"), shorten(F.col("line"), S.SIGNATURE_WIDTH).alias("signature"))


def identifier_refs(lines: DataFrame, defined: DataFrame) -> DataFrame:
    """(path, name, n): uses of names that exactly one symbol defines, outside its defining lines."""
    known = defined.groupBy("name").agg(F.count(F.lit(1)).alias("defs"), F.min("path").alias("target")).where("defs = 1")
    uses = lines.select("path", "line_number", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("name"))
    uses = uses.join(defined.select("path", "line_number").distinct(), ["path", "line_number"], "left_anti")
    return uses.join(known, "name").groupBy("path", "name", "target").agg(F.count(F.lit(1)).alias("n"))
