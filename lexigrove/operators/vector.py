"""Cosine search and its fusion with lexical candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a side is zero, within [-1, 1]."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.least(dot(a, b) / norms, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)


def top_cosine(vectors: DataFrame, query: DataFrame, k: int = S.SEMANTIC_TOP, floor: float = S.COSINE_FLOOR) -> DataFrame:
    """(path, similarity): the vectors nearest to the one query vector."""
    q = F.broadcast(query.select(F.col("embedding").alias("q")).limit(1))  # one row
    scored = vectors.join(q).select("path", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return scored.where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), "path").limit(k)


def fuse(candidates: DataFrame, semantic: DataFrame, annotate_only: bool = False) -> DataFrame:
    """(path, score, confidence, is_new): similarity added to candidates, and new candidates from it.

    An identifier query only annotates: scores stay and nothing is added.
    """
    both = candidates.join(semantic, "path", "left" if annotate_only else "full_outer")
    sim = F.coalesce("similarity", F.lit(0.0))
    known = F.col("score").isNotNull()
    total = F.col("score") if annotate_only else F.when(known, F.col("score") + F.lit(0.3) * sim).otherwise(F.lit(0.8) * sim)
    confidence = F.when(known, F.col("confidence")).when(sim >= 0.6, "medium").otherwise("low")
    out = both.select("path", F.round(total, 6).alias("score"), confidence.alias("confidence"), (~known).alias("is_new"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("anchor", "symbol_anchor") if c in candidates.columns])
    return out.orderBy(F.desc("score"), "path").limit(S.CANDIDATE_LIMIT)


def guard(candidates: DataFrame) -> DataFrame:
    """Candidates that are no anchor fall below the best one: phrase anchors first, then symbol anchors (``symbol_anchor``, if given).

    Both heights are taken before either cap.
    """
    kinds = [c for c in ("anchor", "symbol_anchor") if c in candidates.columns]
    best = candidates.agg(*[F.max(F.when(F.col(c), F.col("score"))).alias(f"best_{c}") for c in kinds])
    out = candidates.join(F.broadcast(best))  # one row
    for c in kinds:
        high = F.col(f"best_{c}")
        capped = high.isNotNull() & ~F.col(c) & (F.col("score") >= high - 1e-9)
        out = out.withColumn("score", F.when(capped, F.greatest(F.round(high - 0.01, 6), F.lit(0.0))).otherwise(F.col("score")))
    return out.drop(*[f"best_{c}" for c in kinds])


def is_identifier(query: str) -> bool:
    """Whether a query is one identifier: an underscore, or an upper-case letter after the first character."""
    return not any(c.isspace() for c in query) and ("_" in query or any(c.isupper() for c in query[1:]))


def strong_symbol_anchor(role: Column, evidence: Column, is_fixture: Column, query: str) -> Column:
    """A source or config file that defines the very symbol that is asked for, in whatever case."""
    wanted = ("defines symbol " + query).lower()
    return role.isin("source", "config") & ~is_fixture & F.exists(evidence, lambda x: (x["type"] == "indexed_symbol_definition") & (F.lower(x["detail"]) == wanted))


def anchored(candidates: DataFrame, query: str) -> DataFrame:
    """Candidates (path, role, evidence, ...) with ``anchor`` and ``symbol_anchor``, from their evidence: the exact phrase, or the definition of the symbol, in source or config files that don't look like fixtures."""
    has = lambda kind: F.exists("evidence", lambda x: x["type"] == kind)
    phrase = F.col("role").isin("source", "config") & has("exact_phrase_match") & ~has("fixture_like_match")
    return candidates.withColumns({"anchor": phrase, "symbol_anchor": strong_symbol_anchor(F.col("role"), F.col("evidence"), has("fixture_like_match"), query)})


def rerank(candidates: DataFrame, semantic: DataFrame, query: str) -> DataFrame:
    """(path, score, confidence, is_new, anchor, symbol_anchor): candidates with similarities added; no anchor is displaced, and a query of one identifier only annotates."""
    return guard(fuse(anchored(candidates, query).select("path", "score", "confidence", "anchor", "symbol_anchor"), semantic, is_identifier(query)))


def documents(files: DataFrame, symbols: DataFrame, role: Column) -> DataFrame:
    """(path, document): what an embedding model reads of a file: path, role, symbols and the beginning of its text."""
    names = symbols.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "name"))), lambda x: x["name"]), ", ").alias("names"))
    listed = F.when(F.col("names").isNotNull(), F.concat(F.lit("symbols: "), F.col("names"), F.lit("\n"))).otherwise(F.lit(""))
    text = F.concat(F.lit("path: "), F.col("path"), F.lit("\nrole: "), role, F.lit("\n"), listed, F.lit("---\n"), F.substring(F.coalesce("text", F.lit("")), 1, S.PREVIEW_CHARS))
    return files.join(names, "path", "left").select("path", text.alias("document"))
