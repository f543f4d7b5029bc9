"""Lexical statistics and BM25."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T


def lexical_rows(files: DataFrame, limit: int = S.TERMS_PER_FILE) -> DataFrame:
    """(path, doc_length, terms): what an index stores of a file; all tokens count towards the length, the commonest are kept.

    A file is one row, so its terms are counted in it and nothing is shuffled.
    """
    both = T.let(T.lexical_terms(F.col("text")), lambda t: F.struct(F.size(t).alias("doc_length"), T.term_counts(t, limit).alias("terms")))
    return files.select("path", both.alias("lex")).select("path", "lex.doc_length", "lex.terms")


def doc_lengths(files: DataFrame) -> DataFrame:
    """(path, doc_length): all tokens count, also those beyond the kept terms."""
    return files.select("path", F.size(T.lexical_terms(F.col("text"))).alias("doc_length"))


def postings(files: DataFrame, limit: int = S.TERMS_PER_FILE) -> DataFrame:
    """(path, term, tf): the commonest terms of each file, ties by term."""
    return lexical_rows(files, limit).select("path", F.explode("terms").alias("x")).select("path", "x.term", "x.tf")


def index_stats(files: DataFrame) -> DataFrame:
    """One row: (lex_file_count, avg_doc_length)."""
    return doc_lengths(files).agg(F.count(F.lit(1)).alias("lex_file_count"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"))


def document_frequency(posts: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df) of the query's terms, at least 1."""
    wanted = posts.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    counts = posts.where(F.col("term").isin(list(dict.fromkeys(terms)))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return wanted.join(counts, "term", "left").select("term", F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)).alias("df"))


def bm25_term(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1), F.lit(0.0))
    return idf * (tf * (S.BM25_K1 + 1) / (tf + S.BM25_K1 * ((1 - S.BM25_B) + S.BM25_B * length / average)))


def bm25(files: DataFrame, terms: list[str]) -> DataFrame:
    """(path, score, lex_file_count, lexical_terms): BM25 of the query's terms; repeated query terms count again.

    One pass counts files, lengths and the terms' files into one row; the other
    scores the files that can hold a term.
    """
    wanted = list(dict.fromkeys(terms))
    rows = lexical_rows(files)
    tf = lambda t: F.get(F.filter("terms", lambda x: x["term"] == t), F.lit(0))["tf"]
    stats = rows.agg(
        F.count(F.lit(1)).alias("lex_file_count"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"),
        *[F.greatest(F.count(tf(t)), F.lit(1)).alias(f"df_{i}") for i, t in enumerate(wanted)],
    )
    low = T.ascii_lower(F.col("text"))
    some = lexical_rows(files.where(reduce(or_, [low.contains(t) for t in wanted], F.lit(False)))).join(F.broadcast(stats))  # stats is one row
    return bm25_of(some.withColumns({f"tf_{i}": tf(t) for i, t in enumerate(wanted)}), terms, wanted)


def bm25_of(rows: DataFrame, terms: list[str], wanted: list[str]) -> DataFrame:
    """Scores of rows (path, doc_length, lex_file_count, avg_doc_length, and tf_i and df_i of each wanted term)."""
    raw = F.lit(0.0)
    for t in terms:
        i = wanted.index(t)
        part = bm25_term(F.col(f"tf_{i}"), F.col(f"df_{i}"), F.col("lex_file_count").cast("double"), F.col("doc_length"), F.col("avg_doc_length"))
        raw = raw + F.coalesce(part, F.lit(0.0))
    held = F.array_compact(F.array(*[F.when(F.col(f"tf_{wanted.index(t)}").isNotNull(), F.lit(t)) for t in terms], F.lit(None).cast("string")))
    some = rows.where((F.col("avg_doc_length") > 0) & (F.col("doc_length") > 0) & (F.size(held) > 0))
    return some.select("path", raw.alias("score"), "lex_file_count", F.array_join(held, ", ").alias("lexical_terms"))


def top_k(scored: DataFrame, k: int = S.CANDIDATE_LIMIT) -> DataFrame:
    """The best k, ties by path; the score is rounded first so that the order of sums can't decide."""
    return scored.select("path", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "path").limit(k)
