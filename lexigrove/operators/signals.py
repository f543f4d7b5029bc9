"""What an index knows of a file for a query: definitions, references and edges, the best few of them."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import roles as R
from ..functions import text as T
from .graph import rank_of, weight_of
from .scan import Query

DEFINITION, REFERENCE, EDGE = "indexed_symbol_definition", "indexed_symbol_reference", "indexed_edge"
EXACT, STRONG, LOOSE = 3, 2, 1


def strength(name: Column, q: Query) -> Column:
    """How well a symbol's name matches: EXACT, STRONG, LOOSE or null. With no terms at all every name is strong."""
    squashed, terms = T.squash(name), T.terms(name)
    never = F.lit(False)
    exact = ((squashed == q.squashed) if q.squashed else never) | ((T.normalize_phrase(name) == q.phrase) if q.phrase else never)
    strong = (squashed.contains(q.squashed) if q.squashed else never) | reduce(and_, [squashed.contains(t) for t in q.terms], F.lit(True))
    loose = reduce(or_, [F.array_contains(terms, t) for t in q.terms], never)
    return F.when(exact, EXACT).when(strong, STRONG).when(loose, LOOSE)


def definitions(symbols: DataFrame, q: Query, scale: float) -> DataFrame:
    """A signal for each matching definition of a file (name and line)."""
    found = symbols.withColumn("strength", strength(F.col("name"), q)).where("strength is not null")
    found = found.select(F.col("file_path").alias("path"), "name", "line_number", "strength").distinct().withColumn("role", R.rank_role(F.col("path")))
    source = F.col("role") == "source"
    exact = F.when(source & F.lit(q.identifier_like), S.EXACT_IDENTIFIER).otherwise(weight_of(F.col("role"), S.EXACT_DEFINITION))
    base = F.when(F.col("strength") == EXACT, exact).when(F.col("strength") == STRONG, S.STRONG_DEFINITION).otherwise(S.LOOSE_DEFINITION) * F.lit(scale)
    score = base + F.when((F.col("strength") == EXACT) & source, F.lit(S.EXACT_SOURCE_BONUS * scale)).otherwise(0.0)
    tier = F.when(F.col("strength") == EXACT, F.when(source, 5).otherwise(4)).when(F.col("strength") == STRONG, 3).otherwise(2)
    return found.select("path", F.lit(DEFINITION).alias("type"), F.concat(F.lit("defines symbol "), "name").alias("detail"), score.alias("score"), tier.alias("tier"), (EXACT - F.col("strength")).alias("level"))


def references(refs: DataFrame, q: Query, scale: float) -> DataFrame:
    """A signal for each reference (name, line, reason) that names what is asked; of equal ones the first by context and confidence."""
    low = F.lower("symbol_name")
    never = F.lit(False)
    terms = T.terms(F.col("symbol_name"))
    named = ((T.squash(low) == q.squashed) if q.squashed else never) | ((low == q.phrase) if q.phrase else never) | reduce(and_, [F.array_contains(terms, t) for t in q.terms], F.lit(True))
    order = F.struct(rank_of(F.col("context"), S.CONTEXT_ORDER).alias("a"), rank_of(F.col("confidence"), S.CONFIDENCE_ORDER).alias("b"))
    first = refs.where(named).groupBy(F.col("from_file").alias("path"), "symbol_name", "line_number", "reason").agg(F.min_by(F.struct("context", "confidence"), order).alias("x"))
    value = (weight_of(F.col("x.context"), S.REFERENCE) + weight_of(F.col("x.confidence"), S.REFERENCE_BONUS)) * F.lit(scale)
    tier = F.when(F.col("x.context") == "production", 2).when(F.col("x.context").isin("fixture", "test"), 1).otherwise(0)
    out = first.select("path", F.lit(REFERENCE).alias("type"), F.concat(F.lit("references symbol "), "symbol_name").alias("detail"), value.alias("score"), tier.alias("tier"), rank_of(F.col("x.confidence"), S.CONFIDENCE_ORDER).alias("level"))
    return out.where("score > 0")


def edges_of(edges: DataFrame, symbols: DataFrame, q: Query, scale: float) -> DataFrame:
    """A signal for each edge (type, ends) of a file, raised if what is at its other end answers the query.

    One of two columns equals the path: two selections in place of a disjunctive join.
    """
    out = edges.select(F.col("src").alias("path"), F.col("dst").alias("other"), "edge_type", "src", "dst", "reason")
    inc = edges.where("src <> dst").select(F.col("dst").alias("path"), F.col("src").alias("other"), "edge_type", "src", "dst", "reason")
    both = out.unionByName(inc).groupBy("path", "other", "edge_type", "src", "dst").agg(F.min("reason").alias("reason"))
    tokens = T.terms(F.col("other"))
    hit = lambda t: F.exists(tokens, lambda x: T.token_matches(x, t, T.singular_of(t)))
    n = reduce(add, [hit(t).cast("int") for t in q.terms], F.lit(0))
    matching = symbols.where(strength(F.col("name"), q).isNotNull()).select(F.col("file_path").alias("other")).distinct().withColumn("has_symbol", F.lit(True))
    area = F.col("edge_type") == "same_area"
    both = both.withColumn("n", n).join(matching, "other", "left")
    r = S.EDGE_RELEVANT
    relevance = F.when(area | (F.col("n") == 0), 1.0).when(F.col("has_symbol"), r["symbol"]).when(F.col("n") >= len(q.terms), r["all_terms"]).otherwise(r["some_terms"])
    inbound = F.when((F.col("dst") == F.col("path")) & ~area, S.INBOUND).otherwise(0.0)
    value = (weight_of(F.col("edge_type"), S.EDGE_SIGNAL, S.EDGE_SIGNAL_OTHER) + inbound) * F.lit(scale) * relevance
    detail = F.when(relevance > 1.0, F.concat(F.lit("connected to query-relevant "), "other", F.lit(" via "), "edge_type")).otherwise(F.concat(F.lit("indexed edge "), "edge_type", F.lit(" "), "reason"))
    tier = F.when(F.col("edge_type").isin("imports", "references", "declares_module"), 1).otherwise(0)
    return both.select("path", F.lit(EDGE).alias("type"), detail.alias("detail"), value.alias("score"), tier.alias("tier"), F.when(area, 2).otherwise(1).alias("level"))


def per_file(symbols: DataFrame, refs: DataFrame, edges: DataFrame, q: Query, scale: float) -> DataFrame:
    """(path, signals, index_tier): a file's best signals in order, and the highest tier of all that it has."""
    every = definitions(symbols, q, scale).unionByName(references(refs, q, scale)).unionByName(edges_of(edges, symbols, q, scale))
    order = Window.partitionBy("path").orderBy(F.desc("tier"), F.desc("score"), "level", "type", "detail")
    # a hub has very many edges: the window keeps SIGNALS rows of a file before the shuffle and after it
    tiers = every.groupBy("path").agg(F.max("tier").alias("index_tier"))
    best = every.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= S.SIGNALS)
    best = best.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rn", "type", "detail", "score", "tier"))).alias("s"))
    items = F.transform("s", lambda x: F.struct(x["type"].alias("type"), x["detail"].alias("detail"), x["score"].alias("score"), x["tier"].alias("tier")))
    return best.join(tiers, "path").select("path", items.alias("signals"), "index_tier")
