"""Ranked retrieval with additive evidence."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import roles as R
from ..functions import text as T
from . import lexical, signals
from .scan import Query, clusters, two_pass

if TYPE_CHECKING:
    from .index import Index


def _by_role(weights: dict[str, float], role: Column) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(role == name, F.lit(w)).otherwise(out)
    return out


def scored_clusters(matches: DataFrame, q: Query) -> DataFrame:
    """Clusters with their text, exact phrase, term hits, fixture sign and priority."""
    joined = T.normalize_phrase(F.array_join(F.transform("items", lambda x: x["snippet"]), " "))
    out = clusters(matches).withColumn("joined", joined)
    exact = F.col("joined").contains(q.phrase) | (T.squash(F.col("joined")).contains(q.squashed) if q.squashed else F.lit(False))
    hits = reduce(add, [F.col("joined").contains(t).cast("int") for t in q.terms], F.lit(0))
    fixture = reduce(or_, [F.exists("items", _holds(w)) for w in S.FIXTURE_WORDS])
    out = out.withColumns({"exact": exact, "hits": hits, "fixture": fixture}).withColumn("span", F.col("end_line") - F.col("start_line") + 1)
    priority = F.when(F.col("exact"), 4.0).otherwise(0.0) + F.col("hits") * F.lit(1.2) + F.col("hits") / F.col("span") * F.lit(1.5) - F.when(F.col("fixture"), 0.25).otherwise(0.0)
    return out.withColumn("priority", priority)


def _holds(word: str):
    return lambda x: F.lower(x["snippet"]).contains(word)


def features(matches: DataFrame, q: Query) -> DataFrame:
    """One row a file: what the score is added up from, in one pass over its clusters."""
    found = scored_clusters(matches, q)
    holds = lambda test: F.exists("items", lambda x: test(T.normalize_phrase(x["snippet"])))
    seen = {f"in_snippet_{i}": holds(lambda s, t=t: s.contains(t)) for i, t in enumerate(q.terms)}
    whole = {f"bounded_{i}": holds(lambda s, t=t: T.bounded(s, t)) for i, t in enumerate(q.terms) if len(q.terms) >= 3 and len(t.encode()) <= 3}
    found = found.withColumns(seen | whole) if q.terms else found
    best = lambda when: F.max(F.when(when, F.struct("priority", "start_line", "end_line", "fixture", "hits")))  # noqa: E731  ties: the last cluster
    order = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "start_line", "items")))
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("items", lambda x: x["line_number"])))))
    return found.groupBy("path").agg(
        best(F.col("exact")).alias("exact"), best(F.col("hits") >= 2).alias("near"), F.count(F.lit(1)).alias("n_clusters"),
        F.transform(F.slice(order, 1, S.SNIPPETS), lambda x: x["items"]).alias("first_items"), lines.alias("lines"), *[F.max(c).alias(c) for c in seen | whole],
    )


def _best_snippet(items: Column, q: Query) -> Column:
    """(line_number, text) of the best match of a cluster; ties go to the later line."""

    def value(x: Column) -> Column:
        text = T.normalize_phrase(x["snippet"])
        hits = reduce(add, [text.contains(t).cast("int") for t in q.terms], F.lit(0))
        fixture = reduce(or_, [text.contains(w) for w in S.FIXTURE_WORDS])
        squashed = T.squash(text).contains(q.squashed) if q.squashed else F.lit(False)
        score = F.when(text.contains(q.phrase), 4.0).otherwise(0.0) + F.when(squashed, 2.5).otherwise(0.0) + hits * F.lit(0.8) - F.when(fixture, 0.15).otherwise(0.0)
        return F.struct(score.alias("score"), x["line_number"].alias("line_number"), x["snippet"].alias("snippet"))

    return T.let(F.array_max(F.transform(items, value)), lambda x: F.struct(x["line_number"].alias("line_number"), T.shorten(x["snippet"], S.SNIPPET_WIDTH).alias("text")))


def _evidence(when: Column | None, kind: str | Column, *detail: str | Column) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    item = F.struct(text(kind).alias("type"), F.concat(*map(text, detail)).alias("detail"))
    return item if when is None else F.when(when, item)


def score(found: DataFrame, q: Query) -> DataFrame:
    """Adds the role, tier and matched terms, what the score is before index evidence, and the evidence; terms are added in a fixed order."""
    path_terms, name_terms = T.terms(F.col("path")), T.terms(T.basename(F.col("path")))
    df = found.withColumns({"role": R.rank_role(F.col("path")), "path_terms": path_terms, "name_terms": name_terms})
    hit = lambda where, t: F.exists(where, lambda x: T.token_matches(x, t, T.singular_of(t)))
    same = lambda where: reduce(and_, [F.array_contains(where, t) for t in q.terms], F.lit(True))
    # what is used several times below is a column of its own
    df = df.withColumns({f"{w}_{i}": hit(f"{w}_terms", t) for w in ("name", "path") for i, t in enumerate(q.terms)} | {f"same_{w}": same(f"{w}_terms") for w in ("name", "path")})
    idl = q.identifier_like
    total, matched, why = F.lit(0.0), F.lit(0), []
    for i, t in enumerate(q.terms):
        in_name, in_path, in_snippet = F.col(f"name_{i}"), F.col(f"path_{i}"), F.col(f"in_snippet_{i}")
        total = total + F.when(in_name, 0.20 if idl else 0.16).when(in_path, 0.12 if idl else 0.08).otherwise(0.0)
        full = F.lit(0.09 if idl else 0.05)
        if len(q.terms) >= 3 and len(t.encode()) <= 3:
            full = F.when(F.col(f"bounded_{i}"), full).otherwise(0.04 if idl else 0.03)
        total = total + F.when(in_snippet, full).otherwise(0.0)
        matched = matched + (in_name | in_path | in_snippet).cast("int")
        why += [_evidence(in_name, "filename_token_match", f"filename token matches '{t}'"), _evidence(~in_name & in_path, "path_token_match", f"path token matches '{t}'"), _evidence(in_snippet, "snippet_term_match", f"matched '{t}' in snippet")]
    if q.terms:
        like = lambda w: reduce(and_, [F.col(f"{w}_{i}") for i in range(len(q.terms))])
        df = df.withColumn("shape", F.when(F.col("same_name"), 4).when(like("name"), 3).when(F.col("same_path"), 2).when(like("path"), 1).otherwise(0))
        is_ = lambda n: F.col("shape") == n
        shape = F.when(is_(4), 0.42 if idl else 0.62).when(is_(3), 0.34 if idl else 0.50).when(is_(2), 0.22 if idl else 0.32).when(is_(1), 0.16 if idl else 0.26).otherwise(0.0)
        tier = F.when(F.col("shape") >= 3, 5).when(F.col("shape") >= 1, 4).otherwise(0)
        text = F.when(is_(4), "filename stem matches").when(is_(3), "filename stem closely matches").when(is_(2), "path tokens match").otherwise("path tokens closely match")
        why.append(_evidence(F.col("shape") > 0, F.when(F.col("shape") >= 3, "filename_shape_match").otherwise("path_shape_match"), text, f" '{q.phrase}'"))
    else:
        shape, tier = F.lit(0.0), F.lit(0)
    total = total + shape
    exact, near = F.col("exact"), F.col("near")
    fixture = exact.isNotNull() & exact["fixture"]
    phrase = _by_role(S.EXACT_PHRASE, F.col("role")) + (0.04 if idl else 0.0) - F.when(fixture, 0.12).otherwise(0.0)
    total = total + F.when(exact.isNotNull(), phrase - F.when(fixture, 0.45).otherwise(0.0)).when(near.isNotNull(), _by_role(S.NEAR_PHRASE, F.col("role")) + (0.02 if idl else 0.0)).otherwise(0.0)
    total = total + _by_role(S.ROLE_WEIGHT, F.col("role"))
    s = lambda c: c.cast("string")
    why += [
        _evidence(exact.isNotNull(), "exact_phrase_match", "matched exact phrase in lines ", s(exact["start_line"]), "-", s(exact["end_line"])),
        _evidence(fixture, "fixture_like_match", "exact phrase appears in assertion or fixture-like text"),
        _evidence(exact.isNull() & near.isNotNull(), "near_phrase_match", s(near["hits"]), " query terms clustered in lines ", s(near["start_line"]), "-", s(near["end_line"])),
    ]
    if q.expansion:
        held = F.filter(F.array(*[F.when(F.col(f"name_{i}") | F.col(f"path_{i}"), t) for i, t in enumerate(q.expansion)]), lambda x: x.isNotNull())
        why.append(_evidence(F.size(held) >= 2, "identifier_expansion", "identifier expansion matched ", F.array_join(held, " + ")))
    of_role = lambda make: reduce(lambda out, r: out.when(F.col("role") == r, make(r)), list(S.ROLE_TEXT)[1:], F.when(F.col("role") == list(S.ROLE_TEXT)[0], make(list(S.ROLE_TEXT)[0])))
    why.append(of_role(lambda r: _evidence(None, f"{r}_role", S.ROLE_TEXT[r])))
    df = df.withColumns({"before": total, "tier": tier, "matched_terms": matched, "is_fixture": F.coalesce(fixture, F.lit(False)), "is_exact": exact.isNotNull(), "is_near": exact.isNull() & near.isNotNull(), "why": F.array_compact(F.array(*why))})
    return df.withColumn("snippets", F.transform("first_items", lambda x: _best_snippet(x, q)))


def finish(df: DataFrame, q: Query) -> DataFrame:
    """Adds index evidence and what follows it, and rounds; ``signals`` and ``lexical`` are the index's part, if there is an index."""
    total = F.col("before")
    indexed = "signals" in df.columns
    if indexed:
        total = F.aggregate(F.reverse("signals"), total, lambda acc, x: acc + x["score"]) + F.coalesce("lexical", F.lit(0.0))
        df = df.withColumn("tier", F.greatest("tier", F.coalesce("index_tier", F.lit(0))))
    total = total + F.lit(0.01) * F.least("n_clusters", F.lit(3)) + (F.lit(0.03) + F.least("n_clusters", F.lit(4)) * F.lit(0.01))
    covered = F.col("matched_terms") * F.lit(0.14) - (F.lit(len(q.terms)) - F.col("matched_terms")) * F.lit(0.07)
    total = total + F.when(F.col("matched_terms") > 0, covered).otherwise(0.0)
    df = df.withColumn("raw_score", F.when(F.col("is_fixture"), F.least(total, F.lit(0.30))).otherwise(total))
    df = df.withColumn("score", T.round2(F.least(F.greatest("raw_score", F.lit(0.0)), F.lit(1.0))))
    source = F.col("role") == "source"
    confidence = (
        F.when(F.col("is_fixture"), "low")
        .when(F.col("is_exact") & ((F.octet_length(F.col("snippets")[0]["text"]) <= 80) | (F.lit(q.identifier_like) & source)), "high")
        .when(F.col("is_exact") | F.col("is_near") | (source & (F.col("matched_terms") >= 2)), "medium")
        .when(source & (F.col("score") >= 0.60), "medium")
        .otherwise("low")
    )
    has = lambda kind: F.exists("signals", lambda x: x["type"] == kind) if indexed else F.lit(False)
    defined, used = has("indexed_symbol_definition"), has("indexed_symbol_reference")
    raised = F.when(defined, "high").when((F.col("tier") >= 2) | used, "medium").when(has("indexed_edge"), "low").otherwise(confidence)
    df = df.withColumn("confidence", F.when(F.col("tier") > 0, raised).otherwise(confidence))
    df = df.withColumn("has_symbol", defined | used)
    return df.withColumn("score", F.when(F.col("tier") > 0, T.round2(F.greatest(F.col("score") + F.col("tier") * F.lit(S.TIER_WEIGHT), F.lit(0.0)))).otherwise(F.col("score")))


def explained(df: DataFrame, q: Query) -> DataFrame:
    """(path, role, rank, score, confidence, line_ranges, snippets, evidence, next_action) of ranked files: why each is in the list, as arrays of structs.

    Index evidence comes first, then the lexical score, then the rest in the order in which it was weighed.
    """
    none = F.array().cast("array<struct<type:string,detail:string>>")
    first = F.transform("signals", lambda x: F.struct(x["type"].alias("type"), x["detail"].alias("detail"))) if "signals" in df.columns else none
    lexical = F.array_compact(F.array(_evidence(F.col("lexical") >= S.LEXICAL_SHOWN, "lexical_score", "lexical score matched terms: ", F.col("lexical_terms")))) if "lexical" in df.columns else none
    last = F.array_compact(F.array(
        _evidence(None, "rg_match", "matched on lines ", T.ranges(F.col("lines"))),
        _evidence(F.col("matched_terms") > 0, "query_term_coverage", "matched ", F.col("matched_terms").cast("string"), f" of {len(q.terms)} query terms"),
    ))
    return df.select(
        "path", "role", "rank", "score", "confidence", T.range_list(F.col("lines")).alias("line_ranges"), "snippets", F.concat(first, lexical, F.col("why"), last).alias("evidence"),
        F.when(F.col("rank") <= 3, F.concat(F.lit("open "), F.col("path"))).alias("next_action"),
    )


def written(of: DataFrame) -> DataFrame:
    """``explained`` with its arrays as text."""
    lines = lambda items, a, b: F.array_join(F.transform(items, lambda x: F.concat(x[a].cast("string"), F.lit(": "), x[b])), "\n").alias(items)
    ranges = F.array_join(F.transform("line_ranges", lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"], r["end"]))), ", ")
    return of.select("path", "rank", "score", "confidence", ranges.alias("line_ranges"), lines("snippets", "line_number", "text"), lines("evidence", "type", "detail"), "next_action")


def report(df: DataFrame, q: Query) -> DataFrame:
    """(path, rank, score, confidence, line_ranges, snippets, evidence, next_action) of ranked files, as text."""
    return written(explained(df, q))


def top(df: DataFrame, k: int = S.CANDIDATE_LIMIT) -> DataFrame:
    """The best k, in order; the raw score is rounded so that the order of sums can't decide."""
    df = df.withColumn("_shape", F.exists("why", lambda x: x["type"].isin("filename_shape_match", "path_shape_match"))).withColumn("raw_score", F.round("raw_score", 6))
    return df.orderBy(F.desc("score"), F.desc("_shape"), F.desc("raw_score"), "path").limit(k)


_COLUMNS = ["path", "role", "score", "confidence", "tier", "matched_terms", "raw_score"]


def _ranked(lines: DataFrame, q: Query, match: str, roles: list[str] | None) -> DataFrame:
    df = finish(score(features(two_pass(lines, q), q), q), q)
    if match == "all":
        df = df.where(F.col("matched_terms") >= len(q.terms))
    if roles:
        df = df.where(F.col("role").isin(roles + (["lockfile", "generated"] if "other" in roles else [])))
    return top(df)


def find(lines: DataFrame, query: str, match: str = "any", roles: list[str] | None = None) -> DataFrame:
    """Ranked files for a query, without an index."""
    return _ranked(lines, Query(query), match, roles).select(*_COLUMNS)


def numbered(df: DataFrame) -> DataFrame:
    """The few files of a ranked list with their rank."""
    order = Window.orderBy(F.desc("score"), F.desc("_shape"), F.desc("raw_score"), "path")  # CANDIDATE_LIMIT rows
    return df.withColumn("rank", F.row_number().over(order))


def find_report(lines: DataFrame, query: str) -> DataFrame:
    """Ranked files with line ranges, snippets and evidence."""
    q = Query(query)
    return report(numbered(_ranked(lines, q, "any", None)), q)


def find_document(lines: DataFrame, query: str) -> DataFrame:
    """One row (query, candidates, coverage): the ranked files with all that explains them, nested, and what was found in all."""
    q = Query(query)
    found = two_pass(lines, q)
    first = F.struct("rank", "path", "role", "score", "confidence", "line_ranges", "snippets", "evidence", "next_action")
    shown = explained(numbered(top(finish(score(features(found, q), q), q))), q).agg(F.array_sort(F.collect_list(first)).alias("candidates"))  # CANDIDATE_LIMIT rows
    counts = found.agg(F.count(F.lit(1)).alias("raw_match_count"), F.count_distinct("path").alias("raw_candidate_file_count"))
    both = shown.join(F.broadcast(counts))  # one row each
    coverage = F.struct("raw_match_count", "raw_candidate_file_count", F.size("candidates").alias("displayed_candidate_count"), (F.size("candidates") < F.col("raw_candidate_file_count")).alias("limited"), F.lit(S.MATCH_LIMIT).alias("match_limit_per_file"), F.lit(S.CANDIDATE_LIMIT).alias("candidate_limit"))
    return both.select(F.lit(query).alias("query"), "candidates", coverage.alias("coverage"))


def status_scale(status: str) -> float:
    """How much an index of this state counts."""
    return S.STATUS_SCALE.get(status, S.STATUS_OTHER)


def lexical_part(files: DataFrame, q: Query, scale: float = 1.0, index: Index | None = None) -> DataFrame:
    """(path, lexical, lexical_terms): the share of the score that BM25 adds, from a stored index if there is one; nothing below the least."""
    if not q.lex_tokens or scale <= 0:
        return files.select("path", F.lit(0.0).alias("lexical"), F.lit("").alias("lexical_terms")).where(F.lit(False))
    raw = index.bm25(q.lex_tokens) if index else lexical.bm25(files, q.lex_tokens)
    bound = F.lit(len(q.lex_tokens) * (S.BM25_K1 + 1)) * F.greatest(F.log(F.col("lex_file_count") + F.lit(1.0)), F.lit(1.0))
    part = F.lit(S.LEXICAL_MAX) * F.least(F.col("score") / bound, F.lit(1.0)) * F.lit(scale)
    return raw.select("path", F.when(part >= S.LEXICAL_MIN, part).otherwise(0.0).alias("lexical"), "lexical_terms")


def _indexed(lines: DataFrame, files: DataFrame, q: Query, status: str, symbols: DataFrame | None, refs: DataFrame | None, edges: DataFrame | None, index: Index | None = None) -> DataFrame:
    scale = status_scale(status)
    df = score(features(two_pass(lines, q), q), q).join(lexical_part(files, q, scale, index), "path", "left")
    if symbols is None or scale <= 0:
        empty = F.array().cast("array<struct<type:string,detail:string,score:double,tier:int>>")
        df = df.withColumns({"signals": empty, "index_tier": F.lit(0)})
    else:
        found = signals.per_file(symbols, refs, edges, q, scale)
        df = df.join(found, "path", "left").withColumn("signals", F.coalesce("signals", F.filter("signals", lambda x: F.lit(False)), F.array().cast("array<struct<type:string,detail:string,score:double,tier:int>>")))
    return top(anchor_cap(finish(df, q)))


def find_indexed(lines: DataFrame, files: DataFrame, query: str, status: str = "fresh", symbols: DataFrame | None = None, refs: DataFrame | None = None, edges: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """Ranked files with the lexical score of an index, its definitions, references and edges if given, and the cap of those that no anchor supports."""
    return _indexed(lines, files, Query(query), status, symbols, refs, edges, index).select(*_COLUMNS)


def find_indexed_report(lines: DataFrame, files: DataFrame, query: str, status: str, symbols: DataFrame, refs: DataFrame, edges: DataFrame, index: Index | None = None) -> DataFrame:
    """The same with line ranges, snippets and evidence, as text."""
    return written(find_indexed_explained(lines, files, query, status, symbols, refs, edges, index))


def find_indexed_explained(lines: DataFrame, files: DataFrame, query: str, status: str, symbols: DataFrame, refs: DataFrame, edges: DataFrame, index: Index | None = None) -> DataFrame:
    """The same as arrays of structs."""
    q = Query(query)
    return explained(numbered(_indexed(lines, files, q, status, symbols, refs, edges, index)), q)


def anchor_cap(df: DataFrame) -> DataFrame:
    """Candidates without an exact phrase that would pass the best phrase anchor stay below it."""
    anchor = F.col("role").isin("source", "config") & ~F.col("is_fixture") & ~F.col("has_symbol") & F.col("is_exact") & (F.col("raw_score") >= 0.50)
    best = df.agg(F.max(F.when(anchor, F.col("score"))).alias("best_anchor"))
    capped = F.col("best_anchor").isNotNull() & ~F.col("is_exact") & (F.col("score") > F.col("best_anchor"))
    df = df.join(F.broadcast(best))  # one row
    return df.withColumn("score", F.when(capped, T.round2(F.col("best_anchor") - F.lit(0.01))).otherwise(F.col("score"))).drop("best_anchor")
