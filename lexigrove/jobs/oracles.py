"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

import re

from .. import schema as S
from ..functions.globs import to_regex
from ..functions.text import LOWER, UPPER, singular_of
from ..operators.extract import PATTERNS
from ..operators.scan import Query
from ..sources import model as M
from .queries import EXCLUDE, FOCUS, INCLUDE, PHRASE, SYMBOL, WORDS


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def pick(values: list[str], key: str) -> str:
    return f"{array(values)}[CAST({key} % {len(values)} AS INT) + 1]"


def terms(x: str) -> str:
    for pair in ("([a-z])([A-Z])", "([0-9])([A-Za-z])", "([A-Za-z])([0-9])", "([A-Z])([A-Z][a-z])"):
        x = f"regexp_replace({x}, '{pair}', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(string_split_regex({x}, '[/\\\\._\\-: ]'), lambda t: translate(t, '{UPPER}', '{LOWER}')), lambda t: strlen(t) >= 2)"


def lexical(x: str) -> str:
    return f"list_filter({terms(x)}, lambda t: strlen(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+'))"


def phrase(x: str) -> str:
    return f"lower({compact(x)})"


def compact(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}\\x0b\\x85]+', ' ', 'g'))"


def squash(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"


def shorten(x: str, n: int) -> str:
    c = compact(x)
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n - 3}) || '...' ELSE {c} END"


def singular(x: str) -> str:
    cut = lambda n: f"substring({x}, 1, length({x}) - {n})"
    ends = "".join(f" WHEN suffix({x}, '{e}') THEN {cut(len(e))}" for e in ("ses", "xes", "zes", "ches", "shes"))
    return f"CASE WHEN strlen({x}) <= 3 THEN {x} WHEN suffix({x}, 'ies') THEN {cut(3)} || 'y'{ends} WHEN suffix({x}, 's') AND NOT suffix({x}, 'ss') THEN {cut(1)} ELSE {x} END"


def base(x: str) -> str:
    return f"list_extract(string_split({x}, '/'), -1)"


def stem(x: str) -> str:
    return f"CASE WHEN regexp_matches({base(x)}, '^.+\\.[^.]*$') THEN regexp_replace({base(x)}, '\\.[^.]*$', '') ELSE {base(x)} END"


def any_of(p: str, parts: list[str] = (), ends: list[str] = ()) -> str:
    return "(" + " OR ".join([f"contains({p}, {text(x)})" for x in parts] + [f"suffix({p}, {text(x)})" for x in ends]) + ")"


def role(path: str, rank: bool = False) -> str:
    p = f"lower({path})"
    config_ends = [e for e in S.CONFIG_ENDS if not (rank and e == ".jsonc")]
    more = f" OR list_has_any({terms(base(path))}, ['src', 'lib', 'app'])" if rank else ""
    return f"""CASE WHEN {any_of(p, S.GENERATED_PARTS)} OR ((prefix({p}, 'site/') OR contains({p}, '/site/')) AND suffix({p}, 'index.html')) THEN 'generated'
    WHEN {any_of(p, ends=S.LOCKFILE_ENDS)} THEN 'lockfile' WHEN {any_of(p, S.TEST_PARTS, S.TEST_ENDS)} THEN 'test' WHEN {any_of(p, S.DOC_PARTS, S.DOC_ENDS)} THEN 'doc'
    WHEN {any_of(p, S.CONFIG_PARTS, config_ends)} THEN 'config' WHEN {any_of(p, S.SOURCE_PARTS, S.SOURCE_ENDS)}{more} THEN 'source' ELSE 'other' END"""


def weight(x: str, values: dict[str, float], other: float = 0.0) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {text(k)} THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {other}::DOUBLE END"


def globbed(path: str, patterns: list[str]) -> str:
    tests = [f"regexp_matches({path}, {text(to_regex(g))})" for g in patterns] + [f"regexp_matches({base(path)}, {text(to_regex(g))})" for g in patterns if "/" not in g]
    return "(" + " OR ".join(tests) + ")"


AREA = f"""CASE WHEN s[1] IN ({array(S.AREA_ROOTS)[1:-1]}) THEN CASE WHEN len(s) >= 2 AND NOT contains(s[2], '.') THEN s[1] || '/' || s[2] ELSE s[1] END
    WHEN s[1] IN ({array(S.AREA_GROUPS)[1:-1]}) AND len(s) >= 2 THEN s[1] || '/' || s[2] ELSE s[1] END"""
EDGE_W = f"{weight('edge_type', S.EDGE_WEIGHT, S.EDGE_OTHER)} + {weight('confidence', S.CONFIDENCE_BONUS)}"
REF_W = f"{weight('context', S.REF_WEIGHT)} + {weight('confidence', S.CONFIDENCE_BONUS)}"
LEVELS = ["extracted", "inferred", "ambiguous"]


def edge(kind: str, src: str, dst: str, key: str, of: str) -> str:
    return f"SELECT '{kind}' AS edge_type, {src} AS src, {dst} AS dst, {pick(LEVELS, key)} AS confidence, '{kind} key' AS reason FROM {of}"


#: Named parts; a query gets those that it, or a part of it, names.
PARTS = {
    "x_files": f"SELECT {pick(M.PREFIXES, 'doc_id')} || '/' || source || '/' || {pick(M.FOLDERS, 'doc_id')} || '/doc_' || doc_id || {pick(M.ENDINGS, 'doc_id')} AS path, text, doc_id FROM documents",
    "x_lines": "SELECT path, unnest(range(1, len(l) + 1))::INT AS line_number, unnest(l) AS line FROM (SELECT path, string_split(text, chr(10)) AS l FROM x_files)",
    "x_named": "SELECT 'part/' || p_partkey AS key, p_name AS value FROM part UNION ALL SELECT 'page/' || page_id, url FROM pages UNION ALL SELECT 'file/' || doc_id, path FROM x_files",
    "x_edges": " UNION ".join(
        (
            edge("imports", "'nation/' || n_nationkey", "'region/' || n_regionkey", "n_nationkey", "nation"),
            edge("references", "'customer/' || c_custkey", "'nation/' || c_nationkey", "c_custkey", "customer"),
            edge("declares_module", "'supplier/' || s_suppkey", "'nation/' || s_nationkey", "s_suppkey", "supplier"),
            edge("configures", "'orders/' || o_orderkey", "'customer/' || o_custkey", "o_orderkey", "orders"),
            edge("likely_test_for", "'part/' || l_partkey", "'supplier/' || l_suppkey", "l_partkey", "lineitem"),
            edge("same_area", "'nation/' || a.n_nationkey", "'nation/' || b.n_nationkey", "a.n_nationkey", "nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
        )
    ),
    "x_symbols": f"SELECT replace(p_name, ' ', '_') AS name, {pick(M.KINDS, 'p_size')} AS kind, p_brand AS file_path, p_partkey::INT AS line_number, CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM part",
    "x_refs": """SELECT 'supplier/' || l_suppkey AS from_file, replace(p_name, ' ', '_') AS symbol_name, p_brand AS target_file, p_partkey::INT AS target_line, l_linenumber::INT AS line_number,
        CASE WHEN l_linestatus = 'O' THEN 'extracted' ELSE 'inferred' END AS confidence, 'line item' AS reason,
        CASE l_returnflag WHEN 'A' THEN 'production' WHEN 'R' THEN 'fixture' ELSE 'test' END AS context, (l_linenumber % 3)::INT AS additional_count FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "x_tokens": f"SELECT path, unnest({lexical('text')}) AS term FROM x_files",
    "x_lengths": f"SELECT path, len({lexical('text')})::INT AS doc_length FROM x_files",
    "x_postings": f"SELECT path, term, tf FROM (SELECT path, term, count(*)::INT AS tf, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, term) AS rn FROM x_tokens GROUP BY path, term) WHERE rn <= {S.TERMS_PER_FILE}",
    "x_stats": "SELECT count(*) AS lex_file_count, coalesce(avg(doc_length), 0) AS avg_doc_length FROM x_lengths",
    "x_tasks": f"SELECT 'task_' || item_id AS task_id, 'repo' || (item_id % 3) AS repo_id, {pick(M.TASK_TYPES, 'item_id')} AS task_type, text AS query, item_id FROM benchmark",
    "x_doc_terms": f"SELECT path, doc_id, unnest(list_distinct(list_filter({lexical('text')}, lambda t: strlen(t) >= 8))) AS term FROM x_files",
    "x_task_terms": f"SELECT task_id, item_id, unnest(list_distinct(list_filter({lexical('query')}, lambda t: strlen(t) >= 8))) AS term FROM x_tasks",
    "x_df": "SELECT term, count(*) AS df FROM x_doc_terms WHERE term IN (SELECT term FROM x_task_terms) GROUP BY term",
    "x_overlap": "SELECT task_id, item_id, path, doc_id, count(*) AS shared, round(sum(1.0::DOUBLE / df), 6) AS weight FROM x_doc_terms JOIN x_task_terms USING (term) JOIN x_df USING (term) GROUP BY ALL",
    "x_mode_scores": f"""SELECT task_id, path, unnest(['A', 'B', 'C', 'D']) AS mode, unnest([shared::DOUBLE, shared + CASE WHEN {role('path')} = 'source' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, weight, weight + coalesce(quality, 0) * 0.01::DOUBLE]) AS s
        FROM x_overlap LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)""",
    "x_ranked": "SELECT * FROM (SELECT task_id, mode, row_number() OVER (PARTITION BY task_id, mode ORDER BY round(s, 6) DESC, path) AS pos, path FROM x_mode_scores)",
    "x_judged": f"SELECT task_id, path, CASE WHEN toxic = 1 THEN 'irrelevant' WHEN quality = 1 THEN {pick(['primary', 'acceptable', 'supporting'], 'doc_id')} ELSE 'supporting' END AS label FROM x_overlap JOIN labels USING (doc_id)",
    "x_runs": """SELECT task_id, repo_id, task_type, query, mode, floor(value * 100)::BIGINT AS latency_ms, coalesce(event_type <> 'error', false) AS json_parse_ok
        FROM (SELECT *, unnest(['A', 'B', 'C', 'D']) AS mode, unnest([0, 1, 2, 3]) AS i FROM x_tasks) LEFT JOIN events ON event_id = item_id * 4 + i""",
    "x_gains": f"SELECT task_id, path, label, {weight('label', S.GAIN)} AS gain FROM x_judged",
    "x_ideal": "SELECT task_id, sum(CASE WHEN pos <= 8 THEN gain / log2(pos + 1) END) AS idcg, sum((label IN ('primary', 'acceptable', 'supporting'))::INT) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY gain DESC, path) AS pos FROM x_gains) GROUP BY task_id",
    "x_lists": """SELECT task_id, mode, min(CASE WHEN label IN ('primary', 'acceptable') THEN pos END) AS first, sum(CASE WHEN pos <= 8 THEN coalesce(gain, 0) / log2(pos + 1) ELSE 0 END) AS dcg,
        sum(CASE WHEN pos <= 8 AND label IN ('primary', 'acceptable', 'supporting') THEN 1 ELSE 0 END) AS rel_top, sum(CASE WHEN pos <= 8 THEN 1 ELSE 0 END) AS n_top FROM x_ranked LEFT JOIN x_gains USING (task_id, path) GROUP BY task_id, mode""",
    "x_scored": """SELECT task_id, mode, repo_id, task_type, query, latency_ms, json_parse_ok, CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit1, CASE WHEN first <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit3,
        CASE WHEN first <= 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit8, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg END, 6) AS ndcg8,
        round(CASE WHEN coalesce(n_top, 0) > 0 THEN rel_top::DOUBLE / n_top ELSE 0 END, 6) AS precision8, round(CASE WHEN relevant > 0 THEN coalesce(rel_top, 0)::DOUBLE / relevant END, 6) AS recall8,
        (first - 1)::DOUBLE AS unnecessary, first IS NULL AS miss FROM x_runs JOIN x_ideal USING (task_id) LEFT JOIN x_lists USING (task_id, mode)""",
    "x_first_vec": "SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1",
    "x_nearest": f"SELECT path, similarity FROM (SELECT 'vec/' || vec_id AS path, round(greatest(least(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 1), -1), 6) AS similarity FROM embeddings, x_first_vec) WHERE similarity >= {S.COSINE_FLOOR} ORDER BY similarity DESC, path LIMIT {S.SEMANTIC_TOP}",
    "x_candidates": "SELECT 'vec/' || vec_id AS path, round((vec_id * 37 % 101) / 101.0::DOUBLE, 6) AS score, CASE WHEN label % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, label = 3 AS anchor FROM embeddings",
}


def scanned(lines_of: str, patterns: list[str]) -> str:
    hit = " OR ".join(f"contains(lower(line), {text(p)})" for p in patterns)
    return f"SELECT path, line_number, line AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_number) AS rn FROM {lines_of} WHERE {hit}) WHERE rn <= {S.MATCH_LIMIT}"


def two_pass(q: Query) -> str:
    return f"{scanned('x_lines', [q.phrase])} UNION {scanned('x_lines', q.patterns)}"


def clustered(matches: str) -> str:
    return f"""SELECT *, sum(gap) OVER (PARTITION BY path ORDER BY line_number, snippet) AS cluster FROM
        (SELECT *, CASE WHEN line_number > lag(line_number) OVER (PARTITION BY path ORDER BY line_number, snippet) + 2 THEN 1 ELSE 0 END AS gap FROM ({matches}))"""


def bm25(tokens: list[str]) -> str:
    repeat = "CASE term " + " ".join(f"WHEN {text(t)} THEN {tokens.count(t)}" for t in dict.fromkeys(tokens)) + " END"
    wanted = array(list(dict.fromkeys(tokens)))[1:-1]
    return f"""SELECT path, sum(greatest(ln((lex_file_count - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 0) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_length / avg_doc_length))) * {repeat}) AS score
        FROM x_postings JOIN (SELECT term, greatest(count(*), 1) AS df FROM x_postings WHERE term IN ({wanted}) GROUP BY term) USING (term) JOIN x_lengths USING (path), x_stats
        WHERE term IN ({wanted}) AND avg_doc_length > 0 AND doc_length > 0 GROUP BY path"""


def found(q: Query, match_all: bool = False, roles: list[str] | None = None, lexical_sql: str | None = None, signals_sql: str | None = None, report: bool = False) -> str:
    """The whole ranking recipe; sums in the same order as the operator's."""
    idl = q.identifier_like
    contains_any = lambda x: "(" + " OR ".join(f"contains({x}, {text(w)})" for w in S.FIXTURE_WORDS) + ")"
    hits = lambda x: "(" + " + ".join(f"contains({x}, {text(t)})::INT" for t in q.terms) + ")"
    one = {t: f"(x = {text(t)} OR x = {text(_singular(t))} OR {singular('x')} = {text(t)})" for t in q.terms}
    hit = lambda where, t: f"(len(list_filter({where}, lambda x: {one[t]})) > 0)"
    total, matched = "0.0::DOUBLE", "0"
    for i, t in enumerate(q.terms):
        n, p = hit("name_terms", t), hit("path_terms", t)
        total += f" + CASE WHEN {n} THEN {0.20 if idl else 0.16}::DOUBLE WHEN {p} THEN {0.12 if idl else 0.08}::DOUBLE ELSE 0 END + CASE WHEN s{i} THEN {0.09 if idl else 0.05}::DOUBLE ELSE 0 END"
        matched += f" + ({n} OR {p} OR s{i})::INT"
    same = lambda where: " AND ".join(f"list_contains({where}, {text(t)})" for t in q.terms)
    like = lambda where: " AND ".join(hit(where, t) for t in q.terms)
    shape = f"CASE WHEN {same('name_terms')} THEN {0.42 if idl else 0.62}::DOUBLE WHEN {like('name_terms')} THEN {0.34 if idl else 0.50}::DOUBLE WHEN {same('path_terms')} THEN {0.22 if idl else 0.32}::DOUBLE WHEN {like('path_terms')} THEN {0.16 if idl else 0.26}::DOUBLE ELSE 0 END"
    tier = f"CASE WHEN {like('name_terms')} THEN 5 WHEN {like('path_terms')} THEN 4 ELSE 0 END"
    boost = f"CASE WHEN exact IS NOT NULL THEN {weight('role', S.EXACT_PHRASE)} + {0.04 if idl else 0.0}::DOUBLE - CASE WHEN exact.fixture THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN exact.fixture THEN 0.45::DOUBLE ELSE 0 END WHEN near IS NOT NULL THEN {weight('role', S.NEAR_PHRASE)} + {0.02 if idl else 0.0}::DOUBLE ELSE 0 END"
    lexical_join = f"LEFT JOIN ({lexical_sql}) USING (path)" if lexical_sql else ""
    lexical_part = "coalesce(lexical, 0)" if lexical_sql else "0.0::DOUBLE"
    keep = "TRUE"
    if match_all:
        keep += f" AND matched_terms >= {len(q.terms)}"
    if roles:
        keep += f" AND role IN ({array(roles)[1:-1]})"
    ph = phrase("snippet")
    snip_score = f"(CASE WHEN contains({ph}, {text(q.phrase)}) THEN 4.0::DOUBLE ELSE 0 END + CASE WHEN contains({squash(ph)}, {text(q.squashed)}) THEN 2.5::DOUBLE ELSE 0 END + {hits(ph)} * 0.8::DOUBLE - CASE WHEN {contains_any(ph)} THEN 0.15::DOUBLE ELSE 0 END)"
    anchor = "role IN ('source', 'config') AND NOT is_fixture AND NOT has_symbol AND is_exact AND raw_score >= 0.5"
    capped = (
        f"""SELECT * REPLACE (CASE WHEN best_anchor IS NOT NULL AND NOT is_exact AND score > best_anchor THEN round((best_anchor - 0.01::DOUBLE) * 100) / 100 ELSE score END AS score)
        FROM f6, (SELECT max(CASE WHEN {anchor} THEN score END) AS best_anchor FROM f6)"""
        if lexical_sql
        else "SELECT * FROM f6"
    )
    signal_join = f"LEFT JOIN ({signals_sql}) USING (path)" if signals_sql else ""
    signal_part = "coalesce(sg[3].score, 0) + coalesce(sg[2].score, 0) + coalesce(sg[1].score, 0)" if signals_sql else "0.0::DOUBLE"
    kind = (lambda k: f"coalesce(list_contains(list_transform(sg, lambda x: x.type), '{k}'), false)") if signals_sql else (lambda k: "false")
    chosen = "path, rank, score, confidence, line_ranges, snippets, evidence, next_action FROM f9" if report else "path, role, score, confidence, tier::INT AS tier, matched_terms::INT AS matched_terms, round(raw_score, 6) AS raw_score FROM f7"
    return f"""WITH m AS ({two_pass(q)}), c0 AS ({clustered('SELECT * FROM m')}),
    c1 AS (SELECT path, cluster, min(line_number) AS start_line, max(line_number) AS end_line, {phrase("string_agg(snippet, ' ' ORDER BY line_number, snippet)")} AS joined, bool_or({contains_any('lower(snippet)')}) AS fixture,
        max({{'score': {snip_score}, 'line_number': line_number, 'snippet': snippet}}).snippet AS best_snippet, max({{'score': {snip_score}, 'line_number': line_number, 'snippet': snippet}}).line_number AS best_line FROM c0 GROUP BY path, cluster),
    c2 AS (SELECT *, contains(joined, {text(q.phrase)}) OR contains({squash('joined')}, {text(q.squashed)}) AS exact, {hits('joined')} AS hits, end_line - start_line + 1 AS span FROM c1),
    c3 AS (SELECT *, CASE WHEN exact THEN 4.0::DOUBLE ELSE 0 END + hits * 1.2::DOUBLE + hits::DOUBLE / span * 1.5::DOUBLE - CASE WHEN fixture THEN 0.25::DOUBLE ELSE 0 END AS priority FROM c2),
    f0 AS (SELECT path, max({{'priority': priority, 'start_line': start_line, 'end_line': end_line, 'fixture': fixture, 'hits': hits}}) FILTER (WHERE exact) AS exact,
        max({{'priority': priority, 'start_line': start_line, 'end_line': end_line, 'fixture': fixture, 'hits': hits}}) FILTER (WHERE hits >= 2) AS near, count(*) AS n_clusters,
        min({{'p': -priority, 'start_line': start_line, 'best_snippet': best_snippet}}).best_snippet AS first_snippet FROM c3 GROUP BY path),
    f1 AS (SELECT * FROM f0 JOIN (SELECT path, {', '.join(f'bool_or(contains({ph}, {text(t)})) AS s{i}' for i, t in enumerate(q.terms))} FROM m GROUP BY path) USING (path)),
    f2 AS (SELECT *, {role('path', True)} AS role, {terms('path')} AS path_terms, {terms(base('path'))} AS name_terms FROM f1),
    f3 AS (SELECT *, {total} + {shape} + {boost} + {weight('role', S.ROLE_WEIGHT)} AS before, {tier} AS tier, {matched} AS matched_terms, exact IS NOT NULL AND exact.fixture AS is_fixture, exact IS NOT NULL AS is_exact, exact IS NULL AND near IS NOT NULL AS is_near, strlen({shorten('first_snippet', S.SNIPPET_WIDTH)}) AS snippet_bytes FROM f2),
    f35 AS (SELECT *, before + {signal_part} + {lexical_part} + 0.01::DOUBLE * least(n_clusters, 3) + (0.03::DOUBLE + least(n_clusters, 4) * 0.01::DOUBLE) + CASE WHEN matched_terms > 0 THEN matched_terms * 0.14::DOUBLE - ({len(q.terms)} - matched_terms) * 0.07::DOUBLE ELSE 0 END AS total FROM f3 {lexical_join} {signal_join}),
    f36 AS (SELECT * {f"REPLACE (greatest(tier, coalesce(top_tier, 0)) AS tier)" if signals_sql else ""}, tier >= 4 AS shaped, CASE WHEN is_fixture THEN least(total, 0.30::DOUBLE) ELSE total END AS raw_score FROM f35),
    f4 AS (SELECT *, round(least(greatest(raw_score, 0), 1) * 100) / 100 AS score FROM f36),
    f5 AS (SELECT *, CASE WHEN is_fixture THEN 'low' WHEN is_exact AND (snippet_bytes <= 80 OR ({idl} AND role = 'source')) THEN 'high' WHEN is_exact OR is_near OR (role = 'source' AND matched_terms >= 2) THEN 'medium' WHEN role = 'source' AND score >= 0.60 THEN 'medium' ELSE 'low' END AS own_confidence FROM f4),
    f6 AS (SELECT * REPLACE (CASE WHEN tier > 0 THEN round(greatest(score + tier * 0.15::DOUBLE, 0) * 100) / 100 ELSE score END AS score), {kind('indexed_symbol_definition')} OR {kind('indexed_symbol_reference')} AS has_symbol,
        CASE WHEN tier = 0 THEN own_confidence WHEN {kind('indexed_symbol_definition')} THEN 'high' WHEN tier >= 2 OR {kind('indexed_symbol_reference')} THEN 'medium' WHEN {kind('indexed_edge')} THEN 'low' ELSE own_confidence END AS confidence FROM f5),
    f7 AS ({capped}){_report(q, hit, bool(lexical_sql), bool(signals_sql), shorten("best_snippet", S.SNIPPET_WIDTH)) if report else ""}
    SELECT {chosen} WHERE {keep} ORDER BY score DESC, shaped DESC, round(raw_score, 6) DESC, path LIMIT {S.CANDIDATE_LIMIT}"""


def _report(q: Query, hit, lexical: bool, signalled: bool, snippet: str) -> str:
    """Line ranges, snippets and the reasons of each file in the order in which they are given."""
    line = lambda when, kind, detail: f"CASE WHEN {when} THEN '{kind}: ' || {detail} END"
    why = [f"CASE WHEN sg[{i}] IS NOT NULL THEN sg[{i}].type || ': ' || sg[{i}].detail END" for i in (1, 2, 3)] if signalled else []
    why += [line(f"lexical >= {S.LEXICAL_SHOWN}", "lexical_score", "'lexical score matched terms: ' || lexical_terms")] if lexical else []
    for i, t in enumerate(q.terms):
        n, p = hit("name_terms", t), hit("path_terms", t)
        quoted = text(f"'{t}'")
        why += [
            line(n, "filename_token_match", f"'filename token matches ' || {quoted}"), line(f"NOT {n} AND {p}", "path_token_match", f"'path token matches ' || {quoted}"),
            line(f"s{i}", "snippet_term_match", f"'matched ' || {quoted} || ' in snippet'"),
        ]
    same = lambda where: "(" + " AND ".join(f"list_contains({where}, {text(t)})" for t in q.terms) + ")"
    like = lambda where: "(" + " AND ".join(hit(where, t) for t in q.terms) + ")"
    asked = text(f" '{q.phrase}'")
    why.append(
        f"CASE WHEN {like('name_terms')} THEN 'filename_shape_match: filename stem ' || CASE WHEN {same('name_terms')} THEN 'matches' ELSE 'closely matches' END || {asked} "
        f"WHEN {like('path_terms')} THEN 'path_shape_match: path tokens ' || CASE WHEN {same('path_terms')} THEN 'match' ELSE 'closely match' END || {asked} END"
    )
    why += [
        line("is_exact", "exact_phrase_match", "'matched exact phrase in lines ' || exact.start_line || '-' || exact.end_line"),
        line("is_fixture", "fixture_like_match", "'exact phrase appears in assertion or fixture-like text'"),
        line("is_near", "near_phrase_match", "near.hits || ' query terms clustered in lines ' || near.start_line || '-' || near.end_line"),
    ]
    if q.expansion:
        held = "[" + ", ".join(f"CASE WHEN {hit('name_terms', t)} OR {hit('path_terms', t)} THEN {text(t)} END" for t in q.expansion) + "]"
        held = f"list_filter({held}, lambda t: t IS NOT NULL)"
        why.append(line(f"len({held}) >= 2", "identifier_expansion", f"'identifier expansion matched ' || array_to_string({held}, ' + ')"))
    words = {"source": "source-like file role", "test": "test file role", "doc": "documentation file role", "config": "configuration file role", "lockfile": "lockfile or dependency snapshot", "generated": "generated or build output"}
    why.append("CASE role " + " ".join(f"WHEN '{r}' THEN '{r}_role: path suggests {w}'" for r, w in words.items()) + " END")
    why += ["'rg_match: matched on lines ' || line_ranges", line("matched_terms > 0", "query_term_coverage", f"'matched ' || matched_terms || ' of {len(q.terms)} query terms'")]
    islands = "SELECT path, min(line_number) AS a, max(line_number) AS b FROM (SELECT path, line_number, line_number - row_number() OVER (PARTITION BY path ORDER BY line_number) AS g FROM (SELECT DISTINCT path, line_number FROM m)) GROUP BY path, g"
    return f""", lr AS (SELECT path, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS line_ranges FROM ({islands}) GROUP BY path),
    sn AS (SELECT path, string_agg(best_line || ': ' || {snippet}, chr(10) ORDER BY rn) AS snippets FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority DESC, start_line) AS rn FROM c3) WHERE rn <= 3 GROUP BY path),
    f8 AS (SELECT *, concat_ws(chr(10), {', '.join(why)}) AS evidence, row_number() OVER (ORDER BY score DESC, shaped DESC, round(raw_score, 6) DESC, path)::INT AS rank FROM f7 JOIN lr USING (path) JOIN sn USING (path)),
    f9 AS (SELECT *, CASE WHEN rank <= 3 THEN 'open ' || path END AS next_action FROM f8)"""


def _singular(t: str) -> str:
    return singular_of(t)


def lexical_score(q: Query, scale: float = 1.0) -> str:
    bound = f"{len(q.lex_tokens) * 2.5}::DOUBLE * greatest(ln(lex_file_count + 1.0::DOUBLE), 1.0::DOUBLE)"
    part = f"{S.LEXICAL_MAX}::DOUBLE * least(score / ({bound}), 1.0::DOUBLE) * {scale}::DOUBLE"
    held = f"(SELECT path, list(term) AS held FROM x_postings WHERE term IN ({array(q.lex_tokens)[1:-1]}) GROUP BY path)"
    said = f"array_to_string(list_filter({array(q.lex_tokens)}, lambda t: list_contains(held, t)), ', ')"
    return f"SELECT path, CASE WHEN {part} >= {S.LEXICAL_MIN} THEN {part} ELSE 0 END AS lexical, {said} AS lexical_terms FROM ({bm25(q.lex_tokens)}) JOIN {held} USING (path), x_stats"


Q, W = Query(PHRASE), Query(WORDS)
VERSION = Query(PHRASE + " version")
_metrics = ("hit1", "hit3", "hit8", "rr", "ndcg8", "precision8", "recall8", "unnecessary")
_area = f"SELECT path, {AREA} AS area FROM (SELECT path, string_split(path, '/') AS s FROM x_files WHERE {role('path')} = 'source')"
_token_files = "SELECT 'src/t/test_' || replace(p_name, ' ', '_') || '_' || p_partkey || '.rs' AS path FROM part UNION ALL SELECT DISTINCT 'src/s/' || replace(p_name, ' ', '_') || '.rs' FROM part"
_test_stem = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + stem("path") + ", '^(test_)+', ''), '(_test)+$', ''), '(\\.test)+$', ''), '(\\.spec)+$', '')"
_path_tokens = lambda x: f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_related = f"""SELECT path, {role('path')} AS role, sum(weight) AS score, min(CASE WHEN weight >= 100 THEN 0 WHEN weight >= 50 THEN 1 ELSE 2 END) AS level, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons"""
_level = "['high', 'medium', 'low'][level + 1]"
_n = "additional_count + 1"


def _pct(p: float, of: str, name: str) -> str:
    return f"round(quantile_cont({of}::DOUBLE, {p}::DOUBLE), 6) AS {name}"


_compare = """c AS (SELECT task_id, task_type, hit1, latency_ms FROM x_scored WHERE mode = 'C'), d AS (SELECT task_id, hit1, latency_ms FROM x_scored WHERE mode = 'D'),
    t AS (SELECT task_id, mode, bool_or(label IN ('primary', 'acceptable')) AS has_hit FROM x_ranked JOIN x_judged USING (task_id, path) WHERE pos <= 8 GROUP BY ALL),
    bad AS (SELECT DISTINCT x.task_id FROM x_ranked x JOIN x_judged j USING (task_id, path) WHERE x.pos <= 8 AND x.mode = 'D' AND label = 'irrelevant' AND NOT EXISTS (SELECT 1 FROM x_ranked y WHERE y.task_id = x.task_id AND y.path = x.path AND y.mode = 'C' AND y.pos <= 8)),
    cmp AS (SELECT c.task_id, task_type, coalesce(td.has_hit, false) AND NOT coalesce(tc.has_hit, false) AS helpful, c.task_id IN (SELECT task_id FROM bad) AS bad_promotion, c.hit1 = 1 AND d.hit1 <> 1 AS regression, d.latency_ms - c.latency_ms AS delta
        FROM c JOIN d USING (task_id) LEFT JOIN t tc ON tc.task_id = c.task_id AND tc.mode = 'C' LEFT JOIN t td ON td.task_id = c.task_id AND td.mode = 'D')"""

BODIES = {
    "tokenize_terms": f"SELECT key, array_to_string({terms('value')}, ' ') AS terms FROM x_named",
    "tokenize_lexical": f"SELECT doc_id, len(t)::INT AS n_terms, md5(array_to_string(t, '|')) AS terms_md5 FROM (SELECT doc_id, {lexical('text')} AS t FROM documents)",
    "normalize_squash": f"SELECT conv_id, turn, md5({phrase('text')}) AS phrase_md5, length({squash('text')})::INT AS squashed FROM conversations",
    "shorten_snippet": f"SELECT conv_id, turn, {shorten('text', S.SNIPPET_WIDTH)} AS snippet FROM conversations",
    "singularize": f"SELECT word, {singular('word')} AS singular FROM (SELECT DISTINCT unnest(string_split_regex(text, '[^a-z]+')) AS word FROM documents) WHERE word <> ''",
    "classify_role_index": f"SELECT key, {role('value')} AS role FROM x_named",
    "classify_role_rank": f"SELECT key, {role('value', True)} AS role FROM x_named",
    "detect_language": "SELECT path, CASE " + " ".join(f"WHEN {any_of('path', ends=e)} THEN '{n}'" for n, e in S.LANGUAGE_ENDS.items()) + " END AS language FROM x_files",
    "same_area_key": _area,
    "glob_filter": f"SELECT path FROM x_files WHERE {globbed('path', INCLUDE)} AND NOT {globbed('path', EXCLUDE)}",
    "line_scan": scanned("x_lines", [PHRASE]),
    "scan_two_pass": two_pass(Q),
    "scan_coverage": f"SELECT coalesce(sum(n), 0)::BIGINT AS raw_matches, count(*) AS files, coalesce(max(n) >= 20, false) AS limit_hit FROM (SELECT path, count(*) AS n FROM ({two_pass(Q)}) GROUP BY path)",
    "baseline_match_rank": "SELECT path, count(*) AS matches FROM x_lines WHERE " + " OR ".join(f"contains(lower(line), {text(p)})" for p in W.patterns) + f" GROUP BY path ORDER BY 2 DESC, 1 LIMIT {S.CANDIDATE_LIMIT}",
    "match_clusters": f"SELECT path, cluster::BIGINT AS cluster, min(line_number) AS start_line, max(line_number) AS end_line, count(*)::INT AS n FROM ({clustered(two_pass(W))}) GROUP BY path, cluster",
    "line_ranges": f"""SELECT path, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM (SELECT path, min(line_number) AS a, max(line_number) AS b FROM
        (SELECT path, line_number, line_number - row_number() OVER (PARTITION BY path ORDER BY line_number) AS g FROM (SELECT DISTINCT path, line_number FROM ({two_pass(W)}))) GROUP BY path, g) GROUP BY path""",
    "lex_stats": "SELECT * FROM x_lengths",
    "lex_top_terms": "SELECT * FROM x_postings",
    "doc_freq": f"SELECT term, greatest(count(path), 1) AS df FROM (SELECT unnest({array(list(dict.fromkeys(W.lex_tokens + ['zzzz'])))}) AS term) LEFT JOIN x_postings USING (term) GROUP BY term",
    "index_stats": "SELECT lex_file_count, round(avg_doc_length, 6) AS avg_doc_length FROM x_stats",
    "bm25_topk": f"SELECT path, round(score, 6) AS score FROM ({bm25(VERSION.lex_tokens)}) ORDER BY 2 DESC, path LIMIT {S.CANDIDATE_LIMIT}",
    "find_lexical": found(Q),
    "find_match_all": found(W, True, ["source", "doc"]),
    "find_indexed": found(Q, lexical_sql=lexical_score(Q)),
    "role_counts": f"SELECT {role('path')} AS role, count(*) AS n FROM x_files GROUP BY 1",
    "edge_counts": """SELECT path, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing, string_agg(edge_type || '=' || n, ',' ORDER BY edge_type || '=' || n) AS types FROM (SELECT path, edge_type, sum(i) AS i, sum(o) AS o, sum(i + o) AS n FROM
        (SELECT src AS path, edge_type, 0 AS i, 1 AS o FROM x_edges UNION ALL SELECT dst, edge_type, 1, 0 FROM x_edges) GROUP BY path, edge_type) GROUP BY path""",
    "map_card": f"SELECT line_number, name, kind, visibility FROM x_symbols WHERE file_path = 'Brand#2' ORDER BY line_number, name, kind LIMIT {S.DISPLAY_LIMIT}",
    "symbol_lookup": f"SELECT name, kind, file_path, line_number, tier FROM (SELECT *, min(tier) OVER () AS best FROM (SELECT *, CASE WHEN name = {text(SYMBOL)} THEN 0 WHEN lower(name) = {text(SYMBOL.lower())} THEN 1 WHEN contains(lower(name), {text(SYMBOL.lower())}) THEN 2 END AS tier FROM x_symbols) WHERE tier IS NOT NULL) WHERE tier = best",
    "used_by_grouped": f"SELECT from_file, symbol_name, target_file, context, confidence, reason, (sum({_n}) - 1)::BIGINT AS additional_count, min(line_number) AS line_number, min(target_line) AS target_line FROM x_refs GROUP BY ALL",
    "used_by_summary": f"SELECT symbol_name, sum({_n})::BIGINT AS total, coalesce(sum({_n}) FILTER (WHERE context = 'production'), 0)::BIGINT AS production, coalesce(sum({_n}) FILTER (WHERE context IN ('test', 'fixture')), 0)::BIGINT AS test_fixture, coalesce(sum({_n}) FILTER (WHERE context = 'unknown'), 0)::BIGINT AS unknown FROM x_refs GROUP BY 1",
    "same_area_edges": f"SELECT area, count(*) AS n_files, (count(*) * (count(*) - 1) // 2)::BIGINT AS n_edges FROM ({_area}) GROUP BY area",
    "test_edges": f"""WITH f AS ({_token_files}), r AS (SELECT path, {role('path')} AS role FROM f), t AS (SELECT path AS src, {_test_stem} AS stem FROM r WHERE role = 'test'), s AS (SELECT path AS dst, {stem('path')} AS stem FROM r WHERE role = 'source'),
        tt AS (SELECT src, unnest({_path_tokens('stem')}) AS token FROM t), st AS (SELECT dst, unnest(list_distinct({_path_tokens('stem')})) AS token FROM s),
        p AS (SELECT src, dst, max(overlap) AS overlap, max(exact) AS exact FROM (SELECT src, dst, 0 AS overlap, 1 AS exact FROM t JOIN s USING (stem) UNION ALL SELECT src, dst, count(*), 0 FROM tt JOIN st USING (token) GROUP BY src, dst) GROUP BY src, dst)
        SELECT src, dst, CASE WHEN exact = 1 THEN 'extracted' WHEN overlap >= 2 THEN 'inferred' ELSE 'ambiguous' END AS confidence, CASE WHEN exact = 1 THEN 'filename stem matches' ELSE 'shared stem tokens: ' || overlap END AS reason
        FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM p) WHERE rn <= 3""",
    "config_edges": f"WITH r AS (SELECT path, {role('path')} AS role FROM x_files) SELECT path AS src, (SELECT path FROM r WHERE role = 'source' ORDER BY CASE path " + " ".join(f"WHEN {text(p)} THEN {i}" for i, p in enumerate(S.SOURCE_ROOTS)) + f" ELSE {len(S.SOURCE_ROOTS)} END, path LIMIT 1) AS dst FROM r WHERE role IN ('config', 'lockfile')",
    "import_resolve": f"""WITH n AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_id FROM documents)
        SELECT a.path AS from_file, n.doc_id::VARCHAR AS spec, b.path AS target FROM n JOIN x_files a ON a.doc_id = n.doc_id JOIN x_files b ON b.doc_id = n.next_id""",
    "symbol_refs": f"SELECT target_file, symbol_name, context, confidence, count(*) AS n, sum({_n})::BIGINT AS total FROM x_refs GROUP BY ALL",
    "related_files": f"""WITH w AS (SELECT dst AS path, {EDGE_W} AS weight, edge_type || ': ' || reason AS reason FROM x_edges WHERE src = '{FOCUS}' UNION ALL SELECT src, {EDGE_W}, edge_type || ': ' || reason FROM x_edges WHERE dst = '{FOCUS}' AND src <> '{FOCUS}'
        UNION ALL SELECT target_file, {REF_W}, symbol_name || ' reference for ' || reason FROM x_refs WHERE from_file = '{FOCUS}' UNION ALL SELECT from_file, {REF_W}, symbol_name || ' reference for ' || reason FROM x_refs WHERE target_file = '{FOCUS}' AND from_file <> '{FOCUS}'),
        r AS ({_related} FROM w WHERE path <> '{FOCUS}' GROUP BY path) SELECT path, role, score, {_level} AS confidence, reasons FROM r ORDER BY score DESC, level DESC, path LIMIT {S.DISPLAY_LIMIT}""",
    "blast_impact": f"""WITH w AS (SELECT from_file AS path, {REF_W} AS weight, CASE WHEN context = 'production' THEN 0 WHEN context IN ('test', 'fixture') THEN 1 ELSE 3 END AS category, symbol_name || ' reference (' || context || ')' AS reason FROM x_refs WHERE target_file = '{FOCUS}' AND from_file <> '{FOCUS}'
        UNION ALL SELECT src, {EDGE_W}, CASE edge_type WHEN 'same_area' THEN 2 WHEN 'likely_test_for' THEN 1 ELSE 0 END, edge_type || ': ' || reason FROM x_edges WHERE dst = '{FOCUS}' UNION ALL SELECT dst, {EDGE_W}, 2, edge_type || ': ' || reason FROM x_edges WHERE src = '{FOCUS}' AND edge_type = 'same_area'),
        r AS ({_related}, min(category) AS category FROM w WHERE path <> '{FOCUS}' GROUP BY path) SELECT path, role, {array(S.IMPACT_ORDER)}[category + 1] AS context, score, {_level} AS confidence, reasons FROM r""",
    "blast_risk": f"""WITH s0 AS (SELECT symbol_name, count(DISTINCT CASE WHEN context = 'production' THEN from_file END) AS pf, coalesce(sum(CASE WHEN context = 'production' THEN {_n} END), 0) AS pr, count(DISTINCT CASE WHEN context IN ('test', 'fixture') THEN from_file END) AS tf, coalesce(sum(CASE WHEN context IN ('test', 'fixture') THEN {_n} END), 0) AS tr, count(*) AS n FROM x_refs GROUP BY 1),
        a AS (SELECT name AS symbol_name, bool_or(kind = 'module') AS area FROM x_symbols GROUP BY 1), s AS (SELECT symbol_name, coalesce(pf, 0) AS pf, coalesce(pr, 0) AS pr, coalesce(tf, 0) AS tf, coalesce(tr, 0) AS tr, coalesce(n, 0) AS n, coalesce(area, false) AS area FROM s0 FULL JOIN a USING (symbol_name))
        SELECT symbol_name, CASE WHEN pf >= 3 THEN 'high' WHEN pf > 0 THEN 'medium' ELSE 'low' END AS level, concat_ws('; ', CASE WHEN pf >= 3 THEN pf || ' production files have direct symbol users (' || pr || ' production references)' WHEN pf > 0 THEN pf || ' production ' || CASE WHEN pf = 1 THEN 'file has' ELSE 'files have' END || ' direct symbol users (' || pr || ' production ' || CASE WHEN pr = 1 THEN 'reference' ELSE 'references' END || ')' END,
        CASE WHEN tr > 0 THEN tr || ' test/fixture references across ' || tf || ' ' || CASE WHEN tf = 1 THEN 'file' ELSE 'files' END WHEN pf > 0 THEN NULL WHEN area THEN 'only same_area evidence was found' WHEN n = 0 THEN 'no direct symbol users were found' END, 'index status is stale') AS reasons FROM s""",
    "cosine_topk": "SELECT * FROM x_nearest",
    "semantic_fusion": f"""SELECT path, round(CASE WHEN score IS NOT NULL THEN score + 0.3::DOUBLE * coalesce(similarity, 0) ELSE 0.8::DOUBLE * coalesce(similarity, 0) END, 6) AS score, CASE WHEN score IS NOT NULL THEN confidence WHEN coalesce(similarity, 0) >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, score IS NULL AS is_new, coalesce(anchor, false) AS anchor
        FROM x_candidates FULL OUTER JOIN x_nearest USING (path) ORDER BY 2 DESC, path LIMIT {S.CANDIDATE_LIMIT}""",
    "semantic_guard": "SELECT path, CASE WHEN best IS NOT NULL AND NOT anchor AND score >= best - 1e-9 THEN greatest(round(best - 0.01::DOUBLE, 6), 0) ELSE score END AS score, confidence, anchor FROM x_candidates, (SELECT max(score) FILTER (WHERE anchor) AS best FROM x_candidates)",
    "eval_per_task": "SELECT * EXCLUDE (query) FROM x_scored",
    "eval_grouping_sets": "SELECT repo_id, task_type, mode, count(*) AS n, sum(miss::INT)::BIGINT AS misses, " + ", ".join(f"round(avg({m}) + 1e-9, 6) AS {m}" for m in _metrics) + ", round(avg(CASE WHEN json_parse_ok THEN 1.0::DOUBLE ELSE 0 END), 6) AS json_ok FROM x_scored GROUP BY GROUPING SETS ((mode), (repo_id, mode), (task_type, mode))",
    "eval_percentiles": f"SELECT task_type, mode, {_pct(0.5, 'latency_ms', 'p50_ms')}, {_pct(0.95, 'latency_ms', 'p95_ms')}, count(latency_ms) AS n_timed FROM x_runs GROUP BY task_type, mode",
    "eval_c_vs_d": f"WITH {_compare} SELECT task_type, count(*) AS n, round(avg(helpful::INT), 6) AS helpful_rate, round(avg(bad_promotion::INT), 6) AS bad_promotion_rate, round(avg(regression::INT), 6) AS regression_rate, {_pct(0.5, 'delta', 'delta_p50')} FROM cmp GROUP BY GROUPING SETS ((), (task_type))",
    "eval_gates": """WITH m AS (SELECT mode, round(avg(hit1) + 1e-9, 6) AS hit1, round(avg(hit8) + 1e-9, 6) AS hit8, round(avg(rr) + 1e-9, 6) AS rr FROM x_scored GROUP BY mode), l AS (SELECT 'hit1_' || mode AS name, hit1 AS value FROM m UNION ALL SELECT 'hit8_' || mode, hit8 FROM m UNION ALL SELECT 'rr_' || mode, rr FROM m),
        g(name, op, threshold) AS (VALUES ('hit1_B', '>=', 0.70::DOUBLE), ('hit8_B', '>=', 0.85), ('hit1_C', '>=', 0.85), ('hit8_C', '>=', 1.0), ('rr_D', '>=', 0.95), ('hit8_E', '>=', 0.5)) SELECT name, value, op, threshold, coalesce(value >= threshold, false) AS passed FROM g LEFT JOIN l USING (name)""",
    "eval_demotions": "SELECT b.task_id, o.pos::INT AS rank FROM x_ranked b JOIN x_ranked o ON b.task_id = o.task_id AND b.path = o.path AND b.mode = 'C' AND b.pos = 1 AND o.mode = 'B' AND o.pos > 1 ORDER BY 1 LIMIT 30",
    "eval_no_hit": "SELECT task_id, repo_id, task_type, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM x_scored GROUP BY ALL HAVING bool_and(miss) ORDER BY repo_id, task_id LIMIT 30",
    "eval_slowest": "SELECT task_id, mode, latency_ms FROM x_runs WHERE latency_ms IS NOT NULL ORDER BY latency_ms DESC, task_id, mode LIMIT 20",
    "eval_validate": """WITH t AS (SELECT CASE WHEN item_id % 17 <> 16 THEN task_id END AS task_id, CASE WHEN item_id % 7 <> 0 THEN repo_id END AS repo_id, query FROM x_tasks), l AS (SELECT 'task_' || (doc_id % 60) AS task_id, 'repo' || (doc_id % 60 % 3) AS repo_id, CASE WHEN doc_id % 11 = 0 THEN '/abs' WHEN doc_id % 13 <> 0 THEN 'src/a.rs' END AS path, CASE WHEN toxic = 1 THEN 'bad' ELSE 'primary' END AS label FROM labels)
        SELECT 'error' AS severity, coalesce(task_id, 'None') || ': missing repo_id' AS message FROM t WHERE repo_id IS NULL UNION ALL SELECT 'error', coalesce(task_id, 'None') || ': missing query' FROM t WHERE query IS NULL OR query = '' UNION ALL SELECT 'error', 'task missing task_id' FROM t WHERE task_id IS NULL
        UNION ALL SELECT DISTINCT 'error', 'label references unknown task_id: ' || task_id FROM l WHERE task_id NOT IN (SELECT task_id FROM t WHERE task_id IS NOT NULL) UNION ALL SELECT DISTINCT 'error', l.task_id || ': label repo_id != task repo_id' FROM l JOIN t USING (task_id) WHERE t.repo_id IS NOT NULL AND l.repo_id IS DISTINCT FROM t.repo_id
        UNION ALL SELECT 'error', task_id || ': invalid label ''' || label || ''' for ' || coalesce(path, '') FROM l WHERE label NOT IN ('primary', 'acceptable', 'supporting', 'irrelevant') UNION ALL SELECT 'error', task_id || ': label entry missing path' FROM l WHERE path IS NULL OR path = ''
        UNION ALL SELECT 'error', task_id || ': path must be repo-relative forward-slash: ' || path FROM l WHERE path LIKE '/%' UNION ALL SELECT 'warning', task_id || ': no labels' FROM t WHERE task_id NOT IN (SELECT task_id FROM l) AND upper(task_id) NOT LIKE 'EXAMPLE%'""",
}


_family = "CASE WHEN suffix(path, '.rs') THEN 'rust' WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.go') THEN 'go' WHEN suffix(path, '.ts') THEN 'script' END"
_name = "replace(p_name, ' ', '_') || '_' || (p_partkey % 50)"


def _code_line() -> str:
    out = ""
    for i, (_, shapes) in enumerate(M.CODE):
        for j, shape in enumerate(shapes):
            before, after = shape.format(n="\0").split("\0")
            out += f" WHEN p_partkey % 4 = {i} AND p_size % 6 = {j} THEN {text(before)} || {_name} || {text(after)}"
    return f"CASE{out} ELSE '' END"


PARTS["x_code"] = f"SELECT 'src/' || replace(p_brand, '#', '') || {array([e for e, _ in M.CODE])}[CAST(p_partkey % 4 AS INT) + 1] AS path, p_partkey::INT AS line_number, {_code_line()} AS line FROM part"
PARTS["x_extracted"] = f"""SELECT path, line_number, f, line, CASE {' '.join(f"WHEN f = {text(g)} AND regexp_matches(line, {text(p)}) THEN regexp_extract(line, {text(p)}, 1)" for g, p, _ in PATTERNS)} END AS name,
    CASE {' '.join(f"WHEN f = {text(g)} AND regexp_matches(line, {text(p)}) THEN {text(k)}" for g, p, k in PATTERNS)} END AS kind FROM (SELECT *, {_family} AS f FROM x_code)"""
BODIES |= {
    "identifier_refs": """WITH d AS (SELECT path, line_number, name FROM x_extracted WHERE kind IS NOT NULL), k AS (SELECT name, min(path) AS target FROM d GROUP BY name HAVING count(*) = 1),
        u AS (SELECT path, line_number, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS name FROM x_code) SELECT path, name, target, count(*) AS n FROM u JOIN k USING (name) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = u.path AND d.line_number = u.line_number) GROUP BY ALL""",
    "semantic_wins": """WITH t AS (SELECT task_id, mode, string_agg(path, chr(10) ORDER BY pos) FILTER (WHERE pos <= 3) AS top, coalesce(list_sort(list(DISTINCT path) FILTER (WHERE label = 'irrelevant')), []) AS bad FROM x_ranked LEFT JOIN x_judged USING (task_id, path) WHERE pos <= 8 GROUP BY ALL),
        s AS (SELECT * FROM x_scored LEFT JOIN t USING (task_id, mode)),
        b AS (SELECT c.task_id, c.repo_id, c.task_type, c.query, c.miss AS cm, o.miss AS om, c.hit1 AS c1, o.hit1 AS o1, c.hit8 AS c8, o.hit8 AS o8, coalesce(c.top, '') AS ct, coalesce(o.top, '') AS ot, o.latency_ms - c.latency_ms AS ms, list_filter(coalesce(o.bad, []), lambda x: NOT list_contains(coalesce(c.bad, []), x)) AS new
            FROM s c JOIN s o ON c.task_id = o.task_id AND c.mode = 'C' AND o.mode = 'D'),
        l AS (SELECT 'win' AS list, row_number() OVER (ORDER BY task_type, task_id) AS place, task_id, repo_id, task_type, query, c8 AS base_hit, o8 AS other_hit, ct AS base_top, ot AS other_top, ms AS latency_delta, '' AS irrelevant FROM b WHERE cm AND NOT om
            UNION ALL SELECT 'regression', row_number() OVER (ORDER BY task_id), task_id, repo_id, task_type, query, c1, o1, ct, ot, ms, '' FROM b WHERE c1 = 1 AND o1 <> 1
            UNION ALL SELECT 'bad_promotion', row_number() OVER (ORDER BY repo_id, task_id), task_id, repo_id, task_type, query, NULL, NULL, '', '', NULL, array_to_string(list_sort(new), chr(10)) FROM b WHERE len(new) > 0)
        SELECT * REPLACE (place::INT AS place) FROM l WHERE place <= 20""",
    "vector_file_load": f"""WITH e AS (SELECT vec_id, embedding AS v, vec_id // {M.FILE_VECTORS} AS f FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT f, count(*) AS n, row_number() OVER () AS x FROM e GROUP BY f),
        p AS (SELECT f, n, CASE f % 11 WHEN 5 THEN 'version' WHEN 6 THEN 'model' WHEN 7 THEN 'stale' WHEN 4 THEN 'vectors file is too short' WHEN 3 THEN 'vectors file truncated (expected ' || (8 + n * {M.DIMENSIONS * 4}) || ' bytes, got ' || (6 + n * {M.DIMENSIONS * 4}) || ')'
            WHEN 9 THEN 'corrupt (' || (n - 1) || ' file entries, ' || n || ' vectors)' END AS problem FROM n)
        SELECT 'vectors_' || f || '.bin' AS path, problem, NULL AS name, 0 AS n, NULL::DOUBLE AS total, NULL::DOUBLE AS first FROM p WHERE problem IS NOT NULL
        UNION ALL SELECT 'vectors_' || f || '.bin', NULL, 'src/f' || vec_id || '.rs', len(v)::INT, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 6), v[1]::DOUBLE FROM e JOIN p USING (f) WHERE problem IS NULL""",
    "task_counts": "SELECT repo_id, count(*) AS n FROM x_tasks GROUP BY 1",
}


def whole(body: str) -> str:
    """The query with the parts that it needs before it."""
    need: list[str] = []

    def add(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bx_\w+\b", sql)):
            if name in PARTS and name not in need:
                add(PARTS[name])
                need.append(name)

    add(body)
    if not need:
        return body
    parts = ", ".join(f"{n} AS ({PARTS[n]})" for n in need)
    return f"WITH {parts}, {body[5:]}" if body.startswith("WITH ") else f"WITH {parts} {body}"


ORACLE_SQL = {name: whole(body) for name, body in BODIES.items()}
