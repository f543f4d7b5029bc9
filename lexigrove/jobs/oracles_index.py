"""SQL of what an index adds: signals, evidence of users, reading lists, imports, references, stored files."""

from __future__ import annotations

import re

from .. import schema as S
from ..functions.text import singular_of
from ..operators.extract import PATTERNS
from ..operators.scan import Query
from ..sources import model as M
from .oracles import BODIES, EDGE_W, LEVELS, PARTS, REF_W, W, Q, _area, _n, array, found, lexical, lexical_score, phrase, pick, role, singular, squash, terms, text, whole
from .queries import FOCUS, FOCUS_FILE, IDENTIFIER, SYMBOL

NAME = Query(IDENTIFIER)


def strength(name: str, q: Query) -> str:
    held = " AND ".join(f"contains({squash(name)}, {text(t)})" for t in q.terms)
    return f"CASE WHEN {squash(name)} = {text(q.squashed)} OR {phrase(name)} = {text(q.phrase)} THEN 3 WHEN contains({squash(name)}, {text(q.squashed)}) OR ({held}) THEN 2 WHEN list_has_any({terms(name)}, {array(q.terms)}) THEN 1 END"


def signals(q: Query, scale: float) -> str:
    """Definitions, references and edges of each file; the three best, and the highest tier of all."""
    named = " AND ".join(f"list_contains({terms('symbol_name')}, {text(t)})" for t in q.terms)
    one = {t: f"(x = {text(t)} OR x = {text(singular_of(t))} OR {singular('x')} = {text(t)})" for t in q.terms}
    hits = " + ".join(f"(len(list_filter({terms('other')}, lambda x: {one[t]})) > 0)::INT" for t in q.terms)
    order = f"list_position({array(M.CONTEXTS)}, context) * 10 + list_position({array(LEVELS)}, confidence)"
    exact = f"CASE role WHEN 'source' THEN {0.68 if q.identifier_like else 0.44}::DOUBLE WHEN 'doc' THEN 0.32 WHEN 'test' THEN 0.44 WHEN 'config' THEN 0.36 WHEN 'lockfile' THEN 0.16 WHEN 'generated' THEN 0.06 ELSE 0.40 END"
    module = "edge_type IN ('imports', 'references', 'declares_module')"
    return f"""SELECT path, list({{'type': type, 'detail': detail, 'score': score}} ORDER BY rn) FILTER (WHERE rn <= 3) AS sg, max(tier) AS top_tier FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier DESC, score DESC, level, type, detail) AS rn FROM (
        SELECT path, 'indexed_symbol_definition' AS type, 'defines symbol ' || name AS detail, CASE s WHEN 3 THEN ({exact}) * {scale}::DOUBLE + CASE WHEN role = 'source' THEN {0.10 * scale}::DOUBLE ELSE 0 END WHEN 2 THEN 0.28::DOUBLE * {scale}::DOUBLE ELSE 0.14::DOUBLE * {scale}::DOUBLE END AS score,
            CASE s WHEN 3 THEN CASE WHEN role = 'source' THEN 5 ELSE 4 END WHEN 2 THEN 3 ELSE 2 END AS tier, 3 - s AS level FROM (SELECT DISTINCT file_path AS path, name, line_number, {strength('name', q)} AS s, {role('file_path', True)} AS role FROM x_dsymbols) WHERE s IS NOT NULL
        UNION ALL SELECT path, 'indexed_symbol_reference', 'references symbol ' || symbol_name, (CASE c WHEN 'production' THEN 0.16::DOUBLE WHEN 'fixture' THEN 0.04 WHEN 'test' THEN 0.03 ELSE 0.01 END + CASE l WHEN 'extracted' THEN 0.03::DOUBLE WHEN 'ambiguous' THEN -0.01 ELSE 0 END) * {scale}::DOUBLE,
            CASE c WHEN 'production' THEN 2 WHEN 'unknown' THEN 0 ELSE 1 END, list_position({array(LEVELS)}, l) - 1 FROM (SELECT from_file AS path, symbol_name, line_number, reason, arg_min(context, {order}) AS c, arg_min(confidence, {order}) AS l FROM x_drefs
                WHERE {squash('lower(symbol_name)')} = {text(q.squashed)} OR lower(symbol_name) = {text(q.phrase)} OR ({named}) GROUP BY ALL) WHERE NOT (c = 'unknown' AND l = 'ambiguous')
        UNION ALL SELECT path, 'indexed_edge', CASE WHEN r > 1 THEN 'connected to query-relevant ' || other || ' via ' || edge_type ELSE 'indexed edge ' || edge_type || ' ' || reason END,
            (CASE WHEN {module} THEN 0.05::DOUBLE WHEN edge_type = 'same_area' THEN 0.005 ELSE 0.01 END + CASE WHEN inbound AND edge_type <> 'same_area' THEN 0.01::DOUBLE ELSE 0 END) * {scale}::DOUBLE * r, CASE WHEN {module} THEN 1 ELSE 0 END, CASE WHEN edge_type = 'same_area' THEN 2 ELSE 1 END
            FROM (SELECT *, CASE WHEN edge_type = 'same_area' OR n = 0 THEN 1.0::DOUBLE WHEN other IN (SELECT file_path FROM x_dsymbols WHERE ({strength('name', q)}) IS NOT NULL) THEN 1.5 WHEN n >= {len(q.terms)} THEN 1.3 ELSE 1.1 END AS r
                FROM (SELECT *, {hits} AS n FROM (SELECT src AS path, dst AS other, edge_type, reason, src = dst AS inbound FROM x_dedges UNION ALL SELECT dst, src, edge_type, reason, true FROM x_dedges WHERE src <> dst)))
    )) GROUP BY path"""


PARTS |= {
    "x_next": "SELECT n.doc_id, a.path AS here, b.path AS there FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_id FROM documents) n JOIN x_files a ON a.doc_id = n.doc_id JOIN x_files b ON b.doc_id = n.next_id",
    "x_dsymbols": f"SELECT {pick(M.SYMBOL_NAMES, '(doc_id // 3)')} AS name, {pick(M.KINDS, 'doc_id')} AS kind, path AS file_path, (doc_id % 50 + 1)::INT AS line_number FROM x_files",
    "x_drefs": f"SELECT here AS from_file, {pick(M.SYMBOL_NAMES, 'doc_id')} AS symbol_name, there AS target_file, (doc_id % 30)::INT AS line_number, {pick(LEVELS, 'doc_id')} AS confidence, 'use' AS reason, {pick(M.CONTEXTS, '(doc_id // 2)')} AS context, (doc_id % 3)::INT AS additional_count FROM x_next",
    "x_dedges": f"SELECT {pick(M.EDGE_KINDS, 'doc_id')} AS edge_type, here AS src, there AS dst, {pick(LEVELS, 'doc_id')} AS confidence, 'next' AS reason FROM x_next",
    "x_impact": BODIES["blast_impact"],
    "x_users": """SELECT target_file AS path, from_file AS usr, CASE context WHEN 'production' THEN 'P' WHEN 'unknown' THEN 'U' ELSE 'T' END AS kind, additional_count + 1 AS n, false AS module FROM x_drefs WHERE from_file <> target_file
        UNION ALL SELECT dst, src, CASE edge_type WHEN 'same_area' THEN 'A' WHEN 'likely_test_for' THEN 'T' ELSE 'P' END, 0, edge_type IN ('imports', 'references', 'declares_module', 'configures') FROM x_dedges WHERE src <> dst
        UNION ALL SELECT src, dst, 'A', 0, false FROM x_dedges WHERE edge_type = 'same_area' AND src <> dst""",
    "x_user": "SELECT path, usr, bool_or(kind = 'P') AS p, bool_or(kind = 'T') AS t, bool_or(kind = 'A') AS a, bool_or(module) AS module, sum(CASE WHEN kind = 'P' THEN n ELSE 0 END) AS pr, sum(CASE WHEN kind = 'T' THEN n ELSE 0 END) AS tr, sum(CASE WHEN kind = 'U' THEN n ELSE 0 END) AS ur FROM x_users GROUP BY path, usr",
    "x_evidence": """SELECT path, count(*) FILTER (WHERE pr > 0) AS symbol_files, sum(pr)::BIGINT AS symbol_references, count(*) FILTER (WHERE p AND module) AS module_files, count(*) FILTER (WHERE pr > 0 OR (p AND module)) AS production_files,
        count(*) FILTER (WHERE tr > 0 OR (t AND NOT p)) AS test_files, sum(tr)::BIGINT AS test_references, count(*) FILTER (WHERE a AND NOT p AND NOT t) AS area_files, sum(ur)::BIGINT AS unknown_references, count(*) FILTER (WHERE ur > 0) AS unknown_files FROM x_user GROUP BY path""",
}
_priority = "list_position(['struct', 'enum', 'trait', 'type_alias', 'function', 'module', 'const', 'static', 'impl', 'unknown'], kind)"
_many = lambda n, word: f"CASE WHEN {n} = 1 THEN '{word}' ELSE '{word}s' END"
_guarded = BODIES["semantic_fusion"].replace("coalesce(anchor, false) AS anchor", "coalesce(anchor, false) AS anchor, score IS NOT NULL AND suffix(path, '7') AS symbol_anchor")

INDEX_BODIES = {
    "find_report": found(W, report=True),
    "find_with_signals": found(Q, lexical_sql=lexical_score(Q, 0.85), signals_sql=signals(Q, 0.85)),
    "find_indexed_report": found(NAME, lexical_sql=lexical_score(NAME), signals_sql=signals(NAME, 1.0), report=True),
    "file_evidence": "SELECT * FROM x_evidence",
    "file_risk": f"""SELECT path, CASE WHEN production_files >= 3 THEN 'high' WHEN production_files > 0 THEN 'medium' ELSE 'low' END AS level, concat_ws('; ', CASE WHEN production_files > 0 THEN production_files || ' production ' || CASE WHEN production_files = 1 THEN 'file has' ELSE 'files have' END || ' direct inbound impact (' ||
        concat_ws('; ', CASE WHEN symbol_references > 0 THEN symbol_references || ' production symbol ' || {_many('symbol_references', 'reference')} || ' across ' || symbol_files || ' ' || {_many('symbol_files', 'file')} END,
            CASE WHEN module_files > 0 THEN module_files || ' production file/module ' || {_many('module_files', 'user')} || ' across ' || module_files || ' ' || {_many('module_files', 'file')} END) || ')' END,
        CASE WHEN test_references > 0 OR (production_files = 0 AND test_files > 0) THEN test_references || ' test/fixture references across ' || test_files || ' ' || {_many('test_files', 'file')} WHEN production_files > 0 THEN NULL
            WHEN area_files > 0 THEN 'only same_area evidence was found' WHEN symbol_references + test_references + unknown_references = 0 THEN 'no direct symbol or file users were found' END, 'index status is stale') AS reasons FROM x_evidence""",
    "file_symbols": f"SELECT file_path, pos::INT AS pos, name, kind, line_number FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {_priority}, line_number, name) AS pos FROM x_symbols WHERE visibility = 'public' AND kind NOT IN ('impl', 'unknown')) WHERE pos <= 5",
    "best_symbol": f"SELECT file_path, name, line_number FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {_priority} * 10 + CASE WHEN visibility = 'private' THEN 100 ELSE 0 END, line_number, name) AS rn FROM x_symbols) WHERE rn = 1",
    "symbol_uses": "SELECT s.name, s.file_path, coalesce(sum(r.additional_count + 1), 0)::BIGINT AS n_uses, count(DISTINCT r.from_file) AS n_files FROM (SELECT DISTINCT name, file_path FROM x_symbols) s LEFT JOIN x_refs r ON r.symbol_name = s.name AND r.target_file = s.file_path GROUP BY ALL",
    "shown_refs": f"""SELECT from_file, context, target_file, confidence, symbol_name, line_number, more FROM (SELECT *, sum({_n}) OVER (PARTITION BY from_file, context, target_file)::BIGINT - 1 AS more,
        row_number() OVER (PARTITION BY from_file, context, target_file ORDER BY list_position({array(LEVELS)}, confidence), line_number, symbol_name, reason) AS rn FROM x_refs) WHERE rn = 1""",
    "shown_edges": "SELECT dst, pos::INT AS pos, edge_type, src, reason FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY list_position(['declares_module', 'imports', 'references', 'likely_test_for', 'configures', 'same_area'], edge_type), edge_type, src, reason) AS pos FROM x_edges) WHERE pos <= 5",
    "reason_summary": f"""SELECT path, label, count(*) AS n, max(weight) AS weight FROM (SELECT CASE WHEN src = '{FOCUS}' THEN dst ELSE src END AS path, CASE WHEN edge_type = 'same_area' THEN edge_type ELSE edge_type || ': ' || reason END AS label, {EDGE_W} AS weight FROM x_edges WHERE '{FOCUS}' IN (src, dst)
        UNION ALL SELECT CASE WHEN from_file = '{FOCUS}' THEN target_file ELSE from_file END, symbol_name || ' reference (' || context || ')', {REF_W} FROM x_refs WHERE '{FOCUS}' IN (from_file, target_file)) WHERE path <> '{FOCUS}' GROUP BY path, label""",
    "inspection_order": f"""SELECT row_number() OVER (ORDER BY a, list_position({array(S.IMPACT_ORDER)}, context), score DESC, list_position(['high', 'medium', 'low'], confidence), path)::INT AS pos, path FROM
        (SELECT 0 AS a, '{FOCUS}' AS path, NULL AS context, NULL AS score, NULL AS confidence UNION ALL SELECT 1, path, context, score, confidence FROM x_impact WHERE path <> '{FOCUS}')""",
    "impact_share": "SELECT path, score, round(CASE WHEN max(score) OVER () > 0 THEN least(score / max(score) OVER (), 1) ELSE 0 END, 6) AS share FROM x_impact",
    "area_edges": f"WITH a AS ({_area}), f AS (SELECT * FROM a ORDER BY path LIMIT 1) SELECT least(a.path, f.path) AS src, greatest(a.path, f.path) AS dst FROM a JOIN f ON a.area = f.area AND a.path <> f.path",
    "semantic_documents": f"""WITH d AS (SELECT 'path: ' || f.path || chr(10) || 'role: ' || {role('f.path')} || chr(10) || coalesce('symbols: ' || names || chr(10), '') || '---' || chr(10) || substring(coalesce(text, ''), 1, 1500) AS document, f.path AS path
        FROM x_files f LEFT JOIN (SELECT file_path, string_agg(name, ', ' ORDER BY line_number, name) AS names FROM x_dsymbols GROUP BY 1) s ON s.file_path = f.path) SELECT path, length(document)::INT AS n_chars, md5(document) AS document_md5 FROM d""",
    "semantic_symbol_guard": f"""WITH f AS ({_guarded}), b AS (SELECT max(score) FILTER (WHERE anchor) AS p, max(score) FILTER (WHERE symbol_anchor) AS s FROM f),
        g AS (SELECT * REPLACE (CASE WHEN p IS NOT NULL AND NOT anchor AND score >= p - 1e-9 THEN greatest(round(p - 0.01::DOUBLE, 6), 0) ELSE score END AS score) FROM f, b)
        SELECT path, CASE WHEN s IS NOT NULL AND NOT symbol_anchor AND score >= s - 1e-9 THEN greatest(round(s - 0.01::DOUBLE, 6), 0) ELSE score END AS score, confidence, is_new, anchor, symbol_anchor FROM g""",
    "index_files": f"""SELECT path, {role('path')} AS role, strlen(coalesce(text, ''))::BIGINT AS size_bytes, text IS NOT NULL AND strlen(text) <= 262144 AS hashed, CASE WHEN strlen(text) <= 262144 THEN len({lexical('text')})::INT ELSE -1 END AS doc_length,
        CASE WHEN strlen(text) <= 262144 THEN least(len(list_distinct({lexical('text')})), 300)::INT ELSE -1 END AS n_terms FROM x_files""",
    "scan_pruned": f"""WITH e AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages UNION SELECT {pick(['target', 'a/build', 'src/distance', '.git/x', 'b/.hidden', 'node_modules/c', 'ok'], 'p_partkey')} || '/' || replace(p_name, ' ', '.') || {pick(['.rs', '.exe', '.DLL'], 'p_size')} FROM part)
        SELECT path, NOT list_has_any(string_split(path, '/'), ['.git', 'target', 'node_modules', 'dist', 'build', 'manual-test']) AND NOT contains(path, 'manual-test/') AS scanned,
        NOT regexp_matches(lower(path), '\\.(exe|dll|pdb)$') AND len(list_filter(string_split(path, '/'), lambda x: prefix(x, '.') AND length(x) > 1)) = 0 AS indexed FROM e""",
    "index_state": """SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'missing' WHEN now IS NULL THEN 'unverifiable' WHEN was IS NOT DISTINCT FROM now THEN 'fresh' ELSE 'stale' END AS state
        FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 'r' || (p_partkey % 5) END AS was, CASE WHEN p_partkey % 3 = 0 THEN 'r1' WHEN p_partkey % 4 <> 0 THEN 'r' || (p_partkey % 5) END AS now FROM part)""",
    "eval_fan_out": "SELECT b.task_id, b.path, coalesce(max(CASE WHEN o.mode = 'C' THEN o.pos END), 0)::INT AS pos_C, coalesce(max(CASE WHEN o.mode = 'D' THEN o.pos END), 0)::INT AS pos_D FROM x_ranked b LEFT JOIN x_ranked o ON o.task_id = b.task_id AND o.path = b.path AND o.mode IN ('C', 'D') WHERE b.mode = 'B' AND b.pos = 1 GROUP BY ALL",
    "eval_found_json": """WITH r AS (SELECT 'task_' || item_id AS run, item_id, item_id % 11 <> 0 AND item_id % 7 <> 0 AS ok FROM benchmark) SELECT run, ok,
        CASE WHEN ok THEN coalesce(array_to_string(list_transform(range(1, item_id % 4 + 1), lambda k: 'src/f' || (item_id + k) || '.rs'), ','), '') ELSE '' END AS paths, CASE WHEN ok THEN ['ready', 'off'][CAST(item_id % 2 AS INT) + 1] END AS semantic_status FROM r""",
    "eval_task_json": "SELECT 'task_' || item_id AS task_id, 'repo' || (item_id % 3) AS repo_id, 'q' || item_id AS query FROM benchmark WHERE item_id % 6 <> 0 AND item_id % 9 <> 8 AND item_id % 3 IN (1, 2) AND item_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
}

# ---- references of Rust source lines

_rust_name = "'Part' || (p_partkey - p_partkey % 10 + CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 10 * (p_size % 4) END)"


def _written(shape: str) -> str:
    bits = re.split(r"\{([nk])\}", shape)
    return " || ".join(({"n": _rust_name, "k": "p_partkey"}[b]) if j % 2 else text(b.replace("{{", "{").replace("}}", "}")) for j, b in enumerate(bits))


_shapes = " ".join(f"WHEN {i} THEN {_written(x)}" for i, x in enumerate(M.TEST_LINES))
_of = lambda c, words: "(" + " OR ".join(f"contains({c}, {text(w)})" for w in words) + ")"
_asserts = ["assert!", "assert_eq!", "assert_ne!", "assert_matches!", "matches!"]
_strong = f"(prefix(code, 'use ') OR contains(code, '::') OR {_of('code', _asserts)} OR (contains(code, ':') AND contains(code, '=')))"
_fixture_names = ["fixture", "helper", "loaded", "source", "build", "make", "repo", "symbol", "setup"]
_fixture_parts = ["fixture", "helper", "loaded_index", "source_texts", "source_file", "build_", "make_", "repo(", "symbol("]
_fn = r"^(?:pub(?:\([^)]*\))? ?)?(?:(?:async|const|unsafe|default) )*fn ([A-Za-z_][A-Za-z0-9_]*)"
_before = "OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
PARTS |= {
    "x_rust": f"SELECT 'src/f' || (p_partkey // 100) || CASE WHEN (p_partkey // 100) % 5 = 4 THEN '_test.rs' ELSE '.rs' END AS path, (p_partkey % 100 + 1)::INT AS line_number, CASE CASE WHEN p_partkey % 10 = 0 THEN {M.DEFINING_LINE} ELSE (p_partkey * 7 + p_size) % {len(M.TEST_LINES)} END {_shapes} END AS line FROM part",
    "x_rsymbols": f"""SELECT path, line_number, CASE {' '.join(f"WHEN regexp_matches(line, {text(p)}) THEN regexp_extract(line, {text(p)}, 1)" for g, p, _ in PATTERNS if g == 'rust')} END AS name, CASE {' '.join(f"WHEN regexp_matches(line, {text(p)}) THEN {text(k)}" for g, p, k in PATTERNS if g == 'rust')} END AS kind FROM x_rust""",
    "x_code_lines": "SELECT x.path, x.line_number, trim(regexp_replace(line, '//.*$', ''), E' \\t') AS code, s.kind IS NOT NULL AS defines FROM x_rust x JOIN x_rsymbols s USING (path, line_number)",
    # what a line does to the state: S begins a test section, A is a test attribute, F a function line that defines no symbol
    "x_events": f"""SELECT *, CASE WHEN prefix(code, '#[cfg(test)]') OR prefix(code, 'mod tests ') THEN 'S' WHEN prefix(code, '#[test]') THEN 'A' WHEN NOT defines AND regexp_matches(code, {text(_fn)}) THEN 'F' END AS ev,
        suffix(path, '_test.rs') AS test_path FROM x_code_lines WHERE code <> ''""",
    "x_state": f"""SELECT *, test_path OR max(CASE WHEN ev = 'S' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_number) = 1 AS in_test, last_value(ev IGNORE NULLS) {_before} AS previous FROM x_events""",
    "x_functions": f"""SELECT *, CASE WHEN ev = 'S' THEN 'unknown' WHEN ev = 'F' THEN CASE WHEN previous = 'A' THEN 'test' WHEN NOT in_test THEN 'production' WHEN contains(lower(regexp_extract(code, {text(_fn)}, 1)), 'test') THEN 'test' WHEN {_of(f"lower(regexp_extract(code, {text(_fn)}, 1))", _fixture_names)} THEN 'fixture' ELSE 'unknown' END END AS sets FROM x_state""",
    "x_contexts": f"""SELECT path, line_number, code, in_test, CASE WHEN NOT in_test THEN 'production' WHEN now IN ('fixture', 'test') THEN now WHEN prefix(code, 'use ') THEN 'fixture' WHEN {_of('code', _asserts)} THEN 'test' WHEN contains(code, ':') AND contains(code, '=') THEN 'fixture' WHEN {_of('code', _fixture_parts)} THEN 'fixture' ELSE 'unknown' END AS context
        FROM (SELECT *, coalesce(last_value(sets IGNORE NULLS) {_before}, CASE WHEN test_path THEN 'unknown' ELSE 'production' END) AS now FROM x_functions) WHERE NOT defines AND ev IS DISTINCT FROM 'S' AND ev IS DISTINCT FROM 'A'""",
    "x_unique": f"SELECT name, min(path) AS target_file, min(line_number) AS target_line FROM x_rsymbols WHERE kind IN ({array(S.REFERENCEABLE_KINDS)[1:-1]}) GROUP BY name HAVING count(*) = 1",
    "x_names": r"""SELECT path, line_number, context, 'extracted' AS confidence, 'use statement reference' AS reason, unnest(list_transform(string_split(regexp_extract(code, '\{(.*)\}', 1), ','), lambda p: string_split(trim(regexp_replace(p, '\s+as\s+.*$', '')), '::')[-1])) AS name FROM x_contexts WHERE regexp_matches(code, '^(pub )?use .*\{')
        UNION ALL SELECT path, line_number, context, 'inferred', 'qualified or token reference', unnest(list_distinct(regexp_extract_all(code, '[A-Za-z0-9_]+'))) FROM x_contexts WHERE NOT regexp_matches(code, '^(pub )?use ') AND (NOT (contains(code, chr(34)) OR contains(code, chr(39)) OR in_test) OR """
    + _strong
    + ")",
    "x_ifile": "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN 'src/' ELSE '' END || 'pkg' || (p_partkey // 4 % 5) || '/m_' || p_partkey || ['.py', '.ts', '.go', '.rs'][CAST(p_partkey % 4 AS INT) + 1] AS path FROM part",
}
INDEX_BODIES |= {
    "line_contexts": "SELECT path, line_number, code, context, in_test FROM x_contexts",
    "symbol_ref_contexts": f"SELECT path AS from_file, name AS symbol_name, target_file, context, confidence, reason, min(target_line) AS target_line, min(line_number) AS line_number, (count(*) - 1)::INT AS additional_count FROM x_names JOIN x_unique USING (name) WHERE {role('path')} = 'source' GROUP BY ALL",
    "module_uses": "SELECT path, line_number, module FROM (SELECT path, line_number, unnest(list_distinct(regexp_extract_all(line, '([A-Za-z0-9_]+)::', 1))) AS module FROM x_rust) WHERE module IN (SELECT name FROM x_rsymbols WHERE kind = 'struct')",
    "manifest_edges": """WITH m AS (SELECT p_partkey AS k, p_size AS s, 'ext' || (p_size % 4) || '/' AS f FROM part WHERE p_size % 10 <> 0),
        e AS (SELECT f || k || '_manifest.json' AS src, unnest([f || 'bg_' || k || CASE WHEN s % 3 = 0 THEN '.ts' ELSE '.js' END, f || 'lib/s_' || k || CASE WHEN s % 2 = 0 THEN '.mjs' ELSE '/index.ts' END, 'c_' || k || '.jsx', f || 'c_' || k || '.css']) AS dst, unnest(['background.service_worker', 'background.scripts', 'content_scripts.js', 'content_scripts.css']) AS field FROM m)
        SELECT 'references' AS edge_type, src, dst, 'extracted' AS confidence, 'manifest ' || field || ' references ' || dst AS reason FROM e""",
}
# ---- facts of whole source files: what each line of a file declares, imports and names, listed by hand

_SYMBOLS = [
    [(16, "Sym_", "struct"), (20, "run_", "function"), (23, "_late_", "function", "private"), (27, "after_", "function")],
    [(14, "nested_", "function", "private"), (18, "Sym_", "struct"), (21, "run_", "function"), (22, "make_", "function"), (24, "second_", "function"), (25, "_cls_", "struct", "private"), (26, "gen_", "function", "private"), (29, "_hid_", "function", "private")],
    [(9, "Sym_", "struct"), (10, "Act_", "trait"), (14, "Num_", "type_alias"), (16, "One_", "const"), (16, "Two_", "const"), (17, "Three_", "const"), (19, "V_", "static"), (19, "W_", "static"), (20, "Start_", "function"), (23, "Run_", "function")],
    [(10, "Sym_", "struct"), (13, "E_", "enum"), (17, "Display for Sym_", "impl", "private"), (20, "LIST_", "const", "private"), (20, "S_", "static", "private"), (22, "run_", "function"), (33, "T_", "trait", "private")],
]
#: Of Rust by lines; the names of the third and the ninth have no number.
_LINE_SYMBOLS = [
    (8, "child_", "module", "public"), (10, "Sym_", "struct", "private"), (15, "from", "function", "private"), (13, "E_", "enum", "public"), (17, "Display for Sym_", "impl", "private"), (18, "inner_", "function", "private"),
    (20, "LIST_", "const", "private"), (22, "run_", "function", "private"), (30, "check", "function", "private"), (32, "Alias_", "type_alias", "private"), (33, "T_", "trait", "private"),
]
#: By language: line, module, how, names, default name, certainty.
_IMPORTS = [
    [(4, "os", "import"), (4, "pkg{d}.m_{b}", "import"), (5, ".", "from", "m_{a},gone"), (9, ".m_{a}", "from", "Sym_{a},nothing"), (11, "..pkg{d}.m_{b}", "from", "Sym_{b}")],
    [(2, "./m_{a}", "from", "Sym_{a},other", "Def_{a}"), (6, "../pkg{d}/m_{b}.ts", "from", "", "Only"), (7, "../pkg{d}/m_{b}", "from"), (8, "../pkg{d}/m_{b}", "from", "Sym_{b}"), (13, "./m_{a}", "import")],
    [(2, "pkg{d}/m_{b}", "import"), (6, "./m_{a}", "import")],
    [(2, "crate::pkg{d}::m_{b}::{{Sym_{b}, self", "use"), (2, "crate::pkg{d}::m_{b}", "use"), (3, "super::m_{a}", "use", "", None, "inferred"), (4, "std::fmt", "use", "", None, "inferred"), (4, "std::io::Write", "use", "", None, "inferred"), (8, "child_{k}", "mod")],
]
#: Files that these name where they exist: line, path, names, default name, certainty.
_TARGETS = [
    [(4, "pkg{d}/m_{b}.py"), (9, "{f}/m_{a}.py", "Sym_{a},nothing"), (11, "pkg{d}/m_{b}.py", "Sym_{b}")],
    [(2, "{f}/m_{a}.ts", "Sym_{a},other", "Def_{a}"), (6, "pkg{d}/m_{b}.ts", "", "Only"), (7, "pkg{d}/m_{b}.ts"), (8, "pkg{d}/m_{b}.ts", "Sym_{b}"), (13, "{f}/m_{a}.ts")],
    [(2, "pkg{d}/m_{b}.go"), (6, "{f}/m_{a}.go")],
    [(2, "src/pkg{d}/m_{b}.rs"), (3, "src/{f}/m_{a}.rs", "", None, "inferred")],
]


def _filled(shape: str | None) -> str:
    bits = re.split(r"\{([abdkf])\}", shape) if shape is not None else ["NULL"]
    value = {"a": "k + 20", "b": "k + 4", "d": "(k // 4 + 1) % 5", "k": "k", "f": "folder"}
    return "NULL::VARCHAR" if shape is None else " || ".join(f"({value[b]})::VARCHAR" if j % 2 else text(b.replace("{{", "{").replace("}}", "}")) for j, b in enumerate(bits))


def _listed(rows: list[tuple], lang: int, columns: list[str], defaults: list) -> list[str]:
    out = []
    for row in rows:
        cells = [*row, *defaults[len(row) - len(columns) :]] if len(row) < len(columns) else list(row)
        out.append(f"SELECT k, path, folder, {cells[0]}::INT AS line_number, " + ", ".join(f"{_filled(c)} AS {n}" for n, c in zip(columns[1:], cells[1:])) + f" FROM x_src WHERE k % 4 = {lang}")
    return out


def _union(lists: list[list[tuple]], columns: list[str], defaults: list) -> str:
    return " UNION ALL ".join(x for lang, rows in enumerate(lists) for x in _listed(rows, lang, columns, defaults))


def _signature(lines: list[list[str]]) -> str:
    """The text of a line of a file, shortened."""
    each = " ".join(f"WHEN k % 4 = {lang} AND line_number = {n} THEN {_filled(line)}" for lang, of in enumerate(lines) for n, line in enumerate(of, 1) if "{k}" in line or "fn " in line)
    return f"CASE {each} END"


_sized = f"CASE WHEN length(line) > {S.SIGNATURE_WIDTH} THEN substring(line, 1, {S.SIGNATURE_WIDTH - 3}) || '...' ELSE line END"
_trimmed = "trim(regexp_replace(line, '\\s+', ' ', 'g'))"


def _symbol_sql(rows: str) -> str:
    return f"SELECT path, line_number, name, kind, visibility, {_sized} AS signature FROM (SELECT * REPLACE ({_trimmed} AS line) FROM (SELECT *, {_signature(M.SOURCE_LINES)} AS line FROM ({rows})))"


_numbered_name = lambda n: n if n in ("from", "check") else n + "{k}"
_child_path = "'src/' || folder || '/m_' || k || '/child_' || k || '.rs'"
_root_line = "'fn go() { root_' || k || '::go(); root_' || (k - 8) || '::go() }'"
_edge = "SELECT DISTINCT 'imports' AS edge_type, path AS src, target AS dst, confidence, 'imports ' || target AS reason FROM x_found"
PARTS |= {
    "x_src": "SELECT k, path, 'pkg' || (k // 4 % 5) AS folder FROM x_ifile",
    "x_there": f"SELECT path FROM x_ifile UNION SELECT folder || '/__init__.py' FROM x_src WHERE k % 4 = 0 AND folder IN ('pkg0', 'pkg1') UNION SELECT {_child_path} FROM x_src WHERE k % 8 = 3 UNION SELECT 'src/root_' || k || '.rs' FROM x_src WHERE k % 8 = 7",
    "x_items": _symbol_sql(_union([[(n, _numbered_name(name), kind, *v) for n, name, kind, *v in rows] for rows in _SYMBOLS], ["line_number", "name", "kind", "visibility"], ["public"]))
    + f" UNION ALL SELECT {_child_path}, 1, 'of_child', 'function', 'public', 'pub fn of_child() {{}}' FROM x_src WHERE k % 8 = 3 UNION ALL SELECT 'src/root_' || k || '.rs', 3, 'go', 'function', 'private', {_root_line} FROM x_src WHERE k % 8 = 7",
    # a package's own file binds the names; without one each name is a file
    "x_named_targets": _union(_TARGETS, ["line_number", "target", "names", "default_name", "confidence"], ["", None, "extracted"])
    + """ UNION ALL SELECT k, path, folder, 5, CASE WHEN folder IN ('pkg0', 'pkg1') THEN folder || '/__init__.py' ELSE folder || '/m_' || (k + 20) || '.py' END, CASE WHEN folder IN ('pkg0', 'pkg1') THEN 'm_' || (k + 20) || ',gone' ELSE '' END, NULL, CASE WHEN folder IN ('pkg0', 'pkg1') THEN 'extracted' ELSE 'inferred' END FROM x_src WHERE k % 4 = 0"""
    # without a file below it a module resolves to the file that declares it
    + f""" UNION ALL SELECT k, path, folder, 8, CASE WHEN k % 8 = 3 THEN {_child_path} ELSE path END, '', NULL, 'extracted' FROM x_src WHERE k % 4 = 3
        UNION ALL SELECT k, 'src/root_' || k || '.rs', folder, n, 'src/root_' || k || '.rs', '', NULL, CASE n WHEN 1 THEN 'inferred' ELSE 'extracted' END FROM x_src, (SELECT unnest([1, 2]) AS n) WHERE k % 8 = 7""",
    "x_found": "SELECT n.* FROM x_named_targets n SEMI JOIN x_there t ON t.path = n.target",
    "x_bound": """SELECT DISTINCT path AS from_file, name AS symbol_name, target AS target_file, line_number, confidence, word || ' import binding from ' || target AS reason FROM (
        SELECT *, unnest(string_split(names, ',')) AS name, 'direct' AS word FROM x_found WHERE names <> '' UNION ALL SELECT *, default_name, 'default' FROM x_found WHERE default_name IS NOT NULL)""",
}
INDEX_BODIES |= {
    "extract_symbols": "SELECT DISTINCT * FROM x_items",
    "extract_imports": "SELECT path, line_number, module, confidence, how, names, default_name FROM ("
    + _union(_IMPORTS, ["line_number", "module", "how", "names", "default_name", "confidence"], ["", None, "extracted"])
    + ") UNION ALL SELECT 'src/root_' || k || '.rs', n, CASE n WHEN 1 THEN 'self::root_' || k || '::X' ELSE 'crate::root_' || k END, CASE n WHEN 1 THEN 'inferred' ELSE 'extracted' END, 'use', '', NULL FROM x_src, (SELECT unnest([1, 2]) AS n) WHERE k % 8 = 7",
    "readable_texts": """SELECT path, (CASE WHEN doc_id % 10 = 0 THEN n + 2 WHEN doc_id % 7 = 0 THEN n * 200 ELSE n END)::INT AS size_bytes, CASE WHEN doc_id % 10 = 0 THEN -1 WHEN doc_id % 7 = 0 AND n * 200 > 262144 AND NOT regexp_matches(path, '\\.(rs|py|ts|js|go)$') THEN -1 WHEN doc_id % 7 = 0 THEN length(text) * 200 ELSE length(text) END::INT AS n_chars
        FROM (SELECT *, strlen(text) AS n FROM x_files)""",
    "surviving_repos": "SELECT 'repo' || s_suppkey AS repo_id, s_name FROM supplier WHERE s_suppkey IN (SELECT item_id * 3 FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels))",
    # by tree: what the rules say of each kind of file
    "ignored_files": """SELECT 'r' || r || '/' || CASE i WHEN 0 THEN 'src/a_' || k || '.rs' WHEN 1 THEN 'build/out_' || k || '.o' WHEN 2 THEN 'logs/keep_' || k || '.log' WHEN 3 THEN 'logs/x_' || k || '.tmp' WHEN 4 THEN 'deep/build/in_' || k || '.rs' ELSE 'docs/' || k || '.md' END AS path,
        CASE i WHEN 0 THEN r = 3 WHEN 1 THEN r <> 1 WHEN 2 THEN false WHEN 3 THEN r <> 3 WHEN 4 THEN r <> 1 ELSE r = 0 OR (r = 1 AND k NOT BETWEEN 10 AND 19) END AS ignored FROM (SELECT p_partkey AS k, p_partkey % 5 AS r, p_size % 6 AS i FROM part)""",
    "import_edges": _edge,
    "import_bindings": "SELECT * FROM x_bound",
    "binding_refs": "SELECT DISTINCT from_file, symbol_name, target_file, target_line, b.line_number, confidence, reason, 'production' AS context, 0 AS additional_count FROM x_bound b JOIN (SELECT path AS target_file, name AS symbol_name, min(line_number) AS target_line FROM x_items GROUP BY ALL) USING (target_file, symbol_name)",
    "fallback_symbols": _symbol_sql(_union([[], [], [], [(n, _numbered_name(name), kind, v) for n, name, kind, v in _LINE_SYMBOLS]], ["line_number", "name", "kind", "visibility"], []))
    + f" UNION ALL SELECT {_child_path}, 1, 'of_child', 'function', 'public', 'pub fn of_child() {{}}' FROM x_src WHERE k % 8 = 3 UNION ALL SELECT 'src/root_' || k || '.rs', 3, 'go', 'function', 'private', {_root_line} FROM x_src WHERE k % 8 = 7",
    "fallback_edges": f"""WITH e AS (SELECT 'declares_module' AS edge_type, path AS src, CASE WHEN k % 8 = 3 THEN {_child_path} ELSE path END AS dst, 'declares module child_' || k AS reason, 'extracted' AS confidence FROM x_src WHERE k % 4 = 3
        UNION ALL SELECT kind, path, 'src/pkg' || ((k // 4 + 1) % 5) || '/m_' || (k + 4) || '.rs', kind || ' crate::pkg' || ((k // 4 + 1) % 5) || '::m_' || (k + 4), 'extracted' FROM x_src, (SELECT unnest(['imports', 'references']) AS kind) WHERE k % 4 = 3
        UNION ALL SELECT 'imports', path, 'src/' || folder || '/m_' || (k + 20) || '.rs', 'imports crate::' || folder || '::m_' || (k + 20), 'extracted' FROM x_src WHERE k % 4 = 3
        UNION ALL SELECT kind, 'src/root_' || k || '.rs', 'src/root_' || k || '.rs', kind || ' crate::root_' || k, 'extracted' FROM x_src, (SELECT unnest(['imports', 'references']) AS kind) WHERE k % 8 = 7
        UNION ALL SELECT 'references', 'src/root_' || k || '.rs', 'src/root_' || (k - 8) || '.rs', 'references crate::root_' || (k - 8), 'inferred' FROM x_src WHERE k % 8 = 7)
        SELECT edge_type, src, dst, confidence, reason FROM e SEMI JOIN x_there t ON t.path = e.dst""",
    "rust_facts": f"""SELECT 'statements' AS corpus, 'symbol' AS fact, path, kind AS what, name, visibility AS detail, line_number FROM (SELECT DISTINCT * FROM x_items) WHERE suffix(path, '.rs')
        UNION ALL SELECT 'statements', 'edge', src, edge_type, dst, confidence, 0 FROM ({_edge}) WHERE suffix(src, '.rs')
        UNION ALL SELECT 'lines', 'symbol', 'src/f_' || p_partkey || '.rs', 'function', 'deep_' || p_partkey, 'public', 2 FROM part UNION ALL SELECT 'lines', 'symbol', 'src/f_' || p_partkey || '.rs', 'type_alias', 'T_' || p_partkey, 'private', 4 FROM part
        UNION ALL SELECT 'lines', 'edge', 'src/f_' || p_partkey || '.rs', 'imports', 'src/f_' || p_partkey || '.rs', 'extracted', 0 FROM part""",
}
INDEX_BODIES["all_edges"] = f"""SELECT edge_type, src, dst, confidence, reason FROM ({_edge}) UNION SELECT 'imports', 'src/f_' || p_partkey || '.rs', 'src/f_' || p_partkey || '.rs', 'extracted', 'imports crate::f_' || p_partkey FROM part
    UNION SELECT edge_type, src, dst, confidence, reason FROM ({INDEX_BODIES['manifest_edges']}) UNION SELECT 'likely_test_for', src, dst, confidence, reason FROM ({BODIES['test_edges']})
    UNION SELECT 'configures', src, dst, 'inferred', 'configuration' FROM ({BODIES['config_edges']}) UNION SELECT 'same_area', src, dst, 'inferred', 'same area' FROM ({INDEX_BODIES['area_edges']})"""
INDEX_BODIES |= {
    "kind_counts": "SELECT kind, visibility, count(*) AS n, count(DISTINCT file_path) AS files FROM x_symbols GROUP BY ALL",
    "mode_guess": "SELECT key, CASE WHEN contains(value, '/') OR contains(value, chr(92)) OR contains(value, '.') OR prefix(key, 'file/') THEN 'file' ELSE 'symbol' END AS mode FROM x_named",
    "focus_paths": f"SELECT DISTINCT file_path AS path, 'file' AS mode, './x/../{FOCUS_FILE}' AS asked FROM x_symbols WHERE file_path = '{FOCUS_FILE}' UNION ALL SELECT DISTINCT file_path, 'symbol', {text(SYMBOL)} FROM ({BODIES['symbol_lookup']})",
    "all_refs": f"SELECT from_file, symbol_name, target_file, context, confidence, reason, target_line, line_number, additional_count FROM ({INDEX_BODIES['symbol_ref_contexts']}) UNION SELECT from_file, symbol_name, target_file, context, confidence, reason, target_line, line_number, additional_count FROM ({INDEX_BODIES['binding_refs']})",
}
_by_kind = f"CASE edge_type {' '.join(f'WHEN {text(k)} THEN {i}' for i, k in enumerate(S.EDGE_ORDER))} ELSE {len(S.EDGE_ORDER)} END, edge_type"
_ordered = lambda c, order: f"CASE {c} {' '.join(f'WHEN {text(k)} THEN {i}' for i, k in enumerate(order))} ELSE {len(order)} END"


def _first_edges(mine: str, other: str) -> str:
    return f"SELECT {mine} AS path, string_agg(edge_type || ' ' || {other} || ' ' || confidence, chr(10) ORDER BY p) AS edges FROM (SELECT *, row_number() OVER (PARTITION BY {mine} ORDER BY {_by_kind}, {other}, reason) AS p FROM x_edges) WHERE p <= {S.DISPLAY_LIMIT} GROUP BY {mine}"


INDEX_BODIES |= {
    "find_json": INDEX_BODIES["find_report"],
    "related_json": BODIES["related_files"],
    "blast_json": f"SELECT * FROM ({BODIES['blast_impact']}) ORDER BY {_ordered('context', S.IMPACT_ORDER)}, score DESC, {_ordered('confidence', ['high', 'medium', 'low'])}, path LIMIT {S.DISPLAY_LIMIT}",
    "map_json": f"""WITH n AS (SELECT src AS path FROM x_edges UNION SELECT dst FROM x_edges UNION SELECT file_path FROM x_symbols),
        s AS (SELECT file_path AS path, string_agg(line_number || ' ' || name || ' ' || kind || ' ' || visibility, chr(10) ORDER BY p) AS symbols FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_number, name, kind) AS p FROM x_symbols) WHERE p <= {S.DISPLAY_LIMIT} GROUP BY 1),
        o AS ({_first_edges('src', 'dst')}), i AS ({_first_edges('dst', 'src')}), c AS ({BODIES['edge_counts']})
        SELECT path, {role('path')} AS role, coalesce(symbols, '') AS symbols, coalesce(o.edges, '') AS outgoing, coalesce(i.edges, '') AS incoming, coalesce(c.incoming, 0) AS n_incoming, coalesce(c.outgoing, 0) AS n_outgoing, coalesce(types, '') AS types
        FROM n LEFT JOIN s USING (path) LEFT JOIN o USING (path) LEFT JOIN i USING (path) LEFT JOIN c USING (path)""",
    "symbol_json": f"""WITH l AS ({BODIES['symbol_lookup']}), m AS (SELECT DISTINCT l.*, visibility FROM l JOIN x_symbols USING (name, kind, file_path, line_number)),
        f AS (SELECT *, row_number() OVER (ORDER BY {_ordered('kind', S.KIND_ORDER)}, file_path, line_number, name) AS rank FROM m),
        u AS (SELECT symbol_name AS name, target_file AS file_path, sum(additional_count + 1)::BIGINT AS n_uses, count(DISTINCT from_file) AS n_files FROM x_refs GROUP BY ALL)
        SELECT {text(SYMBOL)} AS query, ['exact', 'case_insensitive', 'substring'][tier + 1] AS match_mode, rank::INT AS rank, name, kind, file_path, line_number, visibility, coalesce(n_uses, 0) AS n_uses, coalesce(n_files, 0) AS n_files FROM f LEFT JOIN u USING (name, file_path) WHERE rank <= {S.DISPLAY_LIMIT}""",
}
def _reranked(q: Query, annotate: bool) -> str:
    """Anchors from evidence, then fusion, then both guards."""
    c = found(q, lexical_sql=lexical_score(q), signals_sql=signals(q, 1.0), report=True)
    total = "c.score" if annotate else "CASE WHEN c.score IS NOT NULL THEN c.score + 0.3::DOUBLE * coalesce(similarity, 0) ELSE 0.8::DOUBLE * coalesce(similarity, 0) END"
    name = text("indexed_symbol_definition: defines symbol " + q.raw.lower())
    return f"""SELECT path, CASE WHEN s IS NOT NULL AND NOT symbol_anchor AND score >= s - 1e-9 THEN greatest(round(s - 0.01::DOUBLE, 6), 0) ELSE score END AS score, confidence, is_new, anchor, symbol_anchor, {text(q.raw)} AS asked FROM (
        SELECT * REPLACE (CASE WHEN p IS NOT NULL AND NOT anchor AND score >= p - 1e-9 THEN greatest(round(p - 0.01::DOUBLE, 6), 0) ELSE score END AS score) FROM (
        SELECT *, max(score) FILTER (WHERE anchor) OVER () AS p, max(score) FILTER (WHERE symbol_anchor) OVER () AS s FROM (
        SELECT path, round({total}, 6) AS score, CASE WHEN c.score IS NOT NULL THEN c.confidence WHEN coalesce(similarity, 0) >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, c.score IS NULL AS is_new, coalesce(anchor, false) AS anchor, coalesce(symbol_anchor, false) AS symbol_anchor
        FROM (SELECT path, score, confidence, fine AND contains(evidence, 'exact_phrase_match: ') AS anchor, fine AND list_contains(string_split(lower(evidence), chr(10)), {name}) AS symbol_anchor
            FROM (SELECT *, {role('path')} IN ('source', 'config') AND NOT contains(evidence, 'fixture_like_match: ') AS fine FROM ({c}))) c {'LEFT' if annotate else 'FULL'} JOIN x_doc_near USING (path) ORDER BY 2 DESC, 1 LIMIT {S.CANDIDATE_LIMIT})))"""


PARTS["x_doc_near"] = f"""SELECT path, similarity FROM (SELECT path, round(greatest(least(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings JOIN x_files ON doc_id = vec_id WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)), 1), -1), 6) AS similarity
    FROM embeddings JOIN x_files ON doc_id = vec_id WHERE embedding IS NOT NULL) WHERE similarity >= {S.COSINE_FLOOR} ORDER BY similarity DESC, path LIMIT {S.SEMANTIC_TOP}"""
_mine = "(SELECT file_path FROM x_defining)"
PARTS["x_defining"] = BODIES["symbol_lookup"]
INDEX_BODIES |= {
    "reason_summary_symbol": f"""SELECT path, label, count(*) AS n, max(weight) AS weight FROM (SELECT dst AS path, CASE WHEN edge_type = 'same_area' THEN edge_type ELSE edge_type || ': ' || reason END AS label, {EDGE_W} AS weight FROM x_edges WHERE src IN {_mine}
        UNION ALL SELECT src, CASE WHEN edge_type = 'same_area' THEN edge_type ELSE edge_type || ': ' || reason END, {EDGE_W} FROM x_edges WHERE dst IN {_mine} UNION ALL SELECT target_file, symbol_name || ' reference (' || context || ')', {REF_W} FROM x_refs WHERE from_file IN {_mine}
        UNION ALL SELECT from_file, symbol_name || ' reference (' || context || ')', {REF_W} FROM x_refs WHERE target_file IN {_mine}) WHERE path NOT IN {_mine} GROUP BY path, label UNION ALL SELECT DISTINCT file_path, 'defines matched symbol', 1, 1000.0::DOUBLE FROM x_defining""",
    "semantic_rerank": f"SELECT * FROM ({_reranked(NAME, True)}) UNION ALL SELECT * FROM ({_reranked(Q, False)})",
}
INDEX_SQL = {name: whole(body) for name, body in INDEX_BODIES.items()}
