"""SQL for DuckDB of the operators that SQL can express on whole small tables."""

from __future__ import annotations

from . import op8_secrets as P8
from . import op9_pii as P9
from . import op10_sharding as P10
from . import op13_manifest as P13

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

VECTORS = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id),
l AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a), k AS (SELECT id AS vec_id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(vec_id = coalesce(c, vec_id), true) AS kept FROM embeddings LEFT JOIN l USING (vec_id) LEFT JOIN k USING (vec_id)
"""

DOCUMENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), x AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM n JOIN r ON r.id = doc_id GROUP BY doc_id, n
"""


def _spans(kind: str, order: int, pattern: str, of: str = "t", keep: str = "TRUE") -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all({of}, '{p}')) + 1), lambda i: {{'s': (list_sum(list_transform(string_split_regex({of}, '{p}')[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(regexp_extract_all({of}, '{p}')[1:i - 1], lambda q: length(q))), 0))::BIGINT,
        'k': {order}, 'kind': '{kind}', 'm': regexp_extract_all({of}, '{p}')[i]}}), lambda x: {keep})"""


_VALUE = P8.ASSIGN_VALUE.replace("'", "''")
_CUT = f"regexp_replace(x.m, '{P8.TAIL}', '')"
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
b AS (SELECT r, doc_id, source, list_sort(list_concat({_spans('assign', 0, P8.ASSIGN, keep=f"length(regexp_replace(x.m, '{_VALUE}', '')) >= 8")}, {_spans('access', 1, P8.ACCESS)}, {_spans('hex', 2, P8.HEX)})) AS base, {_spans('reuse', 3, P8.RUN)} AS runs FROM d),
u AS (SELECT r, coalesce(doc_id::VARCHAR, '') AS repo, coalesce(source, '') AS owner, unnest(base) AS x FROM b),
v AS (SELECT *, regexp_replace(CASE WHEN x.kind = 'assign' THEN regexp_replace(x.m, '{_VALUE}', '') ELSE x.m END, '{P8.TAIL}', '') AS value FROM u),
k AS (SELECT DISTINCT value FROM v WHERE x.kind <> 'hex' AND length(value) >= {P8.LEAST}),
q AS (SELECT r, coalesce(doc_id::VARCHAR, '') AS repo, coalesce(source, '') AS owner, base, unnest(list_transform(runs, lambda x: {{'s': x.s, 'k': x.k, 'kind': x.kind, 'm': {_CUT}}})) AS x FROM b),
h AS (SELECT r, repo, owner, base, x, value FROM q JOIN k ON k.value = x.m),
o AS (SELECT value, count(DISTINCT owner) >= {P8.EXAMPLE_OWNERS} OR count(DISTINCT repo) >= {P8.EXAMPLE_REPOS} AS example FROM (SELECT value, repo, owner FROM v UNION ALL SELECT value, repo, owner FROM h) GROUP BY value),
n AS (SELECT r, count(*) FILTER (WHERE NOT example) AS n_live, count(*) FILTER (WHERE example) AS n_example FROM v JOIN o USING (value) GROUP BY r),
e AS (SELECT r, list(x) AS more FROM h JOIN o USING (value) WHERE NOT example AND len(list_filter(base, lambda y: x.s < y.s + length(y.m) AND y.s < x.s + length(x.m))) = 0 GROUP BY r),
f AS (SELECT r, doc_id, base, list_sort(list_concat(base, coalesce(more, []))) AS every, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM b LEFT JOIN n USING (r) LEFT JOIN e USING (r))
SELECT doc_id, len(list_filter(base, lambda x: x.kind = 'assign'))::BIGINT AS n_assign, len(list_filter(base, lambda x: x.kind = 'access'))::BIGINT AS n_access, len(list_filter(base, lambda x: x.kind = 'hex'))::BIGINT AS n_hex,
    sha256(array_to_string(list_transform(base, lambda x: x.kind || ':' || x.s || ':' || (x.s + length(x.m))), ',')) AS base_sha256, array_to_string(list_transform(every, lambda x: x.kind || ':' || x.s || ':' || (x.s + length(x.m))), ',') AS spans, n_live, n_example FROM f
"""


_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT ELSE CASE WHEN 2 * reverse({_DIGITS})[i]::INT > 9 THEN 2 * reverse({_DIGITS})[i]::INT - 9 ELSE 2 * reverse({_DIGITS})[i]::INT END END)) % 10 = 0"""
_JOINED = "array_to_string(list_transform({0}, lambda x: x.kind || ':' || x.s || ':' || (x.s + length(x.m))), ',')"
_WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
PRIVATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT r, doc_id, t, list_sort(list_concat({_spans('email', 0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')},
    {_spans('ip', 1, r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', keep="list_bool_and(list_transform(string_split(x.m, '.'), lambda p: p::HUGEINT <= 255))")},
    {_spans('card', 2, r'[0-9]([\x20-]?[0-9])+', keep=f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")},
    {_spans('phone', 3, r'\+[0-9][\x20().0-9-]+[0-9]', keep=f"length({_DIGITS}) BETWEEN 10 AND 15")})) AS base FROM d),
-- words and what stands between them; those with a letter, and with nothing beside them that makes them part of something longer
z AS (SELECT r, unnest(string_split_regex(t, '{_WORD}')) AS gap, unnest(regexp_extract_all(t, '{_WORD}')) AS m, generate_subscripts(string_split_regex(t, '{_WORD}'), 1) AS i FROM d),
y AS (SELECT r, m, gap, lead(gap) OVER (PARTITION BY r ORDER BY i) AS after, (sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY r ORDER BY i))::BIGINT - length(m) AS s FROM z),
l AS (SELECT r, {{'s': s, 'k': 4, 'kind': 'term', 'm': m}} AS x FROM y WHERE regexp_matches(m, '\\p{{L}}') AND NOT regexp_matches(right(gap, 1), '[@._%+-]') AND NOT regexp_matches(left(after, 1), '[@_%+-]')),
c AS (SELECT count(*)::DOUBLE AS n FROM d), g AS (SELECT min(r) AS r FROM d GROUP BY doc_id, t),
w AS (SELECT DISTINCT r, lower(x.m) AS term FROM l),
p AS (SELECT r, base FROM b SEMI JOIN g USING (r) WHERE len(base) > 0), e AS (SELECT DISTINCT r, unnest(list_transform(base, lambda x: x.kind || ':' || x.m)) AS entity FROM p),
o AS (SELECT DISTINCT r, lower(x.m) AS term FROM l JOIN p USING (r) WHERE len(list_filter(base, lambda y: x.s <= y.s + length(y.m) AND y.s <= x.s + length(x.m))) = 0),
ne AS (SELECT entity, count(*) AS n_entity FROM e GROUP BY entity), nt AS (SELECT term, count(*) AS n_term FROM w GROUP BY term),
q AS (SELECT entity, term, count(*) AS n_both FROM e JOIN o USING (r) GROUP BY entity, term HAVING count(*) >= {P9.SUPPORT}),
f AS (SELECT DISTINCT term FROM q JOIN ne USING (entity) JOIN nt USING (term), c WHERE n_entity < n AND ln(n * n_both / (n_entity * n_term)) / ln(n / n_entity) >= {P9.DISCLOSURE}::DOUBLE),
h AS (SELECT r, list(x) AS more FROM l JOIN b USING (r) WHERE lower(x.m) IN (SELECT term FROM f) AND len(list_filter(base, lambda y: x.s < y.s + length(y.m) AND y.s < x.s + length(x.m))) = 0 GROUP BY r)
SELECT doc_id, {', '.join(f"len(list_filter(base, lambda x: x.kind = '{k}'))::BIGINT AS n_{k}" for k in P9.KINDS[:4])}, sha256({_JOINED.format('base')}) AS base_sha256, {_JOINED.format('list_sort(list_concat(base, coalesce(more, [])))')} AS spans FROM b LEFT JOIN h USING (r)
"""


NEAREST = f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Every 100-byte string of every text by its hash, the first place of each, and what later places cover.
REPEATS = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, j, substr(h, 1000 * j + 1, 1198) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 1000 + 1)) AS j FROM d)),
p AS (SELECT r, 500 * j + i AS i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT r, j, h, unnest(range(0, least(500, length(h) // 2 - 99))) AS i FROM c WHERE length(h) >= 200)),
f AS (SELECT m, min(r * 4294967296 + i) AS first FROM p GROUP BY m HAVING count(*) > 1),
g AS (SELECT r, i FROM p JOIN f USING (m) WHERE r * 4294967296 + i > first),
s AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100 OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL THEN 1 ELSE 0 END AS opens FROM g),
u AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS n FROM s) GROUP BY r, n),
k AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list({'a': a, 'b': b} ORDER BY a) AS spans FROM u GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE substr(h, 1, 2 * spans[1].a) || coalesce(array_to_string(list_transform(range(1, len(spans) + 1), lambda j: substr(h, 2 * spans[j].b + 1, 2 * (coalesce(spans[j + 1].a, length(h) // 2) - spans[j].b))), ''), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _crc32(hexed: str) -> str:
    """CRC-32 of bytes given as hex digits."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({hexed}, '..'), lambda y: ('0x' || y)::BIGINT)), lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _hash52(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def _least(children: dict, at: str) -> str:
    """The place of the child with the least draw."""
    draws = ", ".join(f"{{'d': -ln(({_hash52(f"'{P10.SEED}{at}/{name}' || coalesce(':' || doc_id, '')")} + 0.5) / 4503599627370496.0::DOUBLE) / {P10._weight(child)}::DOUBLE, 'i': {i}}}" for i, (name, child) in enumerate(children.items()))
    return f"list_min([{draws}]).i"


def _descent(tree: P10.Tree) -> str:
    """The shard at the end of the descent, written out as nested cases."""
    regions = []
    for i, (region, racks) in enumerate(tree.items()):
        inner = " ".join(f"WHEN {j} THEN {list(leaves)}[1 + {_least(leaves, f'/{region}/{rack}')}]" for j, (rack, leaves) in enumerate(racks.items()))
        regions.append(f"WHEN {i} THEN CASE {_least(racks, f'/{region}')} {inner} END")
    return f"CASE {_least(tree, '')} {' '.join(regions)} END"


SHARDS = f"""
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, {_descent(P10.layout(16))}::INT AS shard, {_descent(P10.layout(17))}::INT AS grown_shard FROM documents),
c AS (SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size, shard, grown_shard,
    {_crc32('h')} AS text_crc32 FROM x),
r AS (SELECT *, {_hash52(f"'{P10.SLOT}:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32")} % greatest(1, least({P10.MOST}, -(-(SELECT count(*) FROM documents) // {P10.BASE * P10.RANGE_ROWS}))) AS range FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY range, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM r
"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _trees(name: str, height: int) -> str:
    """From {name}0 (tree, pos, n, digest) the nodes of each level, {name}k, and their siblings, {name}hk; a tree of one node stays as it is."""
    a, out = P13.ARITY, []
    for k in range(height + 1):
        out.append(f"""{name}h{k} AS (SELECT tree, pos, n, coalesce(string_agg(digest, '') OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo, coalesce(string_agg(digest, '') OVER (l ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi
    FROM {name}{k} WINDOW l AS (PARTITION BY tree, pos // {a} ORDER BY pos))""")
        out.append(f"{name}{k + 1} AS (SELECT tree, pos // {a} AS pos, (n + {a - 1}) // {a} AS n, CASE WHEN n = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}{k} GROUP BY tree, pos // {a}, n)")
    return ",\n".join(out)


#: Levels of the languages' trees and of the tree over them that the SQL is written out for.
LEVELS = {"t": 8, "u": 4}
_AT = [(n, k) for n, h in LEVELS.items() for k in range(h + 1)]
_FOLDS = ",\n".join(
    f"f{i} AS (SELECT *, CASE WHEN {n}n{k} = 1 THEN x ELSE sha256({n}lo{k} || x || {n}hi{k}) END AS y FROM {f'(SELECT * EXCLUDE (x, y), y AS x FROM f{i - 1})' if i else 'j'})" for i, (n, k) in enumerate(_AT)
)
MANIFEST = f"""
WITH d0 AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS leaf, CASE WHEN {_crc32('hex(encode(doc_id::VARCHAR))')} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d0),
t0 AS (SELECT tree, pos, n, leaf AS digest FROM d),
{_trees('t', LEVELS['t'])},
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM t{LEVELS['t'] + 1}),
u0 AS (SELECT '' AS tree, place AS pos, count(*) OVER () AS n, subroot AS digest FROM s),
{_trees('u', LEVELS['u'])},
j AS (SELECT d.doc_id, d.leaf, s.subroot, coalesce(d.changed, d.leaf) AS x, {', '.join(f'{n}h{k}.{c} AS {n}{c}{k}' for n, k in _AT for c in ('n', 'lo', 'hi'))} FROM d JOIN s USING (tree)
    {' '.join(f"JOIN {n}h{k} ON {n}h{k}.pos = {'d.pos' if n == 't' else 's.place'} // {P13.ARITY**k}{' AND th' + str(k) + '.tree = d.tree' if n == 't' else ''}" for n, k in _AT)}),
{_FOLDS}
SELECT doc_id, leaf, subroot, r.digest AS root, sha256({' || '.join(f'{n}lo{k} || {n}hi{k}' for n, k in _AT)}) AS proof_sha256, y AS folded_root, y = r.digest AS verified FROM f{len(_AT) - 1} JOIN u{LEVELS['u'] + 1} r ON true
"""
