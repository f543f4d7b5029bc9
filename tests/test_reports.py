"""Nested reports and their JSON."""

from pyspark.sql import functions as F

from lexigrove.operators import graph as G
from lexigrove.operators import rank as R
from lexigrove.operators import reports as P
from lexigrove.operators import vector as X

EDGES = "edge_type string, src string, dst string, confidence string, reason string"
SYMBOLS = "name string, kind string, file_path string, line_number int, visibility string"
REFS = "from_file string, symbol_name string, target_file string, target_line int, line_number int, confidence string, reason string, context string, additional_count int"


def test_find_comes_back_nested(spark, tmp_path):
    texts = {"src/a.rs": ["apache", "license text", "x", "the apache license"], "docs/b.md": ["nothing", "License"], "src/c.rs": ["none"]}
    lines = spark.createDataFrame([(p, i, s) for p, ls in texts.items() for i, s in enumerate(ls, 1)], "path string, line_number int, line string")
    report = R.find_document(lines, "apache license")
    P.write(report, f"{tmp_path}/r")
    got = P.read(spark, f"{tmp_path}/r", report).first()
    assert got == report.first()
    assert [c.path for c in got.candidates] == ["src/a.rs", "docs/b.md"] and got.coverage.displayed_candidate_count == got.coverage.raw_candidate_file_count == 2 and not got.coverage.limited
    first = got.candidates[0]
    assert [(r.start, r.end) for r in first.line_ranges] == [(1, 2), (4, 4)] and first.next_action == "open src/a.rs"
    assert {s.text for s in first.snippets} <= set(texts["src/a.rs"]) and all(e.type and e.detail for e in first.evidence)
    flat = R.written(report.select(F.inline("candidates"))).orderBy("rank").collect()
    assert flat == R.find_report(lines, "apache license").orderBy("rank").collect()
    none = R.find_document(lines, "qqqq wwww").first()
    assert none.candidates == [] and none.coverage.raw_match_count == 0


def test_map_keeps_the_first_of_each(spark):
    edges = spark.createDataFrame([("imports", "a", f"b{i}", "extracted", "r") for i in range(9)] + [("references", "b1", "a", "inferred", "r"), ("declares_module", "a", "z", "extracted", None)], EDGES)
    symbols = spark.createDataFrame([(f"s{i}", "struct", "a", 9 - i, "public") for i in range(8)], SYMBOLS)
    files = spark.createDataFrame([("a",), ("lonely",), ("z",)], "path string")
    report = P.map_documents(files, symbols, edges)
    got = {r.path: r for r in P.from_json(P.to_json(report), report).collect()}
    a = got["a"]
    assert [s.line_number for s in a.symbols] == [2, 3, 4, 5, 6] and [e.dst for e in a.outgoing_edges] == ["z", "b0", "b1", "b2", "b3"] and a.outgoing_edges[0].reason is None
    assert (a.connection_counts.incoming, a.connection_counts.outgoing, [(t.edge_type, t.n) for t in a.connection_counts.by_type]) == (1, 10, [("declares_module", 1), ("imports", 9), ("references", 1)])
    assert (got["lonely"].symbols, got["lonely"].connection_counts) == ([], None) and len(got["z"].incoming_edges) == 1


def test_symbols_and_neighbours(spark):
    symbols = spark.createDataFrame([("Foo", "struct", "a.rs", 1, "public"), ("Foo", "function", "b.rs", 2, "private"), ("foo", "struct", "c.rs", 3, "public")], SYMBOLS)
    refs = spark.createDataFrame([("x.rs", "Foo", "a.rs", 1, 5, "extracted", "r", "production", 2), ("y.rs", "Foo", "a.rs", 1, 6, "inferred", "q; w", "test", 0)], REFS)
    got = P.symbol_document(symbols, refs, "Foo").first()
    assert got.match_mode == "exact" and [(m.rank, m.file_path, m.n_uses, m.n_files) for m in got.matches] == [(1, "a.rs", 4, 2), (2, "b.rs", 0, 0)]
    assert P.symbol_document(symbols, refs, "FOO").first().match_mode == "case_insensitive" and P.symbol_document(symbols, refs, "nope").first().matches == []
    edges = spark.createDataFrame([("imports", "x.rs", "a.rs", "extracted", "i")], EDGES)
    focus = spark.createDataFrame([("a.rs",)], "path string")
    related = P.related_document(edges, refs, focus, "a.rs").first()
    assert {f.path: f.reasons for f in related.related_files} == {"x.rs": ["Foo reference for r", "imports: i"], "y.rs": ["Foo reference for q; w"]}
    blast = P.blast_document(edges, refs, focus, "a.rs", limit=1).first()
    assert [(f.path, f.context) for f in blast.impacted_files] == [("x.rs", "production")]
    assert P.blast_document(edges, refs, focus.where("path = ''"), "a").first().impacted_files == []


def test_anchors_come_from_evidence(spark):
    kind = "path string, role string, score double, confidence string, evidence array<struct<type:string,detail:string>>"
    rows = [
        ("src/a.rs", "source", 0.5, "high", [("exact_phrase_match", "x")]), ("src/b.rs", "source", 0.45, "high", [("exact_phrase_match", "x"), ("fixture_like_match", "y")]), ("docs/c.md", "doc", 0.48, "low", [("exact_phrase_match", "x")]),
        ("src/d.rs", "config", 0.3, "low", [("indexed_symbol_definition", "defines symbol FooBar")]), ("src/e.rs", "source", 0.2, "low", [("indexed_symbol_definition", "defines symbol FooBarBaz")]),
    ]
    candidates = spark.createDataFrame(rows, kind)
    semantic = spark.createDataFrame([("docs/c.md", 0.9), ("src/new.rs", 0.7)], "path string, similarity double")
    flags = {r.path: (r.anchor, r.symbol_anchor) for r in X.anchored(candidates, "foobar").collect()}
    assert flags == {"src/a.rs": (True, False), "src/b.rs": (False, False), "docs/c.md": (False, False), "src/d.rs": (False, True), "src/e.rs": (False, False)}
    fused = {r.path: round(r.score, 6) for r in X.rerank(candidates, semantic, "foo bar").collect()}
    assert fused == {"src/a.rs": 0.5, "docs/c.md": 0.49, "src/new.rs": 0.49, "src/b.rs": 0.45, "src/d.rs": 0.3, "src/e.rs": 0.2}
    named = {r.path: round(r.score, 6) for r in X.rerank(candidates, semantic, "FooBar").collect()}  # one identifier: nothing is added, but its definition leads
    assert named == {"src/a.rs": 0.29, "docs/c.md": 0.29, "src/b.rs": 0.29, "src/d.rs": 0.3, "src/e.rs": 0.2}


def test_the_definition_is_a_reason(spark):
    edges = spark.createDataFrame([("imports", "x.rs", "a.rs", "extracted", "i")], EDGES)
    focus = spark.createDataFrame([("a.rs",)], "path string")
    got = {tuple(r) for r in G.reason_summary(edges, spark.createDataFrame([], REFS), focus, defines=True).collect()}
    assert {r[:3] for r in got} == {("x.rs", "imports: i", 1), ("a.rs", "defines matched symbol", 1)} and max(r[3] for r in got) == 1000.0
