from pyspark.sql import functions as F

from lexigrove.operators import edges as E
from lexigrove.operators import evaluate as V
from lexigrove.operators import graph as G
from lexigrove.operators import lexical as L
from lexigrove.operators import rank as R
from lexigrove.operators import scan as C
from lexigrove.operators import vector as X


def lines(spark, files):
    rows = [(p, i, s) for p, text in files.items() for i, s in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "path string, line_number int, line string")


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def test_patterns_of_queries():
    assert C.Query("auth redirect").patterns == ["auth", "redirect", "auth redirect"]
    assert C.Query("SearchReport").patterns == ["search", "report", "searchreport"]
    assert C.Query("SearchReport").identifier_like and not C.Query("a b").identifier_like


def test_scan_caps_each_file_and_pass(spark):
    found = C.line_scan(lines(spark, {"a": "\n".join(["Hit"] * 30), "b": "miss"}), ["hit"])
    assert found.count() == 20 and found.agg(F.max("line_number")).first()[0] == 20


def test_scan_of_nothing(spark):
    empty = lines(spark, {"a": ""}).where("false")
    assert C.coverage(C.two_pass(empty, C.Query("x y"))).first().asDict() == {"raw_matches": 0, "files": 0, "limit_hit": False}


def test_clusters_and_ranges(spark):
    m = spark.createDataFrame([("a", n, "x") for n in (1, 3, 4, 7, 8)], "path string, line_number int, snippet string")
    got = {(r.start_line, r.end_line) for r in C.clusters(m).collect()}
    assert got == {(1, 4), (7, 8)}
    assert C.line_ranges(m).first().ranges == "1, 3-4, 7-8"


def test_postings_keep_the_commonest_terms(spark):
    text = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(310)) + " zzz zzz"
    posts = L.postings(table(spark, {"a": text}))
    assert posts.count() == 300 and posts.where("term = 'zzz'").first().tf == 2
    assert L.doc_lengths(table(spark, {"a": text})).first().doc_length == 312


def test_bm25_ranks_the_file_with_the_terms_first(spark):
    files = {f"f{i}": "filler words only here" for i in range(10)} | {"hit": "session token session", "half": "session filler"}
    got = [r.path for r in L.top_k(L.bm25(table(spark, files), ["session", "token"])).collect()]
    assert got == ["hit", "half"]


def test_phrase_in_source_beats_docs(spark):
    found = R.find(lines(spark, {"src/flow.rs": "fn auth redirect()", "docs/flow.md": "the auth redirect page", "src/other.rs": "auth only"}), "auth redirect").collect()
    assert [r.path for r in found][:2] == ["src/flow.rs", "docs/flow.md"]
    assert found[0].confidence == "high" and found[0].score > found[1].score


def test_match_all_drops_partial(spark):
    files = {"src/a.rs": "auth redirect", "src/b.rs": "auth only"}
    assert {r.path for r in R.find(lines(spark, files), "auth redirect", match="all").collect()} == {"src/a.rs"}


def test_index_part_raises_and_anchor_caps(spark):
    files = {"src/a.rs": "auth redirect here", "src/redirect_auth.rs": "auth here\n\n\n\nredirect there"}
    plain = {r.path: r.score for r in R.find(lines(spark, files), "auth redirect").collect()}
    indexed = {r.path: r.score for r in R.find_indexed(lines(spark, files), table(spark, files), "auth redirect").collect()}
    assert plain["src/redirect_auth.rs"] > plain["src/a.rs"]
    assert indexed["src/redirect_auth.rs"] < indexed["src/a.rs"]


def test_test_and_config_edges(spark):
    files = table(spark, {p: "" for p in ("a/tests/session_test.rs", "src/session.rs", "src/session_store.rs", "src/main.rs", "x.toml")})
    got = {(r.dst, r.confidence) for r in E.test_edges(files).collect()}
    assert got == {("src/session.rs", "extracted"), ("src/session_store.rs", "ambiguous")}
    assert [(r.src, r.dst) for r in E.config_edges(files).collect()] == [("x.toml", "src/main.rs")]


def test_resolve_takes_the_first_that_exists(spark):
    asked = spark.createDataFrame([("a.py", "m", ["m/__init__.py", "m.py"])], "from_file string, spec string, options array<string>")
    assert E.resolve(asked, table(spark, {"m.py": "", "x.py": ""})).first().target == "m.py"


REFS = "from_file string, symbol_name string, target_file string, target_line int, line_number int, confidence string, reason string, context string, additional_count int"
EDGES = "edge_type string, src string, dst string, confidence string, reason string"


def test_refs_group(spark):
    refs = spark.createDataFrame([("a", "S", "t", 5, n, "inferred", "use", "production", k) for n, k in ((9, 0), (3, 2))], REFS)
    row = G.grouped_refs(refs).first()
    assert (row.additional_count, row.line_number, row.target_line) == (3, 3, 5)


def test_lookup_cascade(spark):
    symbols = spark.createDataFrame([("Foo",), ("foo",), ("FooBar",)], "name string")
    names = lambda n: sorted(r.name for r in G.lookup(symbols, n).collect())
    assert names("Foo") == ["Foo"] and names("FOO") == ["Foo", "foo"] and names("bar") == ["FooBar"] and names("zzz") == []


def test_related_and_impact(spark):
    edges = spark.createDataFrame([("imports", "a", "f", "extracted", "r"), ("same_area", "b", "f", "inferred", "r"), ("imports", "f", "c", "extracted", "r")], EDGES)
    refs = spark.createDataFrame([("d", "S", "f", 1, 1, "extracted", "use", "test", 0)], REFS)
    focus = spark.createDataFrame([("f",)], "path string")
    assert [r.path for r in G.related(edges, refs, focus).collect()] == ["a", "c", "d", "b"]
    assert {r.path: r.context for r in G.impact(edges, refs, focus).collect()} == {"a": "production", "b": "same_area", "d": "test_fixture"}


def test_risk_levels(spark):
    rows = [(f"p{i}", "high", "t", 1, 1, "extracted", "use", "production", 0) for i in range(3)] + [("p", "medium", "t", 1, 1, "extracted", "use", "production", 0), ("q", "low", "t", 1, 1, "extracted", "use", "test", 1)]
    got = {r.symbol_name: (r.level, r.reasons) for r in G.risk(spark.createDataFrame(rows, REFS)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"high": "high", "medium": "medium", "low": "low"}
    assert got["medium"][1] == "1 production file has direct symbol users (1 production reference)"


def test_cosine(spark):
    v = spark.createDataFrame([("same", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("against", [-1.0, 0.0])], "path string, embedding array<float>")
    q = spark.createDataFrame([([2.0, 0.0],)], "embedding array<float>")
    got = {r.path: r.similarity for r in X.top_cosine(v, q, floor=-2.0).collect()}
    assert got == {"same": 1.0, "zero": 0.0, "against": -1.0}


def test_guard(spark):
    c = spark.createDataFrame([("doc", 0.9, "low", False), ("src", 0.75, "high", True), ("low", 0.2, "low", False)], "path string, score double, confidence string, anchor boolean")
    assert {r.path: r.score for r in X.guard(c).collect()} == {"doc": 0.74, "src": 0.75, "low": 0.2}
    assert {r.path: r.score for r in X.guard(c.where("not anchor")).collect()} == {"doc": 0.9, "low": 0.2}


def test_metrics(spark):
    ranked = spark.createDataFrame([("t", "C", 1, "x"), ("t", "C", 2, "hit"), ("t", "D", 1, "hit")], "task_id string, mode string, pos int, path string")
    judged = spark.createDataFrame([("t", "hit", "primary"), ("t", "more", "supporting"), ("t", "x", "irrelevant")], "task_id string, path string, label string")
    runs = spark.createDataFrame([("t", "r", "k", "q", m, ms, True) for m, ms in (("A", None), ("C", 10), ("D", 30))], "task_id string, repo_id string, task_type string, query string, mode string, latency_ms long, json_parse_ok boolean")
    got = {r["mode"]: r for r in V.per_task(ranked, judged, runs).collect()}
    assert got["A"].miss and got["A"].precision8 == 0 and got["A"].rr == 0 and got["A"].recall8 == 0
    assert (got["C"].hit1, got["C"].hit3, got["C"].rr, got["C"].precision8, got["C"].recall8, got["C"].unnecessary) == (0, 1, 0.5, 0.5, 0.5, 1)
    assert got["D"].hit1 == 1 and got["D"].ndcg8 == round(3 / (3 + 1 / 1.584962500721156), 6)
    scored = V.per_task(ranked, judged, runs)
    cmp = V.compare(scored, ranked, judged).first()
    assert (cmp.helpful, cmp.bad_promotion, cmp.regression, cmp.latency_delta) == (False, False, False, 20)
    assert V.no_hit(scored).count() == 0
    assert [r.task_id for r in V.demotions(ranked, "D", "C").collect()] == ["t"]


def test_gates_fail_on_missing_values(spark):
    m = spark.createDataFrame([("a", 0.7)], "name string, value double")
    rules = spark.createDataFrame([("a", ">=", 0.7), ("b", "==", 0.0)], "name string, op string, threshold double")
    assert {r.name: r.passed for r in V.gates(m, rules).collect()} == {"a": True, "b": False}


def test_violations(spark):
    tasks = spark.createDataFrame([("t1", None, "q"), ("t2", "r", "q"), ("t3", "r", "")], "task_id string, repo_id string, query string")
    labels = spark.createDataFrame([("t1", "r", "a", "primary"), ("t2", "s", "/a", "odd"), ("t9", "r", None, "primary")], "task_id string, repo_id string, path string, label string")
    got = {r.message for r in V.violations(tasks, labels).collect()}
    assert got == {
        "t1: missing repo_id", "t3: missing query", "label references unknown task_id: t9", "t2: label repo_id != task repo_id", "t2: invalid label 'odd' for /a",
        "t9: label entry missing path", "t2: path must be repo-relative forward-slash: /a", "t3: no labels",
    }
