import pytest
from pyspark.sql import functions as F

from lexigrove.functions import roles
from lexigrove.functions import text as T
from lexigrove.operators import edges as E
from lexigrove.operators import extract as N
from lexigrove.operators import graph as G
from lexigrove.operators import imports as I
from lexigrove.operators import items as B
from lexigrove.operators import index as K
from lexigrove.operators import inputs as J
from lexigrove.operators import rank as R
from lexigrove.operators import references as Y
from lexigrove.operators import vector as X

SYMBOLS = "name string, kind string, file_path string, line_number int, visibility string"
REFS = "from_file string, symbol_name string, target_file string, target_line int, line_number int, confidence string, reason string, context string, additional_count int"
EDGES = "edge_type string, src string, dst string, confidence string, reason string"


def lines(spark, files):
    rows = [(p, i, s) for p, text in files.items() for i, s in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "path string, line_number int, line string")


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def column(spark, values, use, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(use(F.col("v"))).collect()]


def test_generated_site_pages_at_any_depth(spark):
    paths = ["site/index.html", "web/site/a/index.html", "website/index.html", "tests/a.rs", "src/latest_x.rs", "src/config.rs"]
    assert column(spark, paths, roles.index_role) == ["generated", "generated", "source", "source", "test", "config"]


def test_term_counts(spark):
    got = column(spark, [["b", "a", "b"], [], None, ["c"]], lambda v: F.array_join(F.transform(T.term_counts(v, 2), lambda x: F.concat(x["term"], x["tf"].cast("string"))), ","), "array<string>")
    assert got == ["b2,a1", "", "", "c1"]


def test_normal_paths(spark):
    assert column(spark, ["a/./b/../c.rs", "../x", "a\\b", "/r//s", "", "a/.."], T.normal_path) == ["a/c.rs", "x", "a/b", "r/s", "", ""]


FILES = {"src/def.rs": "pub struct SearchReport {", "tests/use_test.rs": "SearchReport::new()", "docs/notes.md": "the SearchReport page"}


def index_of(spark):
    symbols = spark.createDataFrame([("SearchReport", "struct", "src/def.rs", 1, "public")], SYMBOLS)
    refs = spark.createDataFrame([("tests/use_test.rs", "SearchReport", "src/def.rs", 1, 1, "inferred", "use", "test", 0)], REFS)
    edges = spark.createDataFrame([("likely_test_for", "tests/use_test.rs", "src/def.rs", "extracted", "stem"), ("same_area", "docs/notes.md", "src/def.rs", "inferred", "area")], EDGES)
    return symbols, refs, edges


def test_the_definition_comes_first(spark):
    got = R.find_indexed(lines(spark, FILES), table(spark, FILES), "SearchReport", "fresh", *index_of(spark)).collect()
    assert got[0].path == "src/def.rs" and (got[0].confidence, got[0].tier) == ("high", 5)
    none = R.find_indexed(lines(spark, FILES), table(spark, FILES), "SearchReport", "missing", *index_of(spark)).collect()
    assert {r.path: r.tier for r in none}["src/def.rs"] == 0


def test_evidence_of_an_index_comes_first(spark):
    got = {r.path: r for r in R.find_indexed_report(lines(spark, FILES), table(spark, FILES), "SearchReport", "fresh", *index_of(spark)).collect()}
    kinds = [x.split(":")[0] for x in got["src/def.rs"].evidence.split("\n")]
    assert kinds[0] == "indexed_symbol_definition" and kinds[-2:] == ["rg_match", "query_term_coverage"] and "exact_phrase_match" in kinds
    assert got["src/def.rs"].snippets == "1: pub struct SearchReport {" and got["src/def.rs"].next_action == "open src/def.rs"


def test_same_area_edges_stay_weak(spark):
    symbols, refs, edges = index_of(spark)
    found = {(r.path, x["type"]): x["score"] for r in R.signals.per_file(symbols, refs, edges, R.Query("SearchReport"), 1.0).collect() for x in r.signals}
    assert found["docs/notes.md", "indexed_edge"] == 0.005 and found["tests/use_test.rs", "indexed_edge"] == 0.01


def test_equals_of_the_best_anchor_are_not_capped(spark):
    rows = [("a", "source", 0.8, 0.9, True, False, False), ("b", "doc", 0.8, 0.9, False, False, False), ("c", "doc", 0.9, 0.9, False, False, False), ("d", "source", 0.95, 0.9, True, False, True)]
    df = spark.createDataFrame(rows, "path string, role string, score double, raw_score double, is_exact boolean, is_fixture boolean, has_symbol boolean")
    assert {r.path: r.score for r in R.anchor_cap(df).collect()} == {"a": 0.8, "b": 0.8, "c": 0.79, "d": 0.95}


RUST = """use crate::store::{Store as S, Other};
pub struct Store {
    let x: Store = Store::new(); // Store
    println!("Store");
#[cfg(test)]
mod tests {
    #[test]
    pub fn top() {
    fn checks() {
    call(Store);
    assert_eq!(Store::A, 1);
    fn make_store() {
    let s: Store = 1;
    fn plain() {
    use crate::Store;"""


def test_contexts_of_references(spark):
    code = lines(spark, {"src/a.rs": RUST.replace("    #[test]\n    pub fn top", "    #[test]\npub fn top")})
    symbols = N.symbols(code).withColumnRenamed("path", "file_path")
    at = {r.line_number: r.context for r in Y.line_contexts(code, symbols.withColumnRenamed("file_path", "path")).collect()}
    # line 8 defines a symbol, so the attribute before it waits for line 9
    assert 8 not in at and at[3] == "production" and at[10] == "test" and at[11] == "test" and at[13] == "fixture" and at[15] == "fixture"
    got = {(r.context, r.confidence): (r.line_number, r.additional_count) for r in Y.symbol_references(code, symbols).collect()}
    assert got == {("production", "extracted"): (1, 0), ("production", "inferred"): (3, 0), ("test", "inferred"): (11, 0), ("fixture", "inferred"): (13, 0), ("fixture", "extracted"): (15, 0)}


def test_ambiguous_names_make_no_reference(spark):
    symbols = spark.createDataFrame([("A", "struct", f, 1, "public") for f in ("x.rs", "y.rs")] + [("f", "function", "x.rs", 2, "public")], SYMBOLS)
    assert Y.unique_definitions(symbols).count() == 0


@pytest.mark.parametrize(
    ("path", "module", "first"),
    [
        ("pkg/a.py", ".b", ["pkg/b.py", "pkg/b/__init__.py"]), ("pkg/sub/a.py", "..", ["pkg/__init__.py"]), ("a.py", "m", ["m/__init__.py", "m.py"]), ("a.py", "m.n", ["m/n.py", "m/n/__init__.py"]),
        ("src/a.ts", "./b", ["src/b.ts", "src/b.tsx"]), ("src/a.js", "../b", ["b.js", "b.jsx"]), ("src/a.ts", "./b.js", ["src/b.js"]), ("p/a.go", "x/y", ["x/y.go", "x/y/index.go", "x/y/y.go", "y.go"]),
    ],
)
def test_import_options(spark, path, module, first):
    got = spark.createDataFrame([(path, module)], "path string, module string").select(I.options(F.col("path"), F.col("module"))).first()[0]
    assert got[: len(first)] == first


def test_bindings_keep_the_original_name(spark):
    files = table(spark, {"pkg/a.py": "from .b import Foo as Bar, baz\nfrom .gone import x", "src/u.ts": "import Main, { One as Two } from './v'", "pkg/b.py": "", "src/v.ts": ""})
    found = B.import_bindings(B.resolved_imports(B.imports(files), files))
    assert {(r.from_file, r.symbol_name, r.target_file) for r in found.collect()} == {("pkg/a.py", "Foo", "pkg/b.py"), ("pkg/a.py", "baz", "pkg/b.py"), ("src/u.ts", "Main", "src/v.ts"), ("src/u.ts", "One", "src/v.ts")}
    symbols = spark.createDataFrame([("Foo", "struct", "pkg/b.py", 9, "public"), ("Foo", "struct", "pkg/b.py", 4, "public")], SYMBOLS)
    assert [(r.symbol_name, r.target_line) for r in Y.binding_references(found, symbols).collect()] == [("Foo", 4)]


def test_manifests(spark):
    text = '{"background": {"service_worker": "bg.js"}, "content_scripts": [{"js": ["lib/c.js"], "css": ["/top.css"]}]}'
    files = table(spark, {"ext/manifest.json": text, "bad/manifest.json": "{", "ext/bg.ts": "", "ext/lib/c.js": "", "top.css": ""})
    assert {(r.dst, r.reason.split(" ")[1]) for r in I.manifest_edges(files).collect()} == {("ext/bg.ts", "background.service_worker"), ("ext/lib/c.js", "content_scripts.js"), ("top.css", "content_scripts.css")}


def test_options_of_manifests_are_few(spark):
    rows = spark.createDataFrame([("ext/manifest.json", "a.min.js"), ("manifest.json", "a"), ("ext/manifest.json", "./b/.."), ("ext/manifest.json", "a\\b.js")], "path string, raw string")
    dotted, plain, up, back = [r[0] for r in rows.select(I.manifest_options(F.col("path"), F.col("raw"))).collect()]
    assert max(map(len, (dotted, plain, up, back))) < 100
    assert dotted[:3] == ["ext/a.min.js", "ext/a.min.ts", "ext/a.min.tsx"] and {"a.min.html", "ext/a.min/index.cjs"} < set(dotted) and "a.js" not in dotted
    assert plain[:2] == ["a", "a.ts"] and {"a/index/index.js", "a/index.css"} < set(plain) and "ext" in up and back[0] == "ext/a/b.js"
    names = ["a.css", "a/index/index.cjs", "a/index.ts", "ext/a.jsx", "ext/a/index.mjs"]
    texts = {"ext/manifest.json": '{"background": {"service_worker": "./a.js", "scripts": ["/a", "a", "../a.txt"]}}'}
    for gone in range(len(names)):
        files = table(spark, texts | dict.fromkeys(names[gone:], ""))
        first = {r.dst for r in I.manifest_edges(files).collect()}
        assert first == [{"a.css", "a/index.ts", "ext/a.jsx"}, {"a/index.ts", "ext/a.jsx"}, {"a/index.ts", "ext/a.jsx"}, {"ext/a.jsx"}, {"ext/a/index.mjs"}][gone], gone


def test_common_tokens_make_few_pairs(spark):
    files = table(spark, {f"src/util_{i:03}.rs": "" for i in range(50)} | {"a/tests/util_test.rs": "", "src/test_zzz.rs": ""})
    assert sorted(r.dst for r in E.test_edges(files).collect()) == ["src/util_000.rs", "src/util_001.rs", "src/util_002.rs"]


def test_risk_without_users(spark):
    areas = spark.createDataFrame([("lonely", 0), ("near", 1)], "symbol_name string, same_area int")
    got = {r.symbol_name: (r.level, r.reasons) for r in G.risk(spark.createDataFrame([], REFS), "fresh", areas).collect()}
    assert got == {"lonely": ("low", "no direct symbol users were found"), "near": ("low", "only same_area evidence was found")}


def test_file_risk(spark):
    refs = spark.createDataFrame([(f"p{i}.rs", "S", "f.rs", 1, 1, "extracted", "use", "production", 1) for i in range(2)] + [("t.rs", "S", "f.rs", 1, 1, "extracted", "use", "test", 0)], REFS)
    edges = spark.createDataFrame([("imports", "p1.rs", "f.rs", "extracted", "r"), ("imports", "q.rs", "f.rs", "extracted", "r"), ("same_area", "g.rs", "h.rs", "inferred", "r")], EDGES)
    got = {r.path: (r.level, r.reasons) for r in G.file_risk(G.file_evidence(edges, refs)).collect()}
    assert got["f.rs"] == ("high", "3 production files have direct inbound impact (4 production symbol references across 2 files; 2 production file/module users across 2 files); 1 test/fixture references across 1 file")
    assert got["g.rs"] == got["h.rs"] == ("low", "only same_area evidence was found")


def test_guards_take_both_heights_first(spark):
    df = spark.createDataFrame([("doc", 0.9, False, False), ("phrase", 0.75, True, False), ("symbol", 0.7, False, True)], "path string, score double, anchor boolean, symbol_anchor boolean")
    assert {r.path: r.score for r in X.guard(df).collect()} == {"doc": 0.69, "phrase": 0.69, "symbol": 0.7}
    assert X.is_identifier("run_rg") and X.is_identifier("SearchResult") and not X.is_identifier("where is X") and not X.is_identifier("Foo")


def test_stored_index(spark, tmp_path):
    index = K.Index(spark, str(tmp_path / "index"))
    assert index.status("r1") == "missing"
    files = table(spark, {"a.rs": "alpha beta alpha", "b.bin": "x" * 300_000, "c.md": None})
    rows = K.indexed_files(files)
    index.write("r1", files=rows, postings=R.lexical.postings(files.where("text is not null")))
    assert [index.status(r) for r in ("r1", "r2", None)] == ["fresh", "stale", "unverifiable"]
    assert {r.path: (r.content_hash is None, r.doc_length) for r in index.read("files").collect()} == {"a.rs": (False, 3), "b.bin": (True, None), "c.md": (True, None)}
    assert index.read("postings").where("term = 'alpha'").first().tf == 2
    assert index.clear() and index.status("r1") == "missing"


def test_files_from_a_folder(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.rs").write_bytes(b"fn a() {}" + b" " * 300_000)
    (root / "big.txt").write_bytes(b"x" * 300_000)
    (root / "bad.rs").write_bytes(b"\xff\xfe")
    df = K.read_files(spark, str(root)).select("path", K.text_of(F.col("content"), F.col("path")).alias("text"))
    assert {r.path: r.text is not None for r in df.collect()} == {"src/a.rs": True, "big.txt": False, "bad.rs": False}


def test_evaluation_inputs(spark):
    raw = spark.createDataFrame([('﻿{"task_id": "t1", "repo_id": "a"}',), ("  ",), ('{"task_id": "t2"}',), ("{broken",)], "value string")
    rows = J.json_rows(raw, "task_id string, repo_id string", strict=False)
    assert sorted(r.task_id for r in rows.collect()) == ["t1", "t2"] and [r.task_id for r in J.required(rows, ["repo_id"]).collect()] == ["t1"]
    with pytest.raises(Exception, match="invalid JSON"):
        J.json_rows(raw, "task_id string, repo_id string").collect()
    assert column(spark, ['"./a\\\\b"', '["x", null, "./y"]', None, "null"], J.path_list) == [["a/b"], ["x", "y"], [], []]


def test_summary_files(spark, tmp_path):
    J.write_summary(spark.createDataFrame([("A", 0.5)], "mode string, hit1 double"), str(tmp_path))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().mode == "A" and spark.read.json(str(tmp_path / "json")).first().hit1 == 0.5
