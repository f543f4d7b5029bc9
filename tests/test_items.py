"""Facts of whole source files: symbols, imports, edges, and the line-based ones of Rust."""

import pytest
from pyspark.sql import functions as F

from lexigrove.jobs.queries import QUERIES
from lexigrove.operators import items as X
from lexigrove.operators import references as Y
from lexigrove.operators import statements as Z


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def symbols(spark, texts):
    return sorted((r.path, r.line_number, r.name, r.kind, r.visibility) for r in X.symbols(files(spark, texts)).collect())


def edges(spark, texts):
    table = files(spark, texts)
    return {(r.src, r.dst, r.confidence) for r in X.import_edges(X.resolved_imports(X.imports(table), table)).collect()}


RUST = """pub mod models;
use crate::schemas::Session;

/// pub in a comment before it
struct Private { x: u8 }
struct WithField {
    pub x: u8,
}
#[derive(
    Debug,
)]
#[cfg(any(a, b))] pub(in crate::a) enum Choice { A { x: u8 }, B }
pub fn start_session() { struct Inner; }
mod tests {
    fn inside() {}
}
/* fn commented() {
   /* fn nested() {} */ } */
const TEXT: &str = r#"fn quoted() { "#;
static BRACE: char = '{';
fn life<'a>(x: &'a str) -> &'a str { x }
unsafe impl<T> Send for Holder<T> {}
impl Iterator for Holder<u8> where u8: Copy { type Item = u8; }
impl Holder {}
trait Shape: Sized {}
extern "C" { fn foreign(); }
type Alias = u8;
"""


def test_rust_items(spark):
    got = [x[1:] for x in symbols(spark, {"src/a.rs": RUST})]
    assert got == [
        (5, "Private", "struct", "private"), (6, "WithField", "struct", "public"), (12, "Choice", "enum", "public"), (13, "start_session", "function", "public"), (19, "TEXT", "const", "private"),
        (20, "BRACE", "static", "private"), (21, "life", "function", "private"), (23, "Iterator for Holder", "impl", "private"), (24, "Holder", "impl", "private"), (25, "Shape", "trait", "private"),
    ]


def test_rust_modules_resolve_from_their_own(spark):
    texts = {"src/a.rs": "mod child;\nmod gone;\npub(crate) mod other;", "src/child.rs": "", "src/a/child.rs": "", "src/other/mod.rs": "", "src/a/other/mod.rs": "", "src/lib.rs": "mod child;", "src/b/mod.rs": "mod c;\nuse super::child;", "src/b/c.rs": "use self::d;"}
    assert edges(spark, texts) == {
        ("src/a.rs", "src/a/child.rs", "extracted"), ("src/a.rs", "src/a.rs", "extracted"), ("src/a.rs", "src/a/other/mod.rs", "extracted"), ("src/lib.rs", "src/child.rs", "extracted"),
        ("src/b/mod.rs", "src/b/c.rs", "extracted"), ("src/b/mod.rs", "src/child.rs", "inferred"), ("src/b/c.rs", "src/b/c.rs", "inferred"),
    }


@pytest.mark.parametrize(
    ("body", "paths"),
    [
        ("a::b", [["a", "b"]]), ("a::b as c", [["a", "b"]]), ("crate::{a, b::{c, d as e}}", [["crate", "a"], ["crate", "b", "{c, d"]]), ("{a, b}", [["a"], ["b"]]), ("a::{}", []), ("a::{b,}", [["a", "b"]]), ("crate::{x0::y1, y as z}", [["crate", "x0", "y1"], ["crate", "y"]]),
        ("a::{b, c", [["a", "{b, c"]]), ("  ", []), ("::a::b", [["a", "b"]]), ("a::{b::{c, d}, e}", [["a", "b", "{c, d}"], ["a", "e"]]),
    ],
)
def test_use_paths(spark, body, paths):
    assert spark.createDataFrame([(body,)], "b string").select(X.use_paths(F.col("b"))).first()[0] == paths


def test_grouped_uses_name_their_beginnings(spark):
    texts = {"src/m.rs": "use crate::{\n    a, // first\n    b::{c, d as e},\n};\npub use crate::a::{self};", "src/a.rs": "", "src/b.rs": "", "src/b/c.rs": ""}
    assert edges(spark, texts) == {("src/m.rs", "src/a.rs", "extracted"), ("src/m.rs", "src/b.rs", "extracted")}


def test_python_items(spark):
    text = "try:\n    import x\nexcept E:\n    class Fallback: pass\n@a(\n  1)\n@b\nasync def go(\n    x=')',\n):\n    def inner(): pass\n    class Inner: pass\nif a:\n\tif b:\n\t\tdef deep(): pass\nx = [\n'''\nclass No:\n''']\nclass _Last(\n  Base):\n    y = 1; z = 2\n"
    assert [x[1:] for x in symbols(spark, {"a.py": text})] == [(4, "Fallback", "struct", "public"), (8, "go", "function", "public"), (15, "deep", "function", "public"), (20, "_Last", "struct", "private")]


def test_python_imports(spark):
    texts = {
        "p/a.py": "from . import (\n  b,\n  c as d,\n  gone)\nimport p.b, q\nfrom p.b import X \\\n  , Y\nif 1: import r\ndef f():\n    import hidden\n",
        "p/b.py": "", "p/c/__init__.py": "", "q/__init__.py": "from . import z, q\nfrom .. import r", "q.py": "", "q/z.py": "", "r.py": "", "hidden.py": "",
    }
    assert edges(spark, texts) == {
        ("p/a.py", "p/b.py", "inferred"), ("p/a.py", "p/c/__init__.py", "inferred"), ("p/a.py", "p/b.py", "extracted"), ("p/a.py", "q/__init__.py", "extracted"), ("p/a.py", "r.py", "extracted"),
        ("q/__init__.py", "q/__init__.py", "extracted"), ("q/__init__.py", "r.py", "inferred"),
    }
    table = files(spark, texts)
    bound = {(r.from_file, r.symbol_name, r.target_file, r.line_number) for r in X.import_bindings(X.resolved_imports(X.imports(table), table)).collect()}
    assert bound == {("p/a.py", "p.b", "p/b.py", 6), ("p/a.py", "X", "p/b.py", 6), ("p/a.py", "Y", "p/b.py", 6), ("q/__init__.py", "z", "q/__init__.py", 1), ("q/__init__.py", "q", "q/__init__.py", 1)}


def test_script_items(spark):
    text = (
        "export default class A { m() { function no() {} } }\nfunction f() {\n  const g = () => {}\n}\nif (x) {\n  try { async function h() {} } catch (e) { class C {} }\n}\n"
        "export const one = (a, b = (1)) => a,\n  two = async x => x\nvar three = function () {}\nexport let _four = class {}\nexport const n = 5\ncall(function named() { const k = () => 1 })\n"
        "(function () { function iife() {} })()\nexport function* gen() {}\nconst typed: (x: number) => void = (x) => {}\n// function gone() {}\nconst s = '{'\nfunction last() {}\n"
    )
    assert [x[1:] for x in symbols(spark, {"a.ts": text})] == [
        (1, "A", "struct", "public"), (2, "f", "function", "private"), (6, "C", "struct", "private"), (6, "h", "function", "private"), (8, "one", "function", "public"), (10, "three", "function", "private"),
        (11, "_four", "struct", "private"), (15, "gen", "function", "public"), (16, "typed", "function", "private"), (19, "last", "function", "private"),
    ]


def test_script_imports(spark):
    texts = {
        "a.js": "import {\n  a as b,\n  default as c\n} from './x'\nimport d, * as e from './y'\nexport { f } from './z'\nimport './w'\nimport r from 'react'\nrequire('./v')\nconst u = require('./u')\nmodule.exports = require('./t')\n/* import q from './q' */\nfunction g() { require('./q') }\n",
        **{f"{c}.js": "" for c in "xyzwvutq"},
    }
    assert {d for _, d, _ in edges(spark, texts)} == {"x.js", "y.js", "z.js", "w.js", "v.js", "t.js"}
    table = files(spark, texts)
    bound = {(r.symbol_name, r.target_file, r.line_number, r.reason.split()[0]) for r in X.import_bindings(X.resolved_imports(X.imports(table), table)).collect()}
    assert bound == {("a", "x.js", 1, "direct"), ("d", "y.js", 5, "default"), ("f", "z.js", 6, "direct")}


def test_go_items(spark):
    text = 'package p\nimport (\n  "./x"\n)\nimport "./y"\ntype (\n  A struct {\n    B int\n  }\n  C = int\n)\ntype D[T any] struct {}\nconst (\n  E, F = 1, 2\n)\nvar g = func() { var no = 1 }\nfunc (a *A) H() {}\nfunc main() {\n  type no int\n}\nvar s = `type X struct {`\n'
    assert [x[1:4] for x in symbols(spark, {"p/a.go": text})] == [(7, "A", "struct"), (12, "D", "struct"), (14, "E", "const"), (14, "F", "const"), (16, "g", "static"), (17, "H", "function"), (18, "main", "function"), (21, "s", "static")]
    assert edges(spark, {"p/a.go": text, "p/x.go": "", "p/y.go": ""}) == {("p/a.go", "p/y.go", "extracted")}


def test_odd_files(spark):
    texts = {"a.rs": None, "b.rs": "", "c.py": "\n\n", "d.ts": "}}} function f() {}", "e.go": "func (", "f.txt": "fn x() {}", "g.rs": "fn a() {\r\n}\r\nfn b() { \"unclosed", "h.py": "def a(:\nclass B: pass"}
    assert symbols(spark, texts) == [("g.rs", 1, "a", "function", "private"), ("g.rs", 3, "b", "function", "private"), ("h.py", 1, "a", "function", "public")]
    assert X.imports(files(spark, texts)).count() == 0
    assert X.symbols(files(spark, texts).where("path = ''")).count() == 0


def test_long_files(spark):
    """Nested blocks, long strings and many lines: nothing recurses and the state is carried down."""
    body = "".join(f"fn f{i}() {{ if a {{ \"{{\"; }} }}\n" for i in range(20_000))
    string = 'const S: &str = "' + '\\"{' * 100_000 + '";\nfn after() {}\n'
    nested = "fn deep() " + "{" * 3_000 + "}" * 3_000 + "\nfn last() {}\n"
    table = files(spark, {"a.rs": body, "b.rs": string, "c.rs": nested, "d.py": "x = [\n" + "1,\n" * 20_000 + "]\nclass End: pass\n"})
    got = {r.path: (r.n, r.last) for r in X.symbols(table).groupBy("path").agg(F.count("*").alias("n"), F.max("line_number").alias("last")).collect()}
    assert got == {"a.rs": (20_000, 20_000), "b.rs": (2, 2), "c.rs": (2, 2), "d.py": (1, 20_003)}


def test_pieces_keep_the_text(spark):
    table = files(spark, {"a.rs": RUST, "b.ts": "const a = `x\n;{` // c\nf('}')"})
    back = {r.path: r.t for r in Z.pieces(table).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "").alias("t")).collect()}
    assert back == {"a.rs": RUST, "b.ts": "const a = `x\n;{` // c\nf('}')"}


def test_files_texts_are_cut_once_for_symbols_and_imports(spark):
    table = files(spark, {"pkg/a.py": "from .b import Foo, gone", "pkg/b.py": "class Foo: pass\nclass Foo: pass"})
    of = X.shared_units(table)
    refs = Y.binding_references(X.import_bindings(X.resolved_imports(X.imports(table, of), table)), X.unit_symbols(of).withColumnRenamed("path", "file_path"))
    assert [(r.symbol_name, r.target_file, r.target_line) for r in refs.collect()] == [("Foo", "pkg/b.py", 1)]
    plan = refs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([x for x in plan.split("\n") if "ReusedExchange" in x]) == 1
    assert sorted(tuple(r) for r in X.symbols(table, of).select("name", "line_number", "signature").collect()) == [("Foo", 1, "class Foo: pass"), ("Foo", 2, "class Foo: pass")]


@pytest.mark.parametrize("name", ["binding_refs", "all_refs", "extract_symbols", "import_edges"])
def test_tables_as_large_as_the_files_are_not_broadcast(spark, name):
    # estimated by its columns and not by its texts, a table of a million files looks small enough
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Broadcast" not in plan


def test_fallback(spark):
    texts = {
        "src/main.rs": "mod store;\nuse crate::store::{Item, other};\nuse crate::store::Item as I;\nfn main() { crate::web::serve(); store::open(); web::x(); nothing::y() } // crate::util::z\npub mod inline { }",
        "src/store.rs": "", "src/store/mod.rs": "", "src/web.rs": "use super::store;\nlet x = my_store::new();", "src/util.rs": "impl<T> X for Y<T> {}\nimpl fmt::Display for Wide<T> where T: A {\npub(super) default unsafe fn go() {}\nconst fn no() {}\npub static mut S: u8 = 1;\nmod m;",
    }
    table = files(spark, texts)
    assert {tuple(r) for r in X.fallback_edges(table).collect()} == {
        ("declares_module", "src/main.rs", "src/store.rs", "extracted", "declares module store"), ("imports", "src/main.rs", "src/store.rs", "extracted", "imports crate::store"),
        ("references", "src/main.rs", "src/web.rs", "extracted", "references crate::web"), ("references", "src/main.rs", "src/store.rs", "extracted", "references crate::store"),
        ("imports", "src/web.rs", "src/store.rs", "extracted", "imports crate::store"), ("declares_module", "src/util.rs", "src/util.rs", "extracted", "declares module m"),
    }
    got = {(r.path, r.line_number, r.name, r.kind, r.visibility) for r in X.fallback_symbols(table).collect()}
    assert got == {
        ("src/main.rs", 1, "store", "module", "private"), ("src/main.rs", 4, "main", "function", "private"), ("src/util.rs", 2, "fmt::Display for Wide", "impl", "private"), ("src/util.rs", 3, "go", "function", "public"),
        ("src/util.rs", 5, "S", "static", "public"), ("src/util.rs", 6, "m", "module", "private"),
    }


def test_the_fallback_stands_in_only_for_nothing(spark):
    closed = {"src/a.rs": "mod inner {\n    pub fn deep() {}\n    use crate::a;\n}"}
    for texts, names, kinds in ((closed, {"deep"}, {"imports"}), (closed | {"src/b.rs": "fn top() {}"}, {"top"}, set()), (closed | {"src/c.rs": "use crate::a;"}, set(), {"imports"}), ({"a.py": "def f(): pass"}, {"f"}, set())):
        table = files(spark, texts)
        s, e = X.rust_facts(table, X.symbols(table), X.import_edges(X.resolved_imports(X.imports(table), table)))
        assert {r.name for r in s.collect()} == names and {r.edge_type for r in e.collect()} == kinds


def test_facts_are_stored_before_the_choice(spark):
    """Neither joins of files are broadcast, nor does each use of the choice hold the plan of all facts."""
    plan = QUERIES["rust_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "BroadcastHashJoin" not in plan
    assert "collect_list" not in plan  # of statements


def test_all_edges_hold_statements_once(spark):
    plan = QUERIES["all_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.split("\n") if "Window [" in line]) <= 10  # those of the files' statements and of the pairs of tests
