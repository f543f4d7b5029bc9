from lexigrove.operators import extract as N


def code(spark, path, text):
    return spark.createDataFrame([(path, i, s) for i, s in enumerate(text.split("\n"), 1)], "path string, line_number int, line string")


def found(df):
    return {(r.name, r.kind, r.visibility) for r in N.symbols(df).collect()}


def test_rust(spark):
    df = code(spark, "src/a.rs", "pub struct Foo {\n    fn hidden() {}\nfn run() {\npub(crate) const X: u8 = 1;\nimpl Display for Foo {\nmod parts;\nuse crate::x::Y;\nuse std::fmt;\nlet z = Foo::new(run());")
    assert found(df) == {("Foo", "struct", "public"), ("run", "function", "private"), ("X", "const", "public"), ("Foo", "impl", "private"), ("parts", "module", "private")}
    refs = {(r.name, r.n) for r in N.identifier_refs(df, N.symbols(df)).collect()}
    assert refs == {("run", 1)}  # Foo has two definitions


def test_python_and_scripts(spark):
    py = code(spark, "a.py", "class A:\n    def method(self):\nasync def go():\ndef _p():\nfrom a.b import c\nimport os.path")
    assert found(py) == {("A", "struct", "public"), ("go", "function", "public"), ("_p", "function", "private")}
    ts = code(spark, "a.ts", "export function f() {\nclass C {\nexport const g = (x) => x\nconst n = 1\nimport x from './m'\nimport y from 'react'\nconst z = require('./q')")
    assert found(ts) == {("f", "function", "public"), ("C", "struct", "private"), ("g", "function", "public")}


def test_go_and_other_files(spark):
    go = code(spark, "a.go", 'func (r *T) M() {\ntype S struct {\ntype I interface {\ntype N int\nvar v = 1\nimport "x/y"')
    assert found(go) == {("M", "function", "public"), ("S", "struct", "public"), ("I", "trait", "public"), ("N", "type_alias", "public"), ("v", "static", "public")}
    assert N.symbols(code(spark, "a.txt", "fn x()")).count() == 0
