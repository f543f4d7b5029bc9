"""The retrieval model's tables, made from the given ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.roles import index_role
from ..functions.text import lexical_terms
from .vector_file import encoded

PREFIXES = ["src", "docs", "config", "tests", "lib", "app", "vendor", "packages"]
FOLDERS = ["core", "test_util", "generated", "docs", "ui"]
ENDINGS = [".rs", ".py", ".md", ".toml", ".lock", ".ts", ".js", ".go", ".json", ".html", ".txt"]
KINDS = ["struct", "function", "enum", "trait", "type_alias", "const", "static", "module"]
TASK_TYPES = ["exact-error-lookup", "feature-localization", "symbol-tracing", "impact-check", "refactor-prep"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


def doc_path(doc_id: Column, source: Column) -> Column:
    return F.concat(pick(PREFIXES, doc_id), F.lit("/"), source, F.lit("/"), pick(FOLDERS, doc_id), F.lit("/doc_"), doc_id.cast("string"), pick(ENDINGS, doc_id))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, doc_id): documents as files."""
    return read(spark, sf_dir, "documents").select(doc_path(F.col("doc_id"), F.col("source")).alias("path"), "text", "doc_id")


def lines(of: DataFrame) -> DataFrame:
    """(path, line_number, line) of files, lines from 1."""
    return of.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_number"), "line")


#: Ids that one window looks at when the next row of a source is sought.
ID_RANGE = 4096


def next_of_source(docs: DataFrame) -> DataFrame:
    """(doc_id, source, next_id): the next id of the same source, however far it is.

    A source may hold a third of all rows, so it is cut into ranges of ids: the
    next id is in the same range or the first of a later one.
    """
    ranged = docs.select("doc_id", "source", F.floor(F.col("doc_id") / ID_RANGE).alias("part"))
    firsts = ranged.groupBy("source", "part").agg(F.min("doc_id").alias("first_id"))
    later = firsts.select("source", "part", F.lead("first_id").over(Window.partitionBy("source").orderBy("part")).alias("later_id"))
    here = F.lead("doc_id").over(Window.partitionBy("source", "part").orderBy("doc_id"))
    return ranged.withColumn("here", here).join(later, ["source", "part"]).select("doc_id", "source", F.coalesce("here", "later_id").alias("next_id"))


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_type, src, dst, confidence, reason): foreign keys as typed edges, distinct."""
    t = lambda n: read(spark, sf_dir, n)

    def edge(df: DataFrame, kind: str, src: Column, dst: Column, key: str) -> DataFrame:
        level = pick(["extracted", "inferred", "ambiguous"], F.col(key))
        return df.select(F.lit(kind).alias("edge_type"), src.alias("src"), dst.alias("dst"), level.alias("confidence"), F.lit(f"{kind} key").alias("reason"))

    nation = t("nation")
    a, b = nation.select(F.col("n_nationkey").alias("a"), "n_regionkey"), nation.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    out = edge(nation, "imports", _node("nation", "n_nationkey"), _node("region", "n_regionkey"), "n_nationkey")
    for part in (
        edge(t("customer"), "references", _node("customer", "c_custkey"), _node("nation", "c_nationkey"), "c_custkey"),
        edge(t("supplier"), "declares_module", _node("supplier", "s_suppkey"), _node("nation", "s_nationkey"), "s_suppkey"),
        edge(t("orders"), "configures", _node("orders", "o_orderkey"), _node("customer", "o_custkey"), "o_orderkey"),
        edge(t("lineitem"), "likely_test_for", _node("part", "l_partkey"), _node("supplier", "l_suppkey"), "l_partkey"),
        edge(a.join(b, "n_regionkey").where("a < b"), "same_area", _node("nation", "a"), _node("nation", "b"), "a"),
    ):
        out = out.unionByName(part)
    return out.distinct()


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kind, file_path, line_number, visibility, signature) from parts."""
    return read(spark, sf_dir, "part").select(
        F.regexp_replace("p_name", " ", "_").alias("name"),
        pick(KINDS, F.col("p_size")).alias("kind"),
        F.col("p_brand").alias("file_path"),
        F.col("p_partkey").cast("int").alias("line_number"),
        F.when(F.col("p_size") % 2 == 0, "public").otherwise("private").alias("visibility"),
        F.col("p_type").alias("signature"),
    )


def symbol_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_file, symbol_name, target_file, target_line, line_number, confidence, reason, context, additional_count) from line items."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    items = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        _node("supplier", "l_suppkey").alias("from_file"),
        F.regexp_replace("p_name", " ", "_").alias("symbol_name"),
        F.col("p_brand").alias("target_file"),
        F.col("p_partkey").cast("int").alias("target_line"),
        F.col("l_linenumber").cast("int").alias("line_number"),
        F.when(F.col("l_linestatus") == "O", "extracted").otherwise("inferred").alias("confidence"),
        F.lit("line item").alias("reason"),
        F.when(F.col("l_returnflag") == "A", "production").when(F.col("l_returnflag") == "R", "fixture").otherwise("test").alias("context"),
        (F.col("l_linenumber") % 3).cast("int").alias("additional_count"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, repo_id, task_type, query, item_id): benchmark passages as retrieval tasks."""
    item = F.col("item_id")
    return read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("task_"), item.cast("string")).alias("task_id"), F.concat(F.lit("repo"), (item % 3).cast("string")).alias("repo_id"), pick(TASK_TYPES, item).alias("task_type"), F.col("text").alias("query"), "item_id"
    )


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, item_id, path, doc_id, shared, weight): files that share long terms with a task, and the sum of their rarity.

    Lists, labels and metrics are all derived from it: the condition on both sums keeps the plan of each use
    the same, so that Spark makes one shuffle for all of them.
    """
    long = lambda c: F.array_distinct(F.filter(lexical_terms(c), lambda t: F.octet_length(t) >= 8))
    docs = files(spark, sf_dir).select("path", "doc_id", F.explode(long(F.col("text"))).alias("term"))
    wanted = tasks(spark, sf_dir).select("task_id", "item_id", F.explode(long(F.col("query"))).alias("term"))
    # only terms of tasks are shuffled, once: the counts look at all columns, so that both uses have the same plan below
    held = docs.join(wanted.select("term").distinct(), "term", "left_semi").repartition("term")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("path").alias("_p"), F.max("doc_id").alias("_d")).where("_p is not null and _d is not null").select("term", "df")
    hits = held.join(wanted, "term").join(df, "term")
    return hits.groupBy("task_id", "item_id", "path", "doc_id").agg(F.count(F.lit(1)).alias("shared"), F.round(F.sum(F.lit(1.0) / F.col("df")), 6).alias("weight")).where("shared > 0 and weight > 0")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, mode, pos, path): the whole lists of four modes, from plain counts to rarity with a quality bonus."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    found = overlap(spark, sf_dir).join(labels, "doc_id", "left").withColumn("role", index_role(F.col("path")))
    values = {
        "A": F.col("shared").cast("double"),
        "B": F.col("shared") + F.when(F.col("role") == "source", 1.0).otherwise(0.0),
        "C": F.col("weight"),
        "D": F.col("weight") + F.coalesce("quality", F.lit(0)) * F.lit(0.01),
    }
    score = F.array(*[F.struct(F.lit(m).alias("mode"), v.alias("s")) for m, v in values.items()])
    each = found.select("task_id", "path", F.explode(score).alias("x")).select("task_id", "path", "x.mode", F.round("x.s", 6).alias("s"))
    order = Window.partitionBy("task_id", "mode").orderBy(F.desc("s"), "path")
    return each.withColumn("pos", F.row_number().over(order)).select("task_id", "mode", "pos", "path")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, path, label): graded files of each task."""
    labels = read(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "irrelevant").when(F.col("quality") == 1, pick(["primary", "acceptable", "supporting"], F.col("doc_id"))).otherwise("supporting")
    return overlap(spark, sf_dir).join(labels, "doc_id").select("task_id", "path", label.alias("label"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, repo_id, task_type, query, mode, latency_ms, json_parse_ok): one run a task and mode, timed by events."""
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(i).alias("i")) for i, m in enumerate("ABCD")])).alias("m")
    each = tasks(spark, sf_dir).select("*", modes).withColumn("event_id", F.col("item_id") * 4 + F.col("m.i"))
    events = read(spark, sf_dir, "events").select("event_id", "value", "event_type")
    return each.join(events, "event_id", "left").select(
        "task_id", "repo_id", "task_type", "query", F.col("m.mode").alias("mode"), F.floor(F.col("value") * 100).cast("long").alias("latency_ms"), F.coalesce(F.col("event_type") != "error", F.lit(False)).alias("json_parse_ok")
    )


#: Lines of source code, by language, that parts are written as; {n} is the part's name and key.
CODE = [
    (".rs", ["pub fn {n}() {{", "struct {n} {{", "pub enum {n} {{", "    fn {n}() {{}}", "use crate::{n};", "impl Display for {n} {{"]),
    (".py", ["class {n}:", "async def {n}():", "def _{n}():", "    def {n}(self):", "from pkg.{n} import x", "import {n}"]),
    (".ts", ["export function {n}() {{", "class {n} {{", "export const {n} = (a) => a", "const {n} = 1", "import x from './{n}'", "require('./{n}')"]),
    (".go", ["func (r *T) {n}() {{", "type {n} struct {{", "type {n} interface {{", "type {n} int", "var {n} = 1", 'import "pkg/{n}"']),
]


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_number, line): parts as lines of source code, a file for each brand and language."""
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), (F.col("p_partkey") % 50).cast("string"))
    line, end = F.lit(""), F.lit("")
    for i, (ending, shapes) in enumerate(CODE):
        for j, shape in enumerate(shapes):
            before, after = shape.format(n="\0").split("\0")
            mine = (F.col("p_partkey") % 4 == i) & (F.col("p_size") % 6 == j)
            line = F.when(mine, F.concat(F.lit(before), name, F.lit(after))).otherwise(line)
        end = F.when(F.col("p_partkey") % 4 == i, F.lit(ending)).otherwise(end)
    path = F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", ""), end)
    return read(spark, sf_dir, "part").select(path.alias("path"), F.col("p_partkey").cast("int").alias("line_number"), line.alias("line"))


def _path_of(key: Column) -> Column:
    """The source file of a part: folders and languages take turns."""
    root = F.when(key % 4 == 3, "src/").otherwise("")
    return F.concat(root, F.lit("pkg"), (F.floor(key / 4) % 5).cast("string"), F.lit("/m_"), key.cast("string"), pick([".py", ".ts", ".go", ".rs"], key))


#: A source file of each language, by line: what stands in strings, comments, bodies and groups, and statements over several lines.
SOURCE_LINES = [
    [
        '\"\"\"Doc string with', "class NotOne: inside text", '\"\"\"', "import os, pkg{d}.m_{b} as pb  # import nothing.real", "from . import (", "    m_{a},", "    gone as g,", ")", "from .m_{a} import Sym_{a} as s, nothing",
        "try:", "    from ..pkg{d}.m_{b} import Sym_{b}", "except ImportError:", "    Sym_{b} = None", "@decorate(", '    \"x = 1\")', "class Sym_{k}:", "    def method(self):", "        import pkg{d}.m_{a}", "if True:",
        "    async def run_{k}():", "        def inner():", "            pass", "    def _late_{k}(a,", '                  b): return \"\"\"', "def fake():", '\"\"\"', "def after_{k}(): pass",
    ],
    [
        "// import Fake from './m_{a}'", "import Def_{a}, {{", "  Sym_{a} as t,", "  other,", "}} from './m_{a}'", 'import type Only from \"../pkg{d}/m_{b}.ts\";', "export * from '../pkg{d}/m_{b}'", "export {{", "  Sym_{b} as again", '}} from \"../pkg{d}/m_{b}\"',
        "const late = require('./m_{k}')", "if (late) {{", "  require('./m_{a}')", '  function nested_{k}() {{ return \"}}\" }}', "}}", "/* class Gone {{", "}} */", "export class Sym_{k} {{", "  method() {{ require('./m_{k}') }}", "}}",
        "export default async function run_{k}() {{ const a = () => 1 }}", "export const make_{k} = async (x) => {{", "  class Inner {{}}", "}}, second_{k} = function () {{}}", "let _cls_{k} = class {{}}, plain_{k} = 1", "function* gen_{k}() {{}}",
        "interface I_{k} {{ a: string }}", "const text = `class T {{`", "export function _hid_{k}() {{}}",
    ],
    [
        "package m", 'import \"pkg{d}/m_{b}\"', "import (", '\t\"./m_{k}\"', ")", 'import alias \"./m_{a}\"', "// func Fake_{k}() {{", "type (", "\tSym_{k} struct {{ A int }}", "\tAct_{k} interface {{", "\t\tDo()", "\t}}", ")", "type Num_{k} int", "const (",
        "\tOne_{k}, Two_{k} = 1, 2", '\tThree_{k} = \"const X = {{\"', ")", "var V_{k}, W_{k} int = 1, 2", "func (r *Sym_{k}) Start_{k}() {{", "\tvar local = 1", "}}", "func Run_{k}(", "\ta int,", ") string {{", "\treturn `func Raw() {{`", "}}",
    ],
    [
        "//! mod fake_{k};", "use crate::{{pkg{d}::m_{b}::{{Sym_{b}, self as me}}, pkg{d}::m_{b} as again}};", "pub(crate) use super::m_{a};", "use std::{{", "    fmt,", "    io::Write,", "}};", "pub mod child_{k};", "#[derive(Debug)]", "struct Sym_{k} {{",
        "    pub field: u8, /* {{ /* nested */ */", "}}", "pub(super) enum E_{k} {{ A }}", "impl<T: Into<String>> From<T> for Sym_{k} where T: Copy {{", "    fn from(x: T) -> Self {{ let c = '{{'; todo!() }}", "}}", "impl Display for Sym_{k} {{", "    fn inner_{k}() {{}}", "}}",
        'const LIST_{k}: [u8; 2] = [1, 2]; static mut S_{k}: &str = \"fn quoted() {{\";', "pub const fn cf_{k}() {{}}", "async unsafe fn run_{k}<'a>(", "    x: &'a str,", ") -> u8 {{", "    mod hidden {{ pub fn no() {{}} }}", "    crate::pkg{d}::m_{b}::call(m_{a}::make())", "}}",
        "mod tests {{", "    use super::*;", "    fn check() {{}}", "}}", "type Alias_{k} = u8;", "trait T_{k} {{ fn f(&self); }}",
    ],
]


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): parts as whole source files that import each other, some packages of Python and some modules below modules of Rust."""
    k = F.col("p_partkey")
    value = {"a": k + 20, "b": k + 4, "d": (F.floor(k / 4) + 1) % 5, "k": k}
    text = F.lit("")
    for i, lines in enumerate(SOURCE_LINES):
        bits = re.split(r"\{([abdk])\}", "\n".join(lines))
        text = F.when(k % 4 == i, F.concat(*[value[b].cast("string") if j % 2 else F.lit(b.replace("{{", "{").replace("}}", "}")) for j, b in enumerate(bits)])).otherwise(text)
    part = read(spark, sf_dir, "part")
    folder = F.concat(F.lit("pkg"), (F.floor(k / 4) % 5).cast("string"))
    package = part.where((k % 4 == 0) & folder.isin("pkg0", "pkg1")).select(F.concat(folder, F.lit("/__init__.py")).alias("path"), F.lit("").alias("text")).distinct()
    module = F.concat(F.lit("src/"), folder, F.lit("/m_"), k.cast("string"), F.lit("/child_"), k.cast("string"), F.lit(".rs"))
    child = part.where(k % 8 == 3).select(module.alias("path"), F.lit("pub fn of_child() {}").alias("text"))
    at_root = part.where(k % 8 == 7).select(
        F.concat(F.lit("src/root_"), k.cast("string"), F.lit(".rs")).alias("path"),
        F.concat(F.lit("use self::root_"), k.cast("string"), F.lit("::X; // own\nuse crate::root_"), k.cast("string"), F.lit(";\nfn go() { root_"), k.cast("string"), F.lit("::go(); root_"), (k - 8).cast("string"), F.lit("::go() }")).alias("text"),
    )
    return part.select(_path_of(k).alias("path"), text.alias("text")).unionByName(package).unionByName(child).unionByName(at_root)


#: Files of the trees, and ignore files with the rules that they hold.
TREE_PATHS = ["src/a_{k}.rs", "build/out_{k}.o", "logs/keep_{k}.log", "logs/x_{k}.tmp", "deep/build/in_{k}.rs", "docs/{k}.md"]
IGNORE_FILES = {
    ".gitignore": "*.tmp\n/r0/docs/  \n\n# comment\nbuild/", "r1/.gitignore": "!build/\n*.md\n!1?.md", "r2/.rgignore": "logs/*\n!logs/keep_*", "r3/.ignore": "!*.tmp\nsrc/**", "r4/.gitignore": "deep/**/in_*\n\\!x\nsrc/a_[!0-9]*",
}


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): parts as files of five trees, with ignore files."""
    k = F.col("p_partkey")
    name = F.lit("")
    for i, shape in enumerate(TREE_PATHS):
        before, after = shape.split("{k}")
        name = F.when(F.col("p_size") % len(TREE_PATHS) == i, F.concat(F.lit(before), k.cast("string"), F.lit(after))).otherwise(name)
    rules = spark.createDataFrame(list(IGNORE_FILES.items()), "path string, text string")
    return read(spark, sf_dir, "part").select(F.concat(F.lit("r"), (k % 5).cast("string"), F.lit("/"), name).alias("path"), F.lit("").alias("text")).unionByName(rules)


def closed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): parts as Rust files with everything inside a module's body, where statements give neither a symbol nor an edge."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("mod inner {\n    pub(crate) fn deep_"), k, F.lit("() {}\n    use crate::f_"), k, F.lit(";\n    type T_"), k, F.lit(" = u8; // type No = u8\n}\n"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("src/f_"), k, F.lit(".rs")).alias("path"), text.alias("text"))


#: Lines of Rust test sections and of what stands around them; {n} is a part's name, {k} its key.
TEST_LINES = [
    "use crate::store::{{{n}, Other as O}};", "    let x: {n} = {n}::new();", "#[cfg(test)]", "#[test]", "    fn checks_{k}() {{", "    assert_eq!({n}::A, {n}::B); // {n}", "    fn make_{k}() {{", "    call({n});",
    "pub struct {n} {{", "    println!(\"{n}\");", "    fn plain_{k}() {{", "fn top_{k}() {{", "    self.repo({n}, x::y);",
]


#: The line among them that every tenth part gets.
DEFINING_LINE = 8


def rust_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_number, line): parts as lines of Rust, some hundred lines a file, with test sections in some."""
    k = F.col("p_partkey")
    size = F.col("p_size")
    name = F.concat(F.lit("Part"), (k - k % 10 + F.when(k % 10 == 0, 0).otherwise(10 * (size % 4))).cast("string"))
    line = F.lit("")
    for i, shape in enumerate(TEST_LINES):
        bits = re.split(r"\{([nk])\}", shape)
        text = F.concat(*[({"n": name, "k": k.cast("string")}[b]) if j % 2 else F.lit(b.replace("{{", "{").replace("}}", "}")) for j, b in enumerate(bits)])
        line = F.when(F.when(k % 10 == 0, DEFINING_LINE).otherwise((k * 7 + size) % len(TEST_LINES)) == i, text).otherwise(line)
    path = F.concat(F.lit("src/f"), F.floor(k / 100).cast("string"), F.when(F.floor(k / 100) % 5 == 4, "_test.rs").otherwise(".rs"))
    return read(spark, sf_dir, "part").select(path.alias("path"), (k % 100 + 1).cast("int").alias("line_number"), line.alias("line"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): parts as browser manifests, and the scripts that some of them name."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    json = F.concat(F.lit('{"background": {"service_worker": "./bg_'), k, F.lit('.js", "scripts": ["lib/s_'), k, F.lit('"]}, "content_scripts": [{"js": ["/c_'), k, F.lit('.js", "missing.js"], "css": ["c_'), k, F.lit('.css"]}, {"matches": []}]}'))
    text = F.when(s % 10 == 0, "not json {").otherwise(json)
    folder = F.concat(F.lit("ext"), (s % 4).cast("string"), F.lit("/"))
    named = F.array(F.concat(folder, F.lit("bg_"), k, F.when(s % 3 == 0, ".ts").otherwise(".js")), F.concat(folder, F.lit("lib/s_"), k, F.when(s % 2 == 0, ".mjs").otherwise("/index.ts")), F.concat(F.lit("c_"), k, F.lit(".jsx")), F.concat(folder, F.lit("c_"), k, F.lit(".css")))
    part = read(spark, sf_dir, "part")
    main = part.select(F.concat(folder, F.lit("p"), k, F.lit("/../manifest.json")).alias("x"), F.concat(folder, k, F.lit("_manifest.json")).alias("path"), text.alias("text")).drop("x")
    return main.unionByName(part.select(F.explode(named).alias("path"), F.lit("").alias("text")))


SYMBOL_NAMES = ["apache_license", "ApacheLicense", "license_text", "apache", "Other", "license_apache_note", "LICENSE", "plain"]
EDGE_KINDS = ["imports", "references", "declares_module", "same_area", "likely_test_for", "configures"]
CONTEXTS, LEVELS = ["production", "fixture", "test", "unknown"], ["extracted", "inferred", "ambiguous"]


def doc_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kind, file_path, line_number, visibility): a symbol in every document's file."""
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        pick(SYMBOL_NAMES, F.floor(i / 3)).alias("name"), pick(KINDS, i).alias("kind"), doc_path(i, F.col("source")).alias("file_path"), (i % 50 + 1).cast("int").alias("line_number"), F.when(i % 2 == 0, "public").otherwise("private").alias("visibility")
    )


def doc_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between documents' files: each uses a symbol of the next of its source."""
    i = F.col("doc_id")
    return next_of_source(read(spark, sf_dir, "documents")).where("next_id is not null").select(
        doc_path(i, F.col("source")).alias("from_file"), pick(SYMBOL_NAMES, i).alias("symbol_name"), doc_path(F.col("next_id"), F.col("source")).alias("target_file"), (i % 30).cast("int").alias("line_number"),
        pick(LEVELS, i).alias("confidence"), F.lit("use").alias("reason"), pick(CONTEXTS, F.floor(i / 2)).alias("context"), (i % 3).cast("int").alias("additional_count"),
    )


def doc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_type, src, dst, confidence, reason): edges from each document's file to the next of its source."""
    i = F.col("doc_id")
    return next_of_source(read(spark, sf_dir, "documents")).where("next_id is not null").select(
        pick(EDGE_KINDS, i).alias("edge_type"), doc_path(i, F.col("source")).alias("src"), doc_path(F.col("next_id"), F.col("source")).alias("dst"), pick(LEVELS, i).alias("confidence"), F.lit("next").alias("reason")
    )


def found_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, text): outputs of searches as JSON, one a task; some are cut off or empty."""
    item = F.col("item_id")
    paths = F.array_join(F.transform(F.sequence(F.lit(1), item % 4), lambda k: F.concat(F.lit('{"path": "./src\\\\f'), (item + k).cast("string"), F.lit('.rs"}'))), ", ")
    whole = F.concat(F.lit('{"candidates": ['), F.when(item % 4 == 0, "").otherwise(paths), F.lit('], "coverage": {"semantic_status": "'), pick(["ready", "off"], item), F.lit('"}}'))
    text = F.when(item % 11 == 0, "").when(item % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)
    return read(spark, sf_dir, "benchmark").select(F.concat(F.lit("task_"), item.cast("string")).alias("run"), text.alias("text"))


def task_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): task rows as lines of JSON; some lack a field, are blank or begin with a byte-order mark."""
    item = F.col("item_id")
    repo = F.when(item % 6 == 0, "").otherwise(F.concat(F.lit('"repo_id": "repo'), (item % 3).cast("string"), F.lit('", ')))
    line = F.concat(F.lit('{"task_id": "task_'), item.cast("string"), F.lit('", '), repo, F.lit('"query": "q'), item.cast("string"), F.lit('"}'))
    return read(spark, sf_dir, "benchmark").select(F.when(item % 9 == 8, "  ").when(item % 9 == 7, F.concat(F.lit("﻿"), line)).otherwise(line).alias("value"))


#: Vectors of a file, and the model that their descriptions name.
FILE_VECTORS, MODEL_NAME, DIMENSIONS = 40, "small-model", 64


def vector_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as vector files (path, content), and their descriptions; some are cut off, or described wrongly."""
    each = read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding", F.floor(F.col("vec_id") / FILE_VECTORS).alias("f"))
    of = each.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    path, f = F.concat(F.lit("vectors_"), F.col("f").cast("string"), F.lit(".bin")), F.col("f")
    whole = encoded(F.col("v.embedding"), DIMENSIONS)
    content = F.when(f % 11 == 3, whole.substr(F.lit(1), F.octet_length(whole) - 2)).when(f % 11 == 4, whole.substr(F.lit(1), F.lit(5))).otherwise(whole)
    names = F.transform("v.vec_id", lambda i: F.concat(F.lit("src/f"), i.cast("string"), F.lit(".rs")))
    meta = of.select(
        path.alias("path"), F.when(f % 11 == 5, 1).otherwise(2).alias("schema_version"), F.when(f % 11 == 6, "other").otherwise(MODEL_NAME).alias("model_name"), F.lit(DIMENSIONS).alias("dimensions"),
        F.when(f % 11 == 7, "r0").when(f % 11 != 8, "r1").alias("repo_rev"), F.when(f % 11 == 9, F.slice(names, 2, F.size(names))).otherwise(names).alias("files"),
    )
    return of.select(path.alias("path"), content.alias("content")), meta
