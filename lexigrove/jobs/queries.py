"""The registered queries: each applies an operator to the given tables as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import globs, roles
from ..functions import text as T
from ..operators import edges as E
from ..operators import evaluate as V
from ..operators import extract as N
from ..operators import graph as G
from ..operators import ignore as O
from ..operators import imports as I
from ..operators import index as K
from ..operators import inputs as J
from ..operators import items as B
from ..operators import lexical as L
from ..operators import rank as R
from ..operators import references as Y
from ..operators import reports as P
from ..operators import scan as C
from ..operators import vector as X
from ..sources import model as M
from ..sources import vector_file as VF

#: What the fixed queries ask for.
PHRASE, WORDS, FILE_QUERY = "apache license", "the version", "core doc"
INCLUDE, EXCLUDE = ["*.rs", "**/core/*.py", "docs/**/*.{md,txt}"], ["lib/**", "*_1?.rs"]
SYMBOL, FOCUS = "SMALL_ring", "nation/3"
IDENTIFIER, FOCUS_FILE = "ApacheLicense", "Brand#2"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _urls_and_names(spark: SparkSession, d: str) -> DataFrame:
    names = M.read(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"))
    urls = M.read(spark, d, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("key"), F.col("url").alias("value"))
    return names.unionByName(urls).unionByName(M.files(spark, d).select(F.concat(F.lit("file/"), F.col("doc_id").cast("string")).alias("key"), F.col("path").alias("value")))


@query
def tokenize_terms(spark, d):
    return _urls_and_names(spark, d).select("key", F.array_join(T.terms(F.col("value")), " ").alias("terms"))


@query
def tokenize_lexical(spark, d):
    t = T.lexical_terms(F.col("text"))
    return M.read(spark, d, "documents").select("doc_id", F.size(t).alias("n_terms"), F.md5(F.array_join(t, "|").cast("binary")).alias("terms_md5"))


@query
def normalize_squash(spark, d):
    return M.read(spark, d, "conversations").select("conv_id", "turn", F.md5(T.normalize_phrase(F.col("text")).cast("binary")).alias("phrase_md5"), F.length(T.squash(F.col("text"))).alias("squashed"))


@query
def shorten_snippet(spark, d):
    return M.read(spark, d, "conversations").select("conv_id", "turn", T.shorten(F.col("text"), S.SNIPPET_WIDTH).alias("snippet"))


@query
def singularize(spark, d):
    words = M.read(spark, d, "documents").select(F.explode(F.split("text", "[^a-z]+")).alias("word")).distinct().where("word <> ''")
    return words.select("word", T.singular(F.col("word")).alias("singular"))


@query
def classify_role_index(spark, d):
    return _urls_and_names(spark, d).select("key", roles.index_role(F.col("value")).alias("role"))


@query
def classify_role_rank(spark, d):
    return _urls_and_names(spark, d).select("key", roles.rank_role(F.col("value")).alias("role"))


@query
def detect_language(spark, d):
    return M.files(spark, d).select("path", roles.language(F.col("path")).alias("language"))


@query
def same_area_key(spark, d):
    return M.files(spark, d).where(roles.index_role(F.col("path")) == "source").select("path", roles.area_key(F.col("path")).alias("area"))


@query
def glob_filter(spark, d):
    return M.files(spark, d).where(globs.kept(F.col("path"), INCLUDE, EXCLUDE)).select("path")


def _lines(spark, d, query, phrase_only=False):
    """Lines of the files that can match, none under build and output folders."""
    q = C.Query(query)
    return C.lines_of(K.pruned(M.files(spark, d)), [q.phrase] if phrase_only else [q.phrase, *q.patterns])


@query
def line_scan(spark, d):
    return C.line_scan(_lines(spark, d, PHRASE, True), [PHRASE])


@query
def scan_two_pass(spark, d):
    return C.two_pass(_lines(spark, d, PHRASE), C.Query(PHRASE))


@query
def scan_coverage(spark, d):
    return C.coverage(C.two_pass(_lines(spark, d, PHRASE), C.Query(PHRASE)))


@query
def baseline_match_rank(spark, d):
    return C.baseline_ranking(_lines(spark, d, WORDS), C.Query(WORDS))


@query
def match_clusters(spark, d):
    found = C.clusters(C.two_pass(_lines(spark, d, WORDS), C.Query(WORDS)))
    return found.select("path", F.col("cluster").cast("long").alias("cluster"), "start_line", "end_line", F.size("items").alias("n"))


@query
def line_ranges(spark, d):
    return C.line_ranges(C.two_pass(_lines(spark, d, WORDS), C.Query(WORDS)))


@query
def lex_stats(spark, d):
    return L.doc_lengths(M.files(spark, d))


@query
def lex_top_terms(spark, d):
    return L.postings(M.files(spark, d))


@query
def doc_freq(spark, d):
    return L.document_frequency(L.postings(M.files(spark, d)), C.Query(WORDS).lex_tokens + ["zzzz"])


@query
def index_stats(spark, d):
    return L.index_stats(M.files(spark, d)).select("lex_file_count", F.round("avg_doc_length", 6).alias("avg_doc_length"))


def _index(spark, d):
    """The stored lexical index of the documents' files, written where there is none of their present state."""
    return K.stored(spark, M.read(spark, d, "documents"), M.files(spark, d))


@query
def bm25_topk(spark, d):
    terms, index = C.Query(PHRASE + " version").lex_tokens, _index(spark, d)
    return L.top_k(index.bm25(terms) if index else L.bm25(M.files(spark, d), terms))


@query
def find_lexical(spark, d):
    return R.find(_lines(spark, d, PHRASE), PHRASE)


@query
def find_match_all(spark, d):
    return R.find(_lines(spark, d, WORDS), WORDS, match="all", roles=["source", "doc"])


@query
def find_indexed(spark, d):
    return R.find_indexed(_lines(spark, d, PHRASE), M.files(spark, d), PHRASE, index=_index(spark, d))


@query
def role_counts(spark, d):
    return M.files(spark, d).groupBy(roles.index_role(F.col("path")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query
def edge_counts(spark, d):
    return G.edge_counts(M.edges(spark, d))


@query
def map_card(spark, d):
    return G.map_card(M.symbols(spark, d), "Brand#2")


@query
def symbol_lookup(spark, d):
    return G.lookup(M.symbols(spark, d), SYMBOL).select("name", "kind", "file_path", "line_number", "tier")


@query
def used_by_grouped(spark, d):
    return G.grouped_refs(M.symbol_refs(spark, d))


@query
def used_by_summary(spark, d):
    return G.usage_summary(M.symbol_refs(spark, d))


@query
def same_area_edges(spark, d):
    return E.area_pairs(M.files(spark, d))


@query
def test_edges(spark, d):
    return E.test_edges(_token_files(spark, d))


def _token_files(spark, d):
    """Files named by their parts' names, so that stems share tokens."""
    part = M.read(spark, d, "part")
    name = F.regexp_replace("p_name", " ", "_")
    test = F.concat(F.lit("src/t/test_"), name, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".rs"))
    source = F.concat(F.lit("src/s/"), name, F.lit(".rs"))
    return part.select(test.alias("path")).unionByName(part.select(source.alias("path")).distinct())


@query
def config_edges(spark, d):
    return E.config_edges(M.files(spark, d))


@query
def import_resolve(spark, d):
    docs = M.next_of_source(M.read(spark, d, "documents")).where("next_id is not null")
    target = M.doc_path(F.col("next_id"), F.col("source"))
    asked = docs.select(M.doc_path(F.col("doc_id"), F.col("source")).alias("from_file"), F.col("doc_id").cast("string").alias("spec"), F.array(F.concat(target, F.lit("x")), target).alias("options"))
    return E.resolve(asked, M.files(spark, d))


@query
def symbol_refs(spark, d):
    refs = M.symbol_refs(spark, d)
    return refs.groupBy("target_file", "symbol_name", "context", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("additional_count") + 1).alias("total"))


def _focus(spark, path):
    return spark.createDataFrame([(path,)], "path string")


@query
def related_files(spark, d):
    return G.related(M.edges(spark, d), M.symbol_refs(spark, d), _focus(spark, FOCUS))


@query
def blast_impact(spark, d):
    return G.impact(M.edges(spark, d), M.symbol_refs(spark, d), _focus(spark, FOCUS))


@query
def blast_risk(spark, d):
    return G.risk(M.symbol_refs(spark, d), "stale", _unused(spark, d))


def _unused(spark, d):
    """(symbol_name, same_area): every symbol, and whether an area connects its file."""
    return M.symbols(spark, d).groupBy(F.col("name").alias("symbol_name")).agg(F.max((F.col("kind") == "module").cast("int")).alias("same_area"))


def _vectors(spark, d):
    return M.read(spark, d, "embeddings").select(F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("path"), "embedding", "vec_id")


def _nearest(spark, d):
    v = _vectors(spark, d)
    first = v.agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return X.top_cosine(v.drop("vec_id"), first)


@query
def cosine_topk(spark, d):
    return _nearest(spark, d)


def _candidates(spark, d):
    v = M.read(spark, d, "embeddings")
    score = F.round((F.col("vec_id") * 37 % 101) / F.lit(101.0), 6)
    return v.select(F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("path"), score.alias("score"), F.when(F.col("label") % 2 == 0, "high").otherwise("low").alias("confidence"), (F.col("label") == 3).alias("anchor"))


@query
def semantic_fusion(spark, d):
    return X.fuse(_candidates(spark, d), _nearest(spark, d))


@query
def semantic_guard(spark, d):
    return X.guard(_candidates(spark, d))


def _scored(spark, d):
    return V.per_task(M.ranked(spark, d), M.judged(spark, d), M.runs(spark, d))


@query
def eval_per_task(spark, d):
    return _scored(spark, d).drop("query")


@query
def eval_grouping_sets(spark, d):
    return V.summary(_scored(spark, d))


@query
def eval_percentiles(spark, d):
    return V.percentiles(M.runs(spark, d), ["task_type", "mode"])


@query
def eval_c_vs_d(spark, d):
    return V.compare_rates(V.compare(_scored(spark, d), M.ranked(spark, d), M.judged(spark, d)))


@query
def eval_gates(spark, d):
    by_mode = _scored(spark, d).groupBy("mode").agg(*[F.round(F.avg(m) + 1e-9, 6).alias(m) for m in ("hit1", "hit8", "rr")])
    long = by_mode.unpivot("mode", ["hit1", "hit8", "rr"], "metric", "value").select(F.concat("metric", F.lit("_"), "mode").alias("name"), "value")
    rules = spark.createDataFrame([("hit1_B", ">=", 0.70), ("hit8_B", ">=", 0.85), ("hit1_C", ">=", 0.85), ("hit8_C", ">=", 1.0), ("rr_D", ">=", 0.95), ("hit8_E", ">=", 0.5)], "name string, op string, threshold double")
    return V.gates(long, rules)


@query
def eval_demotions(spark, d):
    return V.demotions(M.ranked(spark, d), "C", "B")


@query
def eval_no_hit(spark, d):
    return V.no_hit(_scored(spark, d))


@query
def eval_slowest(spark, d):
    return V.slowest(M.runs(spark, d))


@query
def eval_validate(spark, d):
    tasks = M.tasks(spark, d).withColumn("repo_id", F.when(F.col("item_id") % 7 != 0, F.col("repo_id")))
    labels = M.read(spark, d, "labels").select(
        F.concat(F.lit("task_"), (F.col("doc_id") % 60).cast("string")).alias("task_id"), F.concat(F.lit("repo"), (F.col("doc_id") % 60 % 3).cast("string")).alias("repo_id"),
        F.when(F.col("doc_id") % 11 == 0, "/abs").when(F.col("doc_id") % 13 != 0, "src/a.rs").alias("path"), F.when(F.col("toxic") == 1, "bad").otherwise("primary").alias("label"),
    )
    tasks = tasks.withColumn("task_id", F.when(F.col("item_id") % 17 != 16, F.col("task_id")))
    return V.violations(tasks, labels)


@query
def extract_symbols(spark, d):
    return B.symbols(M.source_files(spark, d))


@query
def extract_imports(spark, d):
    return B.imports(M.source_files(spark, d)).withColumn("names", F.array_join("names", ","))


@query
def identifier_refs(spark, d):
    code = M.code_lines(spark, d)
    return N.identifier_refs(code, N.symbols(code))


@query
def semantic_wins(spark, d):
    """What one mode finds and the other doesn't, the losses, and the bad promotions, as three lists."""
    return V.mode_lists(_scored(spark, d), M.ranked(spark, d), M.judged(spark, d))


@query
def vector_file_load(spark, d):
    """Vectors of binary files with the names that they belong to, or why a file can't be used."""
    files, meta = M.vector_files(spark, d)
    found = VF.loaded(files, meta, K.semantic_problem(2, M.MODEL_NAME, M.DIMENSIONS, "r1"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("path", "problem", "name", F.coalesce(F.array_size("embedding"), F.lit(0)).alias("n"), F.round(total, 6).alias("total"), F.col("embedding")[0].cast("double").alias("first"))


@query
def task_counts(spark, d):
    return M.tasks(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


@query
def find_report(spark, d):
    return R.find_report(_lines(spark, d, WORDS), WORDS)


def _reread(report):
    """A report as it comes back from its JSON."""
    return P.from_json(P.to_json(report), report)


@query
def find_json(spark, d):
    """The find report from its nested JSON, one row a candidate."""
    return R.written(_reread(R.find_document(_lines(spark, d, WORDS), WORDS)).select(F.inline("candidates")))


@query
def map_json(spark, d):
    """Map reports of all nodes and symbols' files from their JSON, arrays as text."""
    edges, symbols = M.edges(spark, d), M.symbols(spark, d)
    nodes = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).unionByName(symbols.select(F.col("file_path").alias("path"))).distinct()
    back = _reread(P.map_documents(nodes, symbols, edges))
    edge = lambda side: lambda e: F.concat_ws(" ", e["edge_type"], e[side], e["confidence"])
    return back.select(
        "path", "role", F.array_join(F.transform("symbols", lambda s: F.concat_ws(" ", s["line_number"], s["name"], s["kind"], s["visibility"])), "\n").alias("symbols"),
        F.array_join(F.transform("outgoing_edges", edge("dst")), "\n").alias("outgoing"), F.array_join(F.transform("incoming_edges", edge("src")), "\n").alias("incoming"),
        F.coalesce("connection_counts.incoming", F.lit(0)).alias("n_incoming"), F.coalesce("connection_counts.outgoing", F.lit(0)).alias("n_outgoing"),
        F.coalesce(F.array_join(F.transform("connection_counts.by_type", lambda t: F.concat_ws("=", t["edge_type"], t["n"])), ","), F.lit("")).alias("types"),
    )


@query
def symbol_json(spark, d):
    return _reread(P.symbol_document(M.symbols(spark, d), M.symbol_refs(spark, d), SYMBOL)).select("query", "match_mode", F.inline("matches"))


@query
def related_json(spark, d):
    back = _reread(P.related_document(M.edges(spark, d), M.symbol_refs(spark, d), _focus(spark, FOCUS), FOCUS))
    return back.select(F.inline("related_files")).withColumn("reasons", F.array_join("reasons", "; "))


@query
def blast_json(spark, d):
    back = _reread(P.blast_document(M.edges(spark, d), M.symbol_refs(spark, d), _focus(spark, FOCUS), FOCUS))
    return back.select(F.inline("impacted_files")).withColumn("reasons", F.array_join("reasons", "; "))


def _facts(spark, d):
    return M.doc_symbols(spark, d), M.doc_refs(spark, d), M.doc_edges(spark, d)


@query
def find_with_signals(spark, d):
    return R.find_indexed(_lines(spark, d, PHRASE), M.files(spark, d), PHRASE, "stale", *_facts(spark, d), index=_index(spark, d))


@query
def find_indexed_report(spark, d):
    return R.find_indexed_report(_lines(spark, d, IDENTIFIER), M.files(spark, d), IDENTIFIER, "fresh", *_facts(spark, d), index=_index(spark, d))


@query
def line_contexts(spark, d):
    code = M.rust_lines(spark, d)
    return Y.line_contexts(code, N.symbols(code))


@query
def symbol_ref_contexts(spark, d):
    code = M.rust_lines(spark, d)
    return Y.symbol_references(code, _as_symbols(N.symbols(code)))


def _as_symbols(found):
    return found.withColumnRenamed("path", "file_path")


@query
def module_uses(spark, d):
    code = M.rust_lines(spark, d)
    return Y.module_uses(code, N.symbols(code).where("kind = 'struct'").select(F.col("name").alias("module")))


def _resolved(spark, d):
    files = M.source_files(spark, d)
    return B.resolved_imports(B.imports(files), files)


@query
def import_edges(spark, d):
    return B.import_edges(_resolved(spark, d))


@query
def import_bindings(spark, d):
    return B.import_bindings(_resolved(spark, d))


@query
def binding_refs(spark, d):
    files = M.source_files(spark, d)
    of = B.shared_units(files)
    return Y.binding_references(B.import_bindings(B.resolved_imports(B.imports(files, of), files)), _as_symbols(B.unit_symbols(of)))


@query
def readable_texts(spark, d):
    """What is read of documents as files of bytes: some are no UTF-8, some large."""
    i = F.col("doc_id")
    raw = F.when(i % 10 == 0, F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FFFE")))).when(i % 7 == 0, F.encode(F.repeat("text", 200), "utf-8")).otherwise(F.encode("text", "utf-8"))
    read = M.files(spark, d).select("path", raw.alias("content")).select("path", F.octet_length("content").alias("size_bytes"), K.text_of(F.col("content"), F.col("path")).alias("text"))
    return read.select("path", "size_bytes", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars"))


@query
def surviving_repos(spark, d):
    """Repositories of suppliers that labelled tasks name, as a run that takes only labelled tasks keeps them."""
    repos = M.read(spark, d, "supplier").select(F.concat(F.lit("repo"), F.col("s_suppkey").cast("string")).alias("repo_id"), "s_name")
    labelled = M.read(spark, d, "labels").select(F.concat(F.lit("task_"), F.col("doc_id").cast("string")).alias("task_id")).distinct()
    tasks = M.tasks(spark, d).select("task_id", F.concat(F.lit("repo"), (F.col("item_id") * 3).cast("string")).alias("repo_id"))
    return J.surviving_repos(repos, tasks.join(labelled, "task_id", "left_semi"))


@query
def ignored_files(spark, d):
    """Which files of a few trees their ignore files leave out."""
    files = M.tree_files(spark, d)
    out = O.ignored(files, O.rules(files)).withColumn("ignored", F.lit(True))
    return files.where("path not like '%ignore'").select("path").join(out, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


@query
def fallback_symbols(spark, d):
    return B.fallback_symbols(M.source_files(spark, d))


@query
def fallback_edges(spark, d):
    return B.fallback_edges(M.source_files(spark, d))


@query
def rust_facts(spark, d):
    """Symbols and edges of two sets of Rust files: one whose statements say something, and one that is read line by line."""
    out = []
    for name, files in (("statements", M.source_files(spark, d).where("path like '%.rs'")), ("lines", M.closed_files(spark, d))):
        of = B.shared_units(files)
        symbols, edges = B.rust_facts(files, B.symbols(files, of), B.import_edges(B.resolved_imports(B.imports(files, of), files)))
        out.append(symbols.select(F.lit(name).alias("corpus"), F.lit("symbol").alias("fact"), "path", F.col("kind").alias("what"), "name", F.col("visibility").alias("detail"), "line_number"))
        out.append(edges.select(F.lit(name).alias("corpus"), F.lit("edge").alias("fact"), F.col("src").alias("path"), F.col("edge_type").alias("what"), F.col("dst").alias("name"), F.col("confidence").alias("detail"), F.lit(0).alias("line_number")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query
def all_edges(spark, d):
    """Edges of statements (or lines), manifests, tests, configuration and the areas of a focus file, in one table without repeats."""
    closed = M.closed_files(spark, d)
    of = B.shared_units(closed)
    _, rust = B.rust_facts(closed, B.symbols(closed, of), B.import_edges(B.resolved_imports(B.imports(closed, of), closed)))
    kind = lambda df, name: df.withColumn("edge_type", F.lit(name))
    near = kind(area_edges(spark, d), "same_area").withColumn("confidence", F.lit("inferred")).withColumn("reason", F.lit("same area"))
    config = kind(config_edges(spark, d), "configures").withColumn("confidence", F.lit("inferred")).withColumn("reason", F.lit("configuration"))
    return B.edge_table([import_edges(spark, d), rust, manifest_edges(spark, d), kind(test_edges(spark, d), "likely_test_for"), config, near])


@query
def manifest_edges(spark, d):
    return I.manifest_edges(M.manifests(spark, d))


@query
def file_evidence(spark, d):
    return G.file_evidence(M.doc_edges(spark, d), M.doc_refs(spark, d))


@query
def file_risk(spark, d):
    return G.file_risk(G.file_evidence(M.doc_edges(spark, d), M.doc_refs(spark, d)), "stale")


@query
def file_symbols(spark, d):
    return G.file_symbols(M.symbols(spark, d))


@query
def best_symbol(spark, d):
    return G.best_symbol(M.symbols(spark, d))


@query
def symbol_uses(spark, d):
    return G.symbol_uses(M.symbols(spark, d), M.symbol_refs(spark, d))


@query
def shown_refs(spark, d):
    return G.shown_refs(M.symbol_refs(spark, d))


@query
def shown_edges(spark, d):
    return G.shown_edges(M.edges(spark, d))


@query
def reason_summary(spark, d):
    return G.reason_summary(M.edges(spark, d), M.symbol_refs(spark, d), _focus(spark, FOCUS))


@query
def reason_summary_symbol(spark, d):
    """Why files are related to those that define a symbol."""
    defining = G.lookup(M.symbols(spark, d), SYMBOL).select(F.col("file_path").alias("path")).distinct()
    return G.reason_summary(M.edges(spark, d), M.symbol_refs(spark, d), defining, defines=True)


@query
def semantic_rerank(spark, d):
    """Ranked files of an identifier, which similarities only annotate, and of a phrase, with anchors from their evidence."""
    vectors = M.read(spark, d, "embeddings").where("embedding is not null")
    near = M.files(spark, d).join(vectors, F.col("doc_id") == F.col("vec_id")).select("path", "embedding", "vec_id")
    semantic = X.top_cosine(near.drop("vec_id"), near.agg(F.min_by("embedding", "vec_id").alias("embedding")))
    out = []
    for query in (IDENTIFIER, PHRASE):
        ranked = R.find_indexed_explained(_lines(spark, d, query), M.files(spark, d), query, "fresh", *_facts(spark, d), index=_index(spark, d))
        out.append(X.rerank(ranked, semantic, query).withColumn("asked", F.lit(query)))
    return out[0].unionByName(out[1])


@query
def inspection_order(spark, d):
    return G.inspection_order(_focus(spark, FOCUS), blast_impact(spark, d))


@query
def impact_share(spark, d):
    return G.share_of_best(blast_impact(spark, d)).select("path", "score", "share")


@query
def area_edges(spark, d):
    first = M.files(spark, d).where(roles.index_role(F.col("path")) == "source").agg(F.min("path").alias("path"))
    return E.area_edges(M.files(spark, d), first)


@query
def semantic_documents(spark, d):
    docs = X.documents(M.files(spark, d), M.doc_symbols(spark, d), roles.index_role(F.col("path")))
    return docs.select("path", F.length("document").alias("n_chars"), F.md5(F.col("document").cast("binary")).alias("document_md5"))


@query
def semantic_symbol_guard(spark, d):
    return X.guard(X.fuse(_candidates(spark, d).withColumn("symbol_anchor", F.col("path").endswith("7")), _nearest(spark, d)))


@query
def index_files(spark, d):
    rows = K.indexed_files(K.walked(M.files(spark, d)))
    return rows.select("path", "role", "size_bytes", F.col("content_hash").isNotNull().alias("hashed"), F.coalesce("doc_length", F.lit(-1)).alias("doc_length"), F.coalesce(F.size("terms"), F.lit(-1)).alias("n_terms"))


@query
def scan_pruned(spark, d):
    urls = M.read(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    named = M.read(spark, d, "part").select(F.concat(M.pick(["target", "a/build", "src/distance", ".git/x", "b/.hidden", "node_modules/c", "ok"], F.col("p_partkey")), F.lit("/"), F.regexp_replace("p_name", " ", "."), M.pick([".rs", ".exe", ".DLL"], F.col("p_size"))).alias("path"))
    every = urls.unionByName(named).distinct()
    kept = lambda df, name: df.select("path", F.lit(True).alias(name))
    return every.join(kept(K.pruned(every), "scanned"), "path", "left").join(kept(K.walked(every), "indexed"), "path", "left").na.fill(False)


@query
def index_state(spark, d):
    k = F.col("p_partkey")
    rev = lambda n: F.when(k % n != 0, F.concat(F.lit("r"), (k % 5).cast("string")))
    return M.read(spark, d, "part").select("p_partkey", K.state(rev(7), F.when(k % 3 == 0, F.lit("r1")).otherwise(rev(4)), k % 13 != 0).alias("state"))


@query
def eval_found_json(spark, d):
    return J.found_paths(M.found_json(spark, d)).select("run", "ok", F.array_join("paths", ",").alias("paths"), "semantic_status")


@query
def eval_task_json(spark, d):
    rows = J.required(J.json_rows(M.task_json(spark, d), "task_id string, repo_id string, query string"), ["task_id", "repo_id"])
    labelled = M.read(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("task_"), F.col("doc_id").cast("string")).alias("task_id"))
    return J.selected(rows, ["repo1", "repo2"], labelled)


@query
def eval_fan_out(spark, d):
    return J.fan_out(M.ranked(spark, d), "B", ["C", "D"])


@query
def kind_counts(spark, d):
    return G.kind_counts(M.symbols(spark, d))


@query
def mode_guess(spark, d):
    named = _urls_and_names(spark, d)
    return named.select("key", G.mode_guess(F.col("value"), F.col("key").startswith("file/")).alias("mode"))


@query
def focus_paths(spark, d):
    files = M.symbols(spark, d).select(F.col("file_path").alias("path")).distinct()
    asked = ["./x/../" + FOCUS_FILE, SYMBOL]
    both = [G.focus_of(files, M.symbols(spark, d), q).withColumn("asked", F.lit(q)) for q in asked]
    return both[0].unionByName(both[1])


@query
def all_refs(spark, d):
    """References of every language in one table, without repeats."""
    code = M.rust_lines(spark, d)
    rust = Y.symbol_references(code, _as_symbols(N.symbols(code)))
    every = rust.unionByName(binding_refs(spark, d))
    return K.distinct_facts(every, every.columns)
