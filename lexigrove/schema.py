"""Schemas, orders and constants of the retrieval model."""

from __future__ import annotations

# Limits and weights that results depend on.
MATCH_LIMIT = 20
CANDIDATE_LIMIT = 8
TERMS_PER_FILE = 300
READ_LIMIT_BYTES = 262_144
BM25_K1, BM25_B = 1.5, 0.75
LEXICAL_MAX, LEXICAL_MIN, LEXICAL_SHOWN = 0.20, 0.01, 0.04
TIER_WEIGHT, SIGNALS, SNIPPETS = 0.15, 3, 3
SEMANTIC_TOP, COSINE_FLOOR, PREVIEW_CHARS = 8, 0.30, 1500
SNIPPET_WIDTH, SIGNATURE_WIDTH = 88, 120
DISPLAY_LIMIT = 5

# Role predicates on the lower-cased path, first match wins.
GENERATED_PARTS = ["/target/", "/dist/", "/build/", "/vendor/", "generated"]
LOCKFILE_ENDS = ["cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "composer.lock"]
TEST_PARTS = ["/test", "/tests", "__tests__", "test_"]
TEST_ENDS = ["_test.rs", ".spec.", ".test."]
DOC_ENDS = [".md", ".rst", "readme", "readme.md"]
DOC_PARTS = ["/docs/", "/doc/"]
CONFIG_PARTS = ["config", "settings"]
CONFIG_ENDS = [".toml", ".yaml", ".yml", ".json", ".jsonc"]
SOURCE_ENDS = [
    ".rs", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".kts", ".scala", ".sh", ".sql", ".html", ".css", ".scss",
]
SOURCE_PARTS = ["/src/", "/app/", "/lib/", "/services/", "/routes/", "/pages/", "/components/", "/server/"]
LANGUAGE_ENDS = {
    "rust": [".rs"], "go": [".go"], "python": [".py"], "tsx": [".tsx"], "typescript": [".ts", ".mts", ".cts"], "javascript": [".js", ".jsx", ".mjs", ".cjs"],
}
AREA_ROOTS, AREA_GROUPS = ["src", "app", "lib", "services"], ["packages", "modules", "apps"]
SOURCE_ROOTS = ["src/main.rs", "src/lib.rs", "app/main.py", "src/index.ts", "src/index.js"]
FIXTURE_WORDS = ["assert", "expect(", "fixture", "example", "sample", "mock", "test"]

# Additive weights of ranking by role.
EXACT_PHRASE = {"source": 0.34, "doc": 0.24, "test": 0.18, "config": 0.14, "lockfile": 0.08, "generated": 0.10, "other": 0.20}
NEAR_PHRASE = {"source": 0.14, "doc": 0.08, "test": 0.08, "config": 0.06, "lockfile": 0.02, "generated": 0.06, "other": 0.08}
ROLE_WEIGHT = {"source": 0.06, "test": 0.03, "doc": 0.02, "config": 0.04, "lockfile": -0.10, "generated": -0.05}

# What is found in an index: definitions (exact by role, else by strength), references by context, edges by kind.
EXACT_DEFINITION = {"source": 0.44, "doc": 0.32, "test": 0.44, "config": 0.36, "lockfile": 0.16, "generated": 0.06, "other": 0.40}
EXACT_IDENTIFIER, EXACT_SOURCE_BONUS, STRONG_DEFINITION, LOOSE_DEFINITION = 0.68, 0.10, 0.28, 0.14
REFERENCE = {"production": 0.16, "fixture": 0.04, "test": 0.03, "unknown": 0.01}
REFERENCE_BONUS = {"extracted": 0.03, "inferred": 0.0, "ambiguous": -0.01}
EDGE_SIGNAL, EDGE_SIGNAL_OTHER, INBOUND = {"imports": 0.05, "references": 0.05, "declares_module": 0.05, "same_area": 0.005}, 0.01, 0.01
EDGE_RELEVANT = {"symbol": 1.5, "all_terms": 1.3, "some_terms": 1.1}
STATUS_SCALE, STATUS_OTHER = {"fresh": 1.0, "stale": 0.85, "unverifiable": 0.8, "missing": 0.0}, 0.8
ROLE_TEXT = {
    "source": "path suggests source-like file role", "test": "path suggests test file role", "doc": "path suggests documentation file role",
    "config": "path suggests configuration file role", "lockfile": "path suggests lockfile or dependency snapshot", "generated": "path suggests generated or build output",
}

# Graph weights and orders.
EDGE_ORDER = ["declares_module", "imports", "references", "likely_test_for", "configures", "same_area"]
EDGE_WEIGHT = {"imports": 100.0, "references": 100.0, "declares_module": 100.0, "configures": 100.0, "likely_test_for": 75.0, "same_area": 20.0}
EDGE_OTHER = 40.0
DEFINES_REASON, DEFINES_WEIGHT = "defines matched symbol", 1000.0
REF_WEIGHT = {"production": 90.0, "fixture": 60.0, "test": 55.0, "unknown": 25.0}
CONFIDENCE_BONUS = {"extracted": 10.0, "inferred": 5.0, "ambiguous": 0.0}
CONTEXT_ORDER = ["production", "fixture", "test", "unknown"]
CONFIDENCE_ORDER = ["extracted", "inferred", "ambiguous"]
IMPACT_ORDER = ["production", "test_fixture", "same_area", "unknown"]
KIND_ORDER = ["struct", "enum", "trait", "type_alias", "function", "module", "const", "static", "impl", "unknown"]
IMPACT_KINDS = ["struct", "enum", "trait", "type_alias", "const", "static", "module", "function"]
REFERENCEABLE_KINDS = ["struct", "enum", "trait", "type_alias", "const", "static", "module"]

# What marks tests and fixtures in source lines.
ASSERTIONS = ["assert!", "assert_eq!", "assert_ne!", "assert_matches!", "matches!"]
STRONG_TEST_PARTS = ["::", "assert!", "assert_eq!", "assert_ne!", "assert_matches!", "matches!"]
FIXTURE_PARTS = ["fixture", "helper", "loaded_index", "source_texts", "source_file", "build_", "make_", "repo(", "symbol("]
FIXTURE_FUNCTIONS = ["fixture", "helper", "loaded", "source", "build", "make", "repo", "symbol", "setup"]

# Endings that imports and manifests are tried with, and folders that scans leave out.
TYPED_FIRST, PLAIN_FIRST = [".ts", ".tsx", ".js", ".jsx"], [".js", ".jsx", ".ts", ".tsx"]
SCRIPT_ENDS, PAGE_ENDS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"], [".css", ".html"]
PRUNED_FOLDERS = [r"\.git", "target", "node_modules", "dist", "build", "manual-test"]
INDEX_VERSION = 6

# Texts of risk reasons.
RISK = {
    "high": " production files have direct symbol users (", "references": " production references)", "medium": " direct symbol users (", "inbound": " direct inbound impact (",
    "tests": " test/fixture references across ", "area": "only same_area evidence was found", "no_symbol_users": "no direct symbol users were found",
    "no_file_users": "no direct symbol or file users were found", "status": "index status is ",
}

# Grades of retrieval labels.
GAIN = {"primary": 3.0, "acceptable": 2.0, "supporting": 1.0, "irrelevant": 0.0}
HIT_LABELS, RELEVANT_LABELS = ["primary", "acceptable"], ["primary", "acceptable", "supporting"]
