"""Symbols, imports and edges of source files from their statements, and the line-based ones of Rust that stand in for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import roles as R
from ..functions import text as T
from . import imports as I
from .index import cut
from .statements import GROUP, HIDES, VARIABLE, shared, units

NAME, WORD = r"([A-Za-z_$][A-Za-z0-9_$]*)", r"([A-Za-z_][A-Za-z0-9_]*)"
STRINGS = "array<string>"

# ---- what a statement declares, by language: (pattern, group of the name, kind)

#: After visibility and ``async``, ``unsafe``, ``default``; other words in front (``const fn``, ``extern``) make no symbol.
RUST = [("fn ", "function"), ("struct ", "struct"), ("enum ", "enum"), ("trait ", "trait"), ("const ", "const"), (r"static (?:mut )?", "static")]
PYTHON = [(rf"^class {WORD}", "struct"), (rf"^(?:async )?def {WORD}", "function")]


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\\\n|\s+", " "))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column as a generated row, so that the plan holds its expression once however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _first(df: DataFrame, hits: list[Column], *columns: str) -> DataFrame:
    """``columns`` and name, kind and public of the first hit, after which none is sought; rows without one go."""
    return _once(df, "_hit", F.coalesce(*hits)).where("_hit is not null").select(*columns, "_hit.*")


def _is(name: Column, kind: str | Column, public: Column | None = None) -> Column:
    return F.struct(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(True) if public is None else public).alias("public"))


def _without_visibility(line: Column) -> Column:
    """A Rust line without its visibility."""
    return F.regexp_replace(F.trim(line), r"^(?:pub\((?:crate|super)\)|pub\(in [^)]*\)|pub )\s*", "")


def impl_name(header: Column) -> Column:
    """The name of an ``impl`` (after the keyword): ``Trait for Type``, or the type, without type arguments; null if there is none."""
    body = F.regexp_replace(F.trim(header), r"^<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>\s*", "")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s) where .*$", ""), r"(?s)\{.*$", ""))
    simple = lambda c: F.regexp_replace(F.split(F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, "(?s)<.*$", "")), r"[{;]+$", "")), r"\s+")[0], ",+$", "")

    def named(b: Column) -> Column:
        sides = F.transform(F.array(F.regexp_replace(b, "(?s) for .*$", ""), F.regexp_replace(b, "(?s)^.*? for ", "")), simple)
        return F.when(b == "", "impl").otherwise(T.let(sides, lambda s: F.when(~b.contains(" for ") | (s[0] == "") | (s[1] == ""), F.when(s[0] != "", s[0])).otherwise(F.array_join(s, " for "))))

    return T.let(body, named)


def _rust_hits(header: Column, public: Column, items: list[tuple[str, str]]) -> list[Column]:
    hits = [F.when(header.rlike(f"^{word}\\s*[A-Za-z_]") & ~header.rlike(r"^const \s*fn "), _is(F.regexp_extract(header, f"^{word}\\s*{WORD}", 1), kind, public)) for word, kind in items]
    return [*hits, F.when(header.startswith("impl "), T.let(impl_name(F.regexp_replace(header, "^impl ", "")), lambda n: F.when(n.isNotNull(), _is(n, "impl", public))))]


#: Types of Go by what follows the name; an alias makes no symbol.
GO_TYPES = [(rf"^type {WORD}(?:\[[^\]]*\])? struct\b", "struct"), (rf"^type {WORD}(?:\[[^\]]*\])? interface\b", "trait"), (rf"^type {WORD}(?! ?=) *\S", "type_alias")]
GO_FUNCTION = rf"^func (?:\([^)]*\) ?)?{WORD}"

_FUNCTION = rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*{NAME}"
_CLASS = rf"^\s*(?:export\s+)?(?:default\s+)?class\s+{NAME}"
_ARROW = r"(?:async\s+)?function\b|(?:async\s*)?\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::[^={]*)?=>|(?:async\s+)?[A-Za-z_$][\w$]*\s*=>"
_BOUND = rf"(?s)(?:{VARIABLE}|^\s*,\s*){NAME}\s*(?::.*?[^=!<>])?=(?![=>])\s*"
SCRIPT = [(_FUNCTION, _FUNCTION, "function"), (_CLASS, _CLASS, "struct"), (_BOUND + f"(?:{_ARROW})", _BOUND, "function"), (_BOUND + r"class\b", _BOUND, "struct")]


def shared_units(files: DataFrame) -> DataFrame:
    """``units`` for symbols and imports together: the files' texts are cut once for both."""
    return shared(units(files))


def unit_symbols(of: DataFrame) -> DataFrame:
    """(path, line_number, name, kind, public) of units: what each declares, by its language."""
    family, text = F.col("family"), F.col("text")
    item = F.regexp_replace(F.regexp_replace(text, r"^\s*(?:#!?\[(?:[^\[\]]|\[[^\]]*\])*\]\s*)+", ""), r"^\s+", "")
    group = F.when(~F.col("top"), F.concat(F.regexp_extract("head", GROUP, 1), F.lit(" "))).otherwise("")
    # the text as the language's patterns want it: items without attributes, one line, or lines of a group after its word
    rows = _once(of, "_i", F.when(family == "rust", item).when(family == "go", F.concat(group, _flat(text))).when(family == "python", _flat(text)).when(F.col("top"), F.regexp_replace(text, r"\s+", " ")).otherwise(text))
    rows = _once(rows, "_h", F.when(family == "rust", F.regexp_replace(_without_visibility(F.col("_i")), r"^(?:(?:async|unsafe|default) +)+", "")).otherwise(F.col("_i")))
    h = F.col("_h")
    at = lambda p: F.regexp_extract(h, p, 1)
    rust = _rust_hits(h, F.col("public_inside") | F.col("_i").startswith("pub("), RUST)
    python = [F.when(h.rlike(p), _is(at(p), kind, ~at(p).startswith("_"))) for p, kind in PYTHON]
    go = [F.when(h.rlike(p), _is(at(p), kind)) for p, kind in [(GO_FUNCTION, "function"), *GO_TYPES]]
    go += [F.when(h.startswith(w + " "), _is(at(rf"^{w} ([A-Za-z0-9_]+(?: ?, ?[A-Za-z0-9_]+)*)"), kind)) for w, kind in (("const", "const"), ("var", "static"))]
    exported = (F.col("top") | h.rlike(r"^\s*,")) & F.col("head").rlike(r"^\s*export\b")
    script = [F.when(h.rlike(p), _is(at(n), kind, exported & ~at(n).startswith("_"))) for p, n, kind in SCRIPT]
    hit = F.when(family == "rust", F.coalesce(*rust)).when(family == "python", F.coalesce(*python)).when(family == "go", F.coalesce(*go)).when(family == "script", F.coalesce(*script))
    found = _first(rows, [hit], "path", "line_number", "family")
    names = F.when(F.col("family") == "go", F.split("name", " ?, ?")).otherwise(F.array("name"))
    return found.select("path", "line_number", F.explode(names).alias("name"), "kind", "public").where("name not in ('', '_')")


def symbols(files: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(path, line_number, name, kind, visibility, signature) of the items of source files (path, text), distinct; bodies aren't entered."""
    found = unit_symbols(units(files) if of is None else of)
    # a file's lines stay in its row; the join is never a broadcast, since files are estimated by their columns and not by their texts
    by_file = found.groupBy("path").agg(F.collect_list(F.struct("line_number", "name", "kind", "public")).alias("_found")).hint("merge")
    with_line = lambda lines: F.transform("_found", lambda x: F.struct(x["line_number"].alias("line_number"), x["name"].alias("name"), x["kind"].alias("kind"), x["public"].alias("public"), F.get(lines, x["line_number"] - 1).alias("line")))
    each = files.select("path", "text").join(by_file, "path").select("path", F.explode(T.let(F.split("text", "\n"), with_line)).alias("_s")).select("path", "_s.*")
    return each.where("line is not null").select("path", "line_number", "name", "kind", F.when(F.col("public"), "public").otherwise("private").alias("visibility"), T.shorten(F.col("line"), S.SIGNATURE_WIDTH).alias("signature")).distinct()


# ---- imports


def use_paths(body: Column) -> Column:
    """The paths of a ``use`` (what stands between it and the semicolon), each as its segments: the first group's parts take on what stands before it.

    Commas inside further groups part nothing; such a part stays as it is, so
    that its path resolves by its longest known beginning.
    """
    segments = lambda c: F.filter(F.transform(F.split(c, "::"), lambda x: F.trim(x)), lambda s: s != "")
    alias = lambda c: F.regexp_replace(c, "(?s) as .*$", "")
    before = F.regexp_extract(body, r"(?s)^([^{]*)\{", 1)
    inner = F.regexp_extract(body, r"(?s)^[^{]*\{(.*)$", 1)

    def parts(chars: Column) -> Column:
        """A fold over the characters: depth, the part so far and the parts that are done; it ends with the group."""
        state = F.struct(F.lit(1).alias("depth"), F.lit("").alias("now"), F.array().cast(STRINGS).alias("done"))

        def step(s: Column, c: Column) -> Column:
            depth = F.when(s["depth"] == 0, 0).when(c == "{", s["depth"] + 1).when(c == "}", s["depth"] - 1).otherwise(s["depth"])
            comma = (c == ",") & (s["depth"] == 1)
            over = (s["depth"] == 0) | comma | ((c == "}") & (s["depth"] == 1))
            done = F.when((s["depth"] == 1) & (comma | (c == "}")), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
            return F.struct(depth.cast("int").alias("depth"), F.when(over, F.lit("")).otherwise(F.concat(s["now"], c)).alias("now"), done.alias("done"))

        return F.aggregate(chars, state, step, lambda s: F.when(s["depth"] == 0, s["done"]))

    grouped = T.let(parts(F.split(inner, "")), lambda p: F.transform(F.filter(p, lambda x: F.trim(x) != ""), lambda x: F.concat(segments(before), segments(alias(F.trim(x))))))
    plain = F.array(segments(alias(body)))
    return F.filter(F.when(body.contains("{"), F.coalesce(grouped, plain)).otherwise(plain), lambda p: F.size(p) > 0)


def use_body(line: Column) -> Column:
    """What a ``use`` statement of Rust names; null if it is none."""
    body = F.regexp_extract(_without_visibility(line), r"(?s)^use (.*);$", 1)
    return F.when(F.trim(body) != "", F.trim(body))


def mod_name(line: Column) -> Column:
    """The module that a ``mod`` line of Rust declares without a body; null if it is none."""
    name = F.regexp_extract(_without_visibility(line), rf"^mod +{WORD} *;$", 1)
    return F.when(name != "", name)


_ONE_LINE = r"^(?:(?:if|elif|else|try|except|finally|with|for|while)\b.*?: *)?"
PYTHON_FROM = _ONE_LINE + r"from ([. ]*[A-Za-z0-9_.]*) ?import ?([^;]+)"
_FROM = r"(?s)(?:\bfrom|^\s*import)\s*[\"'](\.[^\"']*)[\"']"
_REQUIRE = r"\brequire\s*\(\s*[\"'`](\.[^\"'`]*)[\"'`]"


def imports(files: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(path, line_number, module, confidence, how, names, default_name) of source files (path, text).

    ``how`` is use, mod, import or from; ``names`` are bound from the module,
    without their aliases. ``crate`` paths and all but ``use`` are extracted.
    """
    of = units(files) if of is None else of
    family, nothing = F.col("family"), F.lit(None).cast("string")
    none = F.array().cast(STRINGS)
    rows = _once(of.where("family in ('rust', 'python', 'script') or (family = 'go' and top)"), "_t", F.when((family == "rust") & F.rtrim("text").endswith("}"), F.concat(_flat(F.col("text")), F.lit(";"))).otherwise(_flat(F.col("text"))))
    t = F.col("_t")

    def one(module: Column, how: str, names: Column = none, default: Column = nothing, confidence: Column = F.lit("extracted")) -> Column:
        return F.struct(module.alias("module"), confidence.alias("confidence"), F.lit(how).alias("how"), names.alias("names"), default.alias("default_name"))

    def of_path(p: Column) -> Column:
        return one(F.array_join(p, "::"), "use", confidence=F.when(p[0] == "crate", "extracted").otherwise("inferred"))

    alias = lambda c: F.trim(F.regexp_replace(F.trim(c), " as .*$", ""))
    parts = lambda c: F.transform(F.split(F.regexp_replace(c, "[()]", ""), ","), alias)
    rust = T.let(use_body(t), lambda b: F.when(b.isNotNull(), F.transform(use_paths(b), of_path)).otherwise(T.let(mod_name(t), lambda m: F.when(m.isNotNull(), F.array(one(m, "mod"))))))

    plain = F.transform(F.filter(parts(F.regexp_extract(t, _ONE_LINE + r"import ([^;]+)", 1)), lambda x: x != ""), lambda m: one(m, "import"))
    names = F.filter(parts(F.regexp_extract(t, PYTHON_FROM, 2)), lambda x: ~x.isin("", "*"))
    # a module that isn't relative is a name of its own statement as well
    named = T.let(F.regexp_replace(F.regexp_extract(t, PYTHON_FROM, 1), " ", ""), lambda m: F.array(one(m, "from", F.array_distinct(F.when(m.startswith("."), names).otherwise(F.concat(F.array(m), names))))))
    python = F.when(t.rlike(_ONE_LINE + "import "), plain).when(t.rlike(PYTHON_FROM), named)

    bound = F.filter(F.transform(F.split(F.regexp_extract(t, r"^[^{]*\{([^}]*)\}", 1), ","), alias), lambda x: ~x.isin("", "*", "default"))
    default = F.regexp_replace(F.regexp_extract(t, r"^import +((?:type +)?(?!type\b)[A-Za-z_$][A-Za-z0-9_$]*) *(?:,.*)?(?: from|$)", 1), "^type +", "")
    stated = F.array(one(F.regexp_extract(t, _FROM, 1), "from", F.array_distinct(bound), F.when(default != "", default)))
    required = F.array(one(F.regexp_extract("text", _REQUIRE, 1), "import"))
    script = F.when(F.col("top") & t.rlike(r"^(?:import|export)\b") & t.rlike(_FROM), stated).when(F.col("text").rlike(_REQUIRE) & ~F.col("head").rlike(VARIABLE) & (F.col("text").rlike(r"^\s*require\b") | ~F.col("text").rlike(HIDES)), required)

    # specifications in a group are no children of the declaration, and so not looked at
    go = T.let(F.regexp_extract(t, r"^import +(?:[A-Za-z0-9_.]+ +)?[\"`]([^\"`]*)[\"`]", 1), lambda m: F.when(m != "", F.array(one(m, "import"))))
    found = F.when(family == "rust", rust).when(family == "python", python).when(family == "script", script).otherwise(go)
    return rows.select("path", "line_number", F.explode(found).alias("x")).select("path", "line_number", "x.*")


def rust_module(path: Column) -> Column:
    """The segments of a Rust file's module: none for the roots, the folder's for ``mod.rs``."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "^src/", "")
    return F.when(p.isin("main.rs", "lib.rs"), F.array().cast(STRINGS)).otherwise(F.filter(F.split(F.regexp_replace(p, r"(?:/mod\.rs|\.rs)$", ""), "/"), lambda s: s != ""))


def rust_target(path: Column, segments: Column) -> Column:
    """Segments from the root of what a path names: ``crate`` is the root, ``self`` the file's module, ``super`` what holds it."""
    own, head, tail = rust_module(path), F.try_element_at(segments, F.lit(1)), F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1)))
    above = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    return F.when(head == "crate", tail).when(head == "self", F.concat(own, tail)).when(head == "super", F.concat(above, tail)).otherwise(segments)


def beginnings(segments: Column) -> Column:
    """All beginnings of a path, the longest first, joined by slashes."""
    return F.when(F.size(segments) > 0, F.transform(F.sequence(F.size(segments), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(segments, 1, n), "/"))).otherwise(F.array().cast(STRINGS))


def _rust_options(path: Column, module: Column, how: Column) -> Column:
    segments = F.split(module, "::")
    whole = F.when(how == "mod", F.concat(rust_module(path), segments)).otherwise(rust_target(path, segments))
    files = lambda k: F.array(F.concat(k, F.lit(".rs")), F.concat(k, F.lit("/mod.rs")), F.concat(F.lit("src/"), k, F.lit(".rs")), F.concat(F.lit("src/"), k, F.lit("/mod.rs")))
    return F.flatten(F.transform(beginnings(whole), files))


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with ``target``, the file that a module names; those that name none are left out.

    A Python import from nothing but dots is sought as the package's file, and
    only where that doesn't exist name by name, which is inferred: both kinds of
    candidates are joined at once, and each import's group picks.
    """
    path, module, how = F.col("path"), F.col("module"), F.col("how")
    options = F.coalesce(F.when(path.endswith(".rs"), _rust_options(path, module, how)).otherwise(I.options(path, module)), F.array().cast(STRINGS))
    direct = F.transform(options, lambda p, i: F.struct(F.lit("").alias("name"), i.alias("pos"), p.alias("target")))
    by_name = lambda n: F.transform(I.python_options(path, F.concat(module, n)), lambda p, i: F.struct(n.alias("name"), i.alias("pos"), p.alias("target")))
    dots = (how == "from") & path.endswith(".py") & module.rlike(r"^\.+$")
    asked = found.select("*", F.explode(F.concat(direct, F.when(dots, F.flatten(F.transform("names", by_name))).otherwise(F.array().cast("array<struct<name:string,pos:int,target:string>>")))).alias("c"))
    there = asked.withColumn("target", F.col("c.target")).join(files.select(F.col("path").alias("target")).distinct().hint("merge"), "target")
    hits = there.groupBy(*found.columns).agg(F.array_sort(F.collect_set(F.struct("c.name", "c.pos", "target"))).alias("hits"))
    # sorted by name, then place: the module's own candidates have no name and come first
    firsts = F.filter("hits", lambda h, i: (i == 0) | ((F.try_element_at("hits", F.greatest(i, F.lit(1)))["name"] != h["name"]) & (F.col("hits")[0]["name"] != "")))
    return hits.select(*[c for c in found.columns if c not in ("confidence", "names")], "confidence", "names", F.explode(firsts).alias("h")).select(
        "path", "line_number", "module", F.when(F.col("h.name") == "", F.col("confidence")).otherwise("inferred").alias("confidence"), "how", F.when(F.col("h.name") == "", F.col("names")).otherwise(F.array().cast(STRINGS)).alias("names"), "default_name", "h.target"
    )


def import_edges(resolved: DataFrame) -> DataFrame:
    """(edge_type, src, dst, confidence, reason) of resolved imports, distinct."""
    return resolved.select(F.lit("imports").alias("edge_type"), F.col("path").alias("src"), F.col("target").alias("dst"), "confidence", F.concat(F.lit("imports "), "target").alias("reason")).distinct()


def import_bindings(resolved: DataFrame) -> DataFrame:
    """(from_file, symbol_name, target_file, line_number, confidence, reason): names that resolved imports bind; an alias keeps the original."""
    names = F.transform("names", lambda n: F.struct(n.alias("name"), F.lit("direct").alias("as")))
    default = F.when(F.col("default_name").isNotNull(), F.array(F.struct(F.col("default_name").alias("name"), F.lit("default").alias("as")))).otherwise(F.array().cast("array<struct<name:string,as:string>>"))
    each = resolved.select("*", F.explode(F.concat(names, default)).alias("x"))
    return each.select(F.col("path").alias("from_file"), F.col("x.name").alias("symbol_name"), F.col("target").alias("target_file"), "line_number", "confidence", F.concat("x.as", F.lit(" import binding from "), "target").alias("reason")).distinct()


# ---- Rust by lines, for trees that give nothing

LINE_ITEMS = [*RUST[:4], ("type ", "type_alias"), *RUST[4:]]


def _rust_lines(files: DataFrame) -> DataFrame:
    source = files.where(F.col("path").endswith(".rs") & (R.index_role(F.col("path")) == "source"))
    return source.select("path", F.posexplode(F.split("text", "\n")).alias("_p", "line")).select("path", (F.col("_p") + 1).alias("line_number"), "line", F.regexp_replace(F.regexp_replace("line", "(?s)//.*$", ""), r"^\s+|\s+$", "").alias("code"))


def fallback_symbols(files: DataFrame) -> DataFrame:
    """(path, line_number, name, kind, visibility, signature) of the lines of Rust files that look like items, at any depth."""
    lines = _once(_rust_lines(files), "_h", F.regexp_replace(_without_visibility(F.col("code")), r"^(?:(?:async|unsafe|default) +)+", ""))
    module, public = mod_name(F.col("_h")), _without_visibility(F.col("code")) != F.col("code")
    hits = [*_rust_hits(F.col("_h"), public, LINE_ITEMS), F.when(F.col("_h").startswith("mod "), T.let(module, lambda m: F.when(m.isNotNull(), _is(m, "module", public))))]
    found = _first(lines, hits, "path", "line_number", "line")
    return found.select("path", "line_number", "name", "kind", F.when(F.col("public"), "public").otherwise("private").alias("visibility"), T.shorten(F.col("line"), S.SIGNATURE_WIDTH).alias("signature")).distinct()


def module_keys(files: DataFrame) -> DataFrame:
    """(key, target): the module of each Rust source file by its path; of several files of one module the first."""
    rust = files.where(F.col("path").endswith(".rs") & (R.index_role(F.col("path")) == "source"))
    key = F.regexp_replace(F.regexp_replace(F.translate("path", "\\", "/"), "^src/", ""), r"(?:/mod\.rs|\.rs)$", "")
    return rust.select(key.alias("key"), "path").where("key <> ''").groupBy("key").agg(F.min("path").alias("target"))


def _by_module(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """``asked`` (path, at, segments, said) with the file of the longest beginning of the segments that is a module."""
    each = asked.select("path", "at", "said", F.posexplode(beginnings(F.col("segments"))).alias("pos", "key"))
    return each.join(keys.hint("merge"), "key").groupBy("path", "at", "said").agg(F.min_by("target", "pos").alias("dst"))


def fallback_edges(files: DataFrame) -> DataFrame:
    """(edge_type, src, dst, confidence, reason) of the lines of Rust files (path, text): modules declared, paths used, modules named.

    A file's first line that names a target gives its edge. ``crate::`` paths are
    looked at before bare ``module::`` ones of a line; a bare one is extracted
    if the file imports that module, else inferred.
    """
    lines, keys = _rust_lines(files), module_keys(files)
    shown = lambda dst, said: F.when(F.size(rust_module(dst)) > 0, F.concat(F.lit("crate::"), F.array_join(rust_module(dst), "::"))).otherwise(said)

    declared = lines.select("*", F.explode(F.array(mod_name(F.col("code")))).alias("said")).where("said is not null").select("path", F.struct("line_number", F.lit(0).alias("i")).alias("at"), "said", F.concat(rust_module(F.col("path")), F.array("said")).alias("segments"))
    used = _once(lines, "body", use_body(F.col("code"))).where("body is not null").select("path", "line_number", F.posexplode(use_paths(F.col("body"))).alias("i", "p"))
    used = used.select("path", F.struct("line_number", "i").alias("at"), F.array_join("p", "::").alias("said"), rust_target(F.col("path"), F.col("p")).alias("segments"))
    other = lines.where(~F.col("code").rlike(r"^(?:pub )?(?:use|mod) "))
    chains = other.select("path", "line_number", F.posexplode(F.regexp_extract_all("code", F.lit("crate::([A-Za-z0-9_:]+)"), F.lit(1))).alias("i", "chain"))
    chains = chains.withColumn("p", F.filter(F.split("chain", "::"), lambda s: s != "")).where("size(p) > 0")
    # inside a chain the root stands for the file's own module, too
    root = F.when(F.col("p")[0].isin("crate", "self", "super"), F.slice("p", 2, F.size("p"))).otherwise(F.col("p"))
    chains = chains.select("path", F.struct("line_number", "i").alias("at"), F.array_join("p", "::").alias("said"), root.alias("segments"))

    imported = _by_module(used, keys)
    heads = imported.select("path", F.substring_index(F.regexp_replace(F.regexp_replace("dst", "^src/", ""), r"(?:/mod\.rs|\.rs)$", ""), "/", 1).alias("key")).distinct().withColumn("mine", F.lit(True))
    bare = other.select("path", "line_number", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(rf"(?<![A-Za-z0-9_]){WORD}::"), F.lit(1)))).alias("key"))
    bare = bare.join(keys.hint("merge"), "key").join(heads.hint("merge"), ["path", "key"], "left").select("path", F.struct("line_number", F.lit(1 << 30).alias("i")).alias("at"), F.col("key").alias("said"), F.col("target").alias("dst"), F.when(F.col("mine"), "extracted").otherwise("inferred").alias("confidence"))

    def edges(kind: str, found: DataFrame, word: str, display) -> DataFrame:
        best = found.groupBy("path", "dst").agg(F.min_by(F.struct("said", "confidence"), F.struct("at", "said")).alias("x"))
        return best.select(F.lit(kind).alias("edge_type"), F.col("path").alias("src"), "dst", "x.confidence", F.concat(F.lit(word), display(F.col("dst"), F.col("x.said"))).alias("reason"))

    sure = lambda df: df.withColumn("confidence", F.lit("extracted"))
    return (
        edges("declares_module", sure(_by_module(declared, keys)), "declares module ", lambda dst, said: said)
        .unionByName(edges("imports", sure(imported), "imports ", shown))
        .unionByName(edges("references", sure(_by_module(chains, keys)).unionByName(bare.select("path", "at", "said", "dst", "confidence")), "references ", shown))
    )


def rust_facts(files: DataFrame, tree_symbols: DataFrame, tree_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges with those by lines added where there are Rust files and their statements gave neither a symbol nor an edge.

    Both are written as one table, which the count and the result read: they are
    made once, and the plan of neither holds theirs. The choice is a count of
    one row beside the files, so nothing is collected, and files that are not to
    be read by lines are not.
    """
    columns = [tree_symbols.columns, tree_edges.columns]
    both = cut(tree_symbols.unionByName(tree_edges.withColumnRenamed("src", "path"), allowMissingColumns=True))
    tree_symbols = both.where("edge_type is null").select(*columns[0])
    tree_edges = both.where("edge_type is not null").withColumn("src", F.col("path")).select(*columns[1])
    none = both.where(F.col("path").endswith(".rs")).select(F.lit(1).alias("x")).limit(1).agg((F.count("x") == 0).alias("_none"))
    by_line = files.select("path", "text").join(F.broadcast(none)).where("_none").drop("_none")  # one row
    return tree_symbols.unionByName(fallback_symbols(by_line)).distinct(), tree_edges.unionByName(fallback_edges(by_line)).distinct()


def edge_table(parts: list[DataFrame]) -> DataFrame:
    """(edge_type, src, dst, confidence, reason) of all kinds of edges in one table, distinct."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("edge_type", "src", "dst", "confidence", "reason").distinct()
