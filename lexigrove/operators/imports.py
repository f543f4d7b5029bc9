"""Imports of source files, resolved to the files they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from .extract import family


def _ends(stems: list[Column], ends: list[str]) -> list[Column]:
    return [F.concat(s, F.lit(e)) for s in stems for e in ends]


def python_options(path: Column, module: Column) -> Column:
    """Files of a dotted module: relative ones from the file's folder, one segment as a package first."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(module, r"^\.+|\.+$", "")
    suffix = F.translate(rest, ".", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(dots - 1, F.lit(1))), lambda _: F.lit(".."))
    base = F.when(dots == 0, "").when(dots == 1, T.parent(path)).otherwise(T.normal_path(F.concat(T.parent(path), F.lit("/"), F.array_join(up, "/"))))
    at = F.when(base == "", suffix).otherwise(F.concat(base, F.lit("/"), suffix))
    init = F.when(base == "", "__init__.py").otherwise(F.concat(base, F.lit("/__init__.py")))
    file, package = F.concat(at, F.lit(".py")), F.concat(at, F.lit("/__init__.py"))
    package_first = (dots == 0) & ~suffix.contains("/")
    return F.when(suffix == "", F.array(init)).when(package_first, F.array(package, file)).otherwise(F.array(file, package))


def script_options(path: Column, module: Column) -> Column:
    """Files of a relative specifier; TypeScript files look for TypeScript first."""
    joined = T.normal_path(F.concat(T.parent(path), F.lit("/"), module))
    typed = path.rlike(r"\.(ts|tsx|mts|cts)$")
    order = lambda ends: F.array(*_ends([joined], ends), *_ends([F.concat(joined, F.lit("/index"))], ends))
    return F.when(T.basename(joined).rlike(r"^.+\.[^.]*$"), F.array(joined)).when(typed, order(S.TYPED_FIRST)).otherwise(order(S.PLAIN_FIRST))


def go_options(path: Column, module: Column) -> Column:
    """Files of every suffix of an import path: as it stands, and beside the file."""
    name = F.regexp_replace(F.regexp_replace(F.trim(module), r"^(\./)+", ""), r"^(\.\./)+", "")

    def suffixes(p: Column) -> Column:
        p = F.regexp_replace(p, "^/+|/+$", "")
        parts = F.split(p, "/")

        def of(i: Column) -> Column:
            s = F.array_join(F.slice(parts, i, F.size(parts)), "/")
            return F.array(F.concat(s, F.lit(".go")), F.concat(s, F.lit("/index.go")), F.concat(s, F.lit("/"), F.element_at(parts, -1), F.lit(".go")))

        return F.concat(F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), of)), F.array(p))

    beside = F.when(T.parent(path) == "", F.array().cast("array<string>")).otherwise(suffixes(F.concat(T.parent(path), F.lit("/"), name)))
    alone = suffixes(name)
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.concat(F.when(name.contains("/"), alone).otherwise(F.array().cast("array<string>")), beside, alone))


def options(path: Column, module: Column) -> Column:
    """The files that an import may mean, in order, by the language of its file; those of Rust are in ``items``."""
    kind = family(path)
    return F.when(kind == "python", python_options(path, module)).when(kind == "script", script_options(path, module)).when(kind == "go", go_options(path, module))


#: What ``normal_path`` changes: backslashes, empty segments, ``.`` and ``..``.
UNTIDY = r"\\|^/|//|/$|(?:^|/)\.{1,2}(?:/|$)"


def manifest_options(path: Column, raw: Column, script_ends: list[str] = S.SCRIPT_ENDS, page_ends: list[str] = S.PAGE_ENDS) -> Column:
    """Files that an entry of a browser manifest may mean: beside it, then from the root, with other endings, then by stem.

    Paths are tidied before the endings are added, which is the same wherever
    a stem ends with a name; else each option is. Options may come twice.
    """
    name = F.regexp_replace(F.trim(raw), "^[\"']+|[\"']+$", "")
    tidy = lambda p: F.when(p.rlike(UNTIDY), T.normal_path(p)).otherwise(p)
    beside = lambda n, base: F.when(n.rlike(r"^\.\.?/"), T.normal_path(F.concat(base, F.lit("/"), n))).when(n.startswith("/"), F.regexp_replace(n, "^/+", "")).when(base == "", n).otherwise(F.concat(base, F.lit("/"), n))
    ends = lambda s, of: F.array(*_ends([s], of))
    index = lambda s: F.concat(s, F.lit("/index"))
    stemmed = lambda s: F.concat(ends(s, script_ends + page_ends), ends(index(s), script_ends))
    part = lambda p, stem, cut: F.struct(p.alias("path"), stem.alias("stem"), cut.alias("cut"))

    def every(parts: Column) -> Column:
        first = F.transform(parts, lambda x: F.concat(F.array(x["path"]), F.when(x["cut"], ends(x["stem"], script_ends)).otherwise(F.concat(ends(x["path"], script_ends), ends(index(x["path"]), script_ends)))))
        # all variants of a path have its stem, or the folder's index file's
        return F.flatten(F.concat(first, F.transform(parts, lambda x: F.when(x["cut"], stemmed(x["stem"])).otherwise(F.concat(stemmed(x["path"]), stemmed(index(x["path"])))))))

    def of(n: Column) -> Column:
        parts = F.transform(F.array_distinct(F.array(beside(n, T.parent(path)), n)), lambda p: T.let(F.regexp_replace(p, r"\.[^.]*$", ""), lambda stem: part(p, stem, stem != p)))
        named = lambda x: x["stem"].rlike(r"[^/\\.]$")
        return T.let(parts, lambda x: F.when(F.forall(x, named), every(F.transform(x, lambda y: part(tidy(y["path"]), tidy(y["stem"]), y["cut"])))).otherwise(F.transform(every(x), T.normal_path)))

    return T.let(name, lambda n: F.when(n != "", of(n)).otherwise(F.array().cast("array<string>")))


def _family_key(path: Column) -> Column:
    """What a path has in common with its other endings and with the index files below it."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "/index$", "")


def manifest_edges(files: DataFrame) -> DataFrame:
    """(edge_type, src, dst, confidence, reason): files that browser manifests name; texts that are no JSON have none.

    An entry's options are a few stems with many endings. It is joined with the
    files of those stems, and the first of its options among them counts.
    """
    kind = "struct<background:struct<service_worker:string,scripts:array<string>>,content_scripts:array<struct<js:array<string>,css:array<string>>>>"
    m = files.where(F.lower("path").endswith("manifest.json")).select("path", "text").repartition("path").select("path", F.from_json("text", kind).alias("m"))
    entry = lambda field, value: F.transform(value, lambda v: F.struct(F.lit(field).alias("field"), v.alias("raw")))
    nothing = F.array().cast("array<struct<field:string,raw:string>>")
    flat = lambda name: F.flatten(F.filter(F.transform("m.content_scripts", lambda c: c[name]), lambda x: x.isNotNull()))
    parts = [entry("background.service_worker", F.array("m.background.service_worker")), entry("background.scripts", F.col("m.background.scripts")), entry("content_scripts.js", flat("js")), entry("content_scripts.css", flat("css"))]
    each = m.select("path", F.explode(F.concat(*[F.coalesce(p, nothing) for p in parts])).alias("x")).where("x.raw is not null")
    asked = each.select(F.col("path").alias("from_file"), "x.field", "x.raw").distinct()
    # the key is the same whatever the ending
    keys = F.array_distinct(F.transform(F.array_distinct(manifest_options(F.col("from_file"), F.col("raw"), [".x"], [])), _family_key))
    known = files.select(F.col("path").alias("target")).distinct().withColumn("key", _family_key(F.col("target")))
    near = asked.select("*", F.explode(keys).alias("key")).join(known.hint("merge"), "key")
    of = near.groupBy("from_file", "field", "raw").agg(F.collect_set("target").alias("there"))
    first = F.get(F.filter(manifest_options(F.col("from_file"), F.col("raw")), lambda o: F.array_contains("there", o)), F.lit(0))
    found = of.select("from_file", "field", F.explode(F.array(first)).alias("target")).where("target is not null")
    reason = F.concat(F.lit("manifest "), "field", F.lit(" references "), "target")
    return found.select(F.lit("references").alias("edge_type"), F.col("from_file").alias("src"), F.col("target").alias("dst"), F.lit("extracted").alias("confidence"), reason.alias("reason")).distinct()
