"""Neighbourhood, usage and impact over symbols, references and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from ..functions.roles import index_role


def rank_of(c: Column, order: list[str]) -> Column:
    out = F.lit(len(order))
    for i, x in enumerate(order):
        out = F.when(c == x, F.lit(i)).otherwise(out)
    return out


def weight_of(c: Column, weights: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(c == name, F.lit(w)).otherwise(out)
    return out


def edge_weight() -> Column:
    return weight_of(F.col("edge_type"), S.EDGE_WEIGHT, S.EDGE_OTHER) + weight_of(F.col("confidence"), S.CONFIDENCE_BONUS)


def ref_weight() -> Column:
    return weight_of(F.col("context"), S.REF_WEIGHT) + weight_of(F.col("confidence"), S.CONFIDENCE_BONUS)


def level(weight: Column) -> Column:
    """0 high, 1 medium, 2 low."""
    return F.when(weight >= 100, 0).when(weight >= 50, 1).otherwise(2)


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), rank + 1)


def edge_counts(edges: DataFrame) -> DataFrame:
    """(path, incoming, outgoing, types): edges of every node, and their number by type."""
    ends = edges.select(F.col("src").alias("path"), "edge_type", F.lit(0).alias("inc")).unionByName(edges.select(F.col("dst").alias("path"), "edge_type", F.lit(1).alias("inc")))
    by_type = ends.groupBy("path", "edge_type").agg(F.sum("inc").alias("incoming"), F.sum(1 - F.col("inc")).alias("outgoing"))
    text = F.concat(F.col("edge_type"), F.lit("="), (F.col("incoming") + F.col("outgoing")).cast("string"))
    return by_type.groupBy("path").agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"), F.array_join(F.array_sort(F.collect_list(text)), ",").alias("types"))


def map_card(symbols: DataFrame, path: str, limit: int = S.DISPLAY_LIMIT) -> DataFrame:
    """The first symbols of a file: by line, name, kind."""
    return symbols.where(F.col("file_path") == path).select("line_number", "name", "kind", "visibility").orderBy("line_number", "name", "kind").limit(limit)


def lookup(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of the first tier that has any: exact, case ignored, substring; tier 0 to 2."""
    low = F.lower(F.col("name"))
    tier = F.when(F.col("name") == name, 0).when(low == name.lower(), 1).when(low.contains(name.lower()), 2)
    tiered = symbols.withColumn("tier", tier).where("tier is not null")
    best = tiered.agg(F.min("tier").alias("best"))
    return tiered.join(F.broadcast(best), tiered["tier"] == best["best"]).drop("best")  # one row


def mode_guess(query: Column, exists: Column) -> Column:
    """What a query asks about while there is no index: a file if it looks like a path or is one, else a symbol."""
    return F.when(query.contains("/") | query.contains("\\") | query.contains(".") | exists, "file").otherwise("symbol")


def focus_of(files: DataFrame, symbols: DataFrame, query: str) -> DataFrame:
    """(path, mode): the file that a query names, or the files that define the symbol it names, in one plan."""
    hit = files.where(T.normal_path(F.col("path")) == T.normal_path(F.lit(query))).select("path").distinct()
    n_hits = hit.agg(F.count(F.lit(1)).alias("n_hits"))
    defining = lookup(symbols, query).select(F.col("file_path").alias("path")).distinct().join(F.broadcast(n_hits)).where("n_hits = 0").drop("n_hits")  # one row
    return hit.withColumn("mode", F.lit("file")).unionByName(defining.withColumn("mode", F.lit("symbol")))


def kind_counts(symbols: DataFrame) -> DataFrame:
    """(kind, visibility, n, files) of symbols."""
    return symbols.groupBy("kind", "visibility").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("files"))


def grouped_refs(refs: DataFrame) -> DataFrame:
    """References of one file, name, target, context, confidence and reason as one row."""
    key = ["from_file", "symbol_name", "target_file", "context", "confidence", "reason"]
    return refs.groupBy(*key).agg(
        (F.sum(F.col("additional_count") + 1) - 1).alias("additional_count"), F.min("line_number").alias("line_number"), F.min("target_line").alias("target_line")
    )


def usage_summary(refs: DataFrame) -> DataFrame:
    """(symbol_name, total, production, test_fixture, unknown) of references."""
    n = F.col("additional_count") + 1
    when = lambda *c: F.sum(F.when(F.col("context").isin(*c), n).otherwise(0))
    return refs.groupBy("symbol_name").agg(F.sum(n).alias("total"), when("production").alias("production"), when("test", "fixture").alias("test_fixture"), when("unknown").alias("unknown"))


def related(edges: DataFrame, refs: DataFrame, focus: DataFrame, limit: int = S.DISPLAY_LIMIT, listed: bool = False) -> DataFrame:
    """(path, role, score, confidence, reasons): weighted neighbours of the focus paths, in both directions; reasons as an array if ``listed``."""
    f = F.broadcast(focus.select("path").distinct())  # the paths that a user asks about
    in_src, in_dst = f.select(F.col("path").alias("src")), f.select(F.col("path").alias("dst"))
    reason = F.concat(F.col("edge_type"), F.lit(": "), F.col("reason"))
    out = edges.join(in_src, "src", "left_semi").select(F.col("dst").alias("path"), edge_weight().alias("weight"), reason.alias("reason"))
    inc = edges.join(in_dst, "dst", "left_semi").join(in_src, "src", "left_anti").select(F.col("src").alias("path"), edge_weight().alias("weight"), reason.alias("reason"))
    by = F.concat(F.col("symbol_name"), F.lit(" reference for "), F.col("reason"))
    mine, theirs = f.select(F.col("path").alias("from_file")), f.select(F.col("path").alias("target_file"))
    used = refs.join(mine, "from_file", "left_semi").where("target_file is not null").select(F.col("target_file").alias("path"), ref_weight().alias("weight"), by.alias("reason"))
    users = refs.join(theirs, "target_file", "left_semi").join(mine, "from_file", "left_anti").select(F.col("from_file").alias("path"), ref_weight().alias("weight"), by.alias("reason"))
    every = out.unionByName(inc).unionByName(used).unionByName(users).join(f, "path", "left_anti")
    return _rolled(every).orderBy(F.desc("score"), F.desc("level"), "path").limit(limit).select("path", "role", "score", level_name(F.col("level")).alias("confidence"), F.col("reasons") if listed else F.array_join("reasons", "; ").alias("reasons"))


def _rolled(weighted: DataFrame, *more: Column) -> DataFrame:
    """By path: the sum of weights, the best level and all reasons."""
    reasons = F.array_sort(F.collect_set("reason"))
    return weighted.groupBy("path").agg(F.sum("weight").alias("score"), F.min(level(F.col("weight"))).cast("int").alias("level"), reasons.alias("reasons"), *more).withColumn("role", index_role(F.col("path")))


def impact(edges: DataFrame, refs: DataFrame, focus: DataFrame, listed: bool = False) -> DataFrame:
    """(path, role, context, score, confidence, reasons): what a change of the focus paths reaches; inbound, and its area; reasons as an array if ``listed``."""
    f = F.broadcast(focus.select("path").distinct())  # the paths that a user asks about
    src, dst = f.select(F.col("path").alias("src")), f.select(F.col("path").alias("dst"))
    mine, theirs = f.select(F.col("path").alias("from_file")), f.select(F.col("path").alias("target_file"))
    category = F.when(F.col("context") == "production", 0).when(F.col("context").isin("test", "fixture"), 1).otherwise(3)
    by = F.concat(F.col("symbol_name"), F.lit(" reference ("), F.col("context"), F.lit(")"))
    users = refs.join(theirs, "target_file", "left_semi").join(mine, "from_file", "left_anti").select(F.col("from_file").alias("path"), ref_weight().alias("weight"), category.alias("category"), by.alias("reason"))
    of_edge = F.when(F.col("edge_type") == "same_area", 2).when(F.col("edge_type") == "likely_test_for", 1).otherwise(0)
    reason = F.concat(F.col("edge_type"), F.lit(": "), F.col("reason"))
    columns = lambda c: [F.col(c).alias("path"), edge_weight().alias("weight"), of_edge.alias("category"), reason.alias("reason")]
    inbound = edges.join(dst, "dst", "left_semi").select(*columns("src"))
    area = edges.where("edge_type = 'same_area'").join(src, "src", "left_semi").select(*columns("dst"))
    every = users.unionByName(inbound).unionByName(area).join(f, "path", "left_anti")
    name = F.element_at(F.array(*map(F.lit, S.IMPACT_ORDER)), F.col("category") + 1)
    return _rolled(every, F.min("category").alias("category")).select("path", "role", name.alias("context"), "score", level_name(F.col("level")).alias("confidence"), F.col("reasons") if listed else F.array_join("reasons", "; ").alias("reasons"))


def _several(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _test_users(tr: Column, tf: Column) -> Column:
    return _joined(tr, S.RISK["tests"], tf, " ", _several(tf, "file", "files"))


def _status(status: str) -> Column:
    return F.lit(None).cast("string") if status == "fresh" else F.lit(S.RISK["status"] + status)


def risk(refs: DataFrame, status: str = "fresh", areas: DataFrame | None = None) -> DataFrame:
    """(symbol_name, level, reasons): risk of changing each symbol, from the files that use it.

    ``areas``: (symbol_name) of symbols that nothing but the area of their file connects, and symbols without any user.
    """
    n = F.col("additional_count") + 1
    prod, test = F.col("context") == "production", F.col("context").isin("test", "fixture")
    sums = refs.groupBy("symbol_name").agg(
        F.count_distinct(F.when(prod, F.col("from_file"))).alias("pf"), F.coalesce(F.sum(F.when(prod, n)), F.lit(0)).alias("pr"),
        F.count_distinct(F.when(test, F.col("from_file"))).alias("tf"), F.coalesce(F.sum(F.when(test, n)), F.lit(0)).alias("tr"), F.count(F.lit(1)).alias("n_refs"),
    )
    if areas is None:
        sums = sums.withColumn("same_area", F.lit(0))
    else:
        sums = sums.join(areas.select("symbol_name", "same_area"), "symbol_name", "full_outer").na.fill(0, ["pf", "pr", "tf", "tr", "n_refs", "same_area"])
    pf, pr, tf, tr = map(F.col, ("pf", "pr", "tf", "tr"))
    high = _joined(pf, S.RISK["high"], pr, S.RISK["references"])
    medium = _joined(pf, " production ", _several(pf, "file", "files"), _several(pf, " has", " have"), S.RISK["medium"], pr, " production ", _several(pr, "reference", "references"), ")")
    tests = (tf > 0) | (tr > 0)
    first = F.when(pf >= 3, high).when(pf > 0, medium)
    rest = F.when(pf > 0, F.when(tr > 0, _test_users(tr, tf))).when(tests, _test_users(tr, tf)).when(F.col("same_area") > 0, S.RISK["area"]).when(F.col("n_refs") == 0, S.RISK["no_symbol_users"])
    return sums.select("symbol_name", F.when(pf >= 3, "high").when(pf > 0, "medium").otherwise("low").alias("level"), F.array_join(F.array_compact(F.array(first, rest, _status(status))), "; ").alias("reasons"))


def file_evidence(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """One row a file that anything points to: who uses it, by kind of use.

    Symbol users come from references of other files, module users from files
    that import, reference, declare or configure it, counted once each.
    """
    n = F.col("additional_count") + 1
    users = refs.where("target_file is not null and from_file <> target_file").select(
        F.col("target_file").alias("path"), F.col("from_file").alias("user"),
        F.when(F.col("context") == "production", 0).when(F.col("context").isin("test", "fixture"), 1).otherwise(3).alias("category"),
        n.alias("n"), F.lit(False).alias("module"),
    )
    of_edge = F.when(F.col("edge_type") == "same_area", 2).when(F.col("edge_type") == "likely_test_for", 1).otherwise(0)
    module = F.col("edge_type").isin("imports", "references", "declares_module", "configures")
    ends = lambda a, b: [F.col(a).alias("path"), F.col(b).alias("user"), of_edge.alias("category"), F.lit(0).alias("n"), module.alias("module")]
    inbound = edges.where("src <> dst").select(*ends("dst", "src"))
    area = edges.where("edge_type = 'same_area' and src <> dst").select(*ends("src", "dst"))
    by_user = users.unionByName(inbound).unionByName(area).groupBy("path", "user").agg(
        F.min("category").alias("best"), F.max("module").alias("module"),
        *[F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).alias(name) for c, name in ((0, "pr"), (1, "tr"), (3, "ur"))],
    )
    one = lambda when: F.sum(when.cast("int"))
    in_module = (F.col("best") == 0) & F.col("module")
    return by_user.groupBy("path").agg(
        one(F.col("pr") > 0).alias("symbol_files"), F.sum("pr").alias("symbol_references"), one(in_module).alias("module_files"), one((F.col("pr") > 0) | in_module).alias("production_files"),
        one((F.col("tr") > 0) | (F.col("best") == 1)).alias("test_files"), F.sum("tr").alias("test_references"), one(F.col("best") == 2).alias("area_files"), F.sum("ur").alias("unknown_references"), one(F.col("ur") > 0).alias("unknown_files"),
    )


def file_risk(evidence: DataFrame, status: str = "fresh") -> DataFrame:
    """(path, level, reasons): risk of changing each file, from its evidence."""
    c = F.col
    symbols = F.when(c("symbol_references") > 0, _joined(c("symbol_references"), " production symbol ", _several(c("symbol_references"), "reference", "references"), " across ", c("symbol_files"), " ", _several(c("symbol_files"), "file", "files")))
    modules = F.when(c("module_files") > 0, _joined(c("module_files"), " production file/module ", _several(c("module_files"), "user", "users"), " across ", c("module_files"), " ", _several(c("module_files"), "file", "files")))
    p = c("production_files")
    inbound = _joined(p, " production ", _several(p, "file", "files"), _several(p, " has", " have"), S.RISK["inbound"], F.array_join(F.array_compact(F.array(symbols, modules)), "; "), ")")
    tests = _test_users(c("test_references"), c("test_files"))
    no_refs = (c("symbol_references") + c("test_references") + c("unknown_references")) == 0
    rest = F.when(p > 0, F.when(c("test_references") > 0, tests)).when((c("test_files") > 0) | (c("test_references") > 0), tests).when(c("area_files") > 0, S.RISK["area"]).when(no_refs, S.RISK["no_file_users"])
    reasons = F.array_join(F.array_compact(F.array(F.when(p > 0, inbound), rest, _status(status))), "; ")
    return evidence.select("path", F.when(p >= 3, "high").when(p > 0, "medium").otherwise("low").alias("level"), reasons.alias("reasons"))


def file_symbols(symbols: DataFrame, limit: int | None = S.DISPLAY_LIMIT) -> DataFrame:
    """(file_path, pos, name, kind, line_number): the public symbols of each file by importance; ``limit`` of them."""
    wanted = symbols.where((F.col("visibility") == "public") & F.col("kind").isin(S.IMPACT_KINDS))
    order = Window.partitionBy("file_path").orderBy(rank_of(F.col("kind"), S.KIND_ORDER), "line_number", "name")
    numbered = wanted.withColumn("pos", F.row_number().over(order))
    return (numbered if limit is None else numbered.where(F.col("pos") <= limit)).select("file_path", "pos", "name", "kind", "line_number")


def best_symbol(symbols: DataFrame) -> DataFrame:
    """(file_path, name, line_number): the symbol that stands for a file: by kind, public before private, then line and name."""
    priority = rank_of(F.col("kind"), S.KIND_ORDER) * 10 + F.when(F.col("visibility") == "private", 100).otherwise(0)
    return symbols.groupBy("file_path").agg(F.min(F.struct(priority.alias("p"), "line_number", "name")).alias("x")).select("file_path", "x.name", "x.line_number")


def inspection_order(focus: DataFrame, impacted: DataFrame) -> DataFrame:
    """(pos, path): focus paths, then what a change of them reaches, nearest first. The result is a user's reading list."""
    level = rank_of(F.col("confidence"), ["high", "medium", "low"])
    first = focus.select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("c"), F.lit(0).alias("d"), "path")
    rest = impacted.join(F.broadcast(focus.select("path")), "path", "left_anti").select(F.lit(1).alias("a"), rank_of(F.col("context"), S.IMPACT_ORDER).alias("b"), (-F.col("score")).alias("c"), level.alias("d"), "path")
    order = Window.orderBy("a", "b", "c", "d", "path")
    return first.unionByName(rest).withColumn("pos", F.row_number().over(order)).select("pos", "path")


def share_of_best(scored: DataFrame) -> DataFrame:
    """``scored`` with ``share``: the score as a part of the highest, at most 1; 0 if that is not positive."""
    best = scored.agg(F.max("score").alias("best"))
    share = F.when(F.col("best") > 0, F.least(F.col("score") / F.col("best"), F.lit(1.0))).otherwise(0.0)
    return scored.join(F.broadcast(best)).withColumn("share", F.round(share, 6)).drop("best")  # one row


def reason_summary(edges: DataFrame, refs: DataFrame, focus: DataFrame, defines: bool = False) -> DataFrame:
    """(path, label, n, weight): why each neighbour of the focus paths is related: how often each reason occurs, and its highest weight.

    ``defines``: the focus paths define a symbol that is asked for, which is a reason of their own, before all others.
    """
    f = F.broadcast(focus.select("path").distinct())  # the paths that a user asks about
    label = F.when(F.col("edge_type") == "same_area", "same_area").otherwise(F.concat(F.col("edge_type"), F.lit(": "), F.col("reason")))
    by = F.concat(F.col("symbol_name"), F.lit(" reference ("), F.col("context"), F.lit(")"))

    def ends(df: DataFrame, mine: str, other: str, weight: Column, text: Column) -> DataFrame:
        return df.join(f.select(F.col("path").alias(mine)), mine, "left_semi").where(F.col(other).isNotNull()).select(F.col(other).alias("path"), text.alias("label"), weight.alias("weight"))

    every = (
        ends(edges, "src", "dst", edge_weight(), label)
        .unionByName(ends(edges.where("src <> dst"), "dst", "src", edge_weight(), label))
        .unionByName(ends(refs, "from_file", "target_file", ref_weight(), by))
        .unionByName(ends(refs.where("from_file <> target_file"), "target_file", "from_file", ref_weight(), by))
    )
    found = every.join(f, "path", "left_anti").groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
    own = f.select("path", F.lit(S.DEFINES_REASON).alias("label"), F.lit(1).cast("long").alias("n"), F.lit(S.DEFINES_WEIGHT).alias("weight"))
    return found.unionByName(own) if defines else found


def shown_refs(refs: DataFrame) -> DataFrame:
    """(from_file, context, target_file, confidence, symbol_name, line_number, more): one reference stands for those of a file, context and target."""
    order = F.struct(rank_of(F.col("confidence"), S.CONFIDENCE_ORDER).alias("a"), "line_number", "symbol_name", "reason")
    return refs.groupBy("from_file", "context", "target_file").agg(
        F.min_by(F.struct("confidence", "symbol_name", "line_number"), order).alias("x"), (F.sum(F.col("additional_count") + 1) - 1).alias("more")
    ).select("from_file", "context", "target_file", "x.confidence", "x.symbol_name", "x.line_number", "more")


def symbol_uses(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, file_path, n_uses, n_files): every definition with the references to it."""
    uses = refs.groupBy(F.col("symbol_name").alias("name"), F.col("target_file").alias("file_path")).agg(F.sum(F.col("additional_count") + 1).alias("n_uses"), F.count_distinct("from_file").alias("n_files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return symbols.select("name", "file_path").distinct().join(uses, ["name", "file_path"], "left").select("name", "file_path", zero("n_uses"), zero("n_files"))


def shown_edges(edges: DataFrame, limit: int = S.DISPLAY_LIMIT) -> DataFrame:
    """(dst, pos, edge_type, src, reason): the first edges into each file, by kind, ends and reason."""
    order = Window.partitionBy("dst").orderBy(rank_of(F.col("edge_type"), S.EDGE_ORDER), "edge_type", "src", "reason")
    return edges.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("dst", "pos", "edge_type", "src", "reason")
