"""References between source files: uses of symbols with their context, and imported names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import roles as R

#: A function's name at the beginning of a line, whatever stands before it.
FUNCTION = r"^(?:pub(?:\([^)]*\))? ?)?(?:(?:async|const|unsafe|default) )*fn ([A-Za-z_][A-Za-z0-9_]*)"
USE = r"^(?:pub(?:\([^)]*\))? ?)?use ([^;]+)"
IDENTIFIER = "[A-Za-z0-9_]+"


def _any(c: Column, words: list[str]) -> Column:
    return reduce(or_, [c.contains(w) for w in words])


def stripped(line: Column) -> Column:
    """A line without its comment and outer white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, "//.*$", ""), r"^\s+|\s+$", ""))


def strong_test_line(c: Column) -> Column:
    """Lines of a test section, or with quotes, whose names count."""
    return c.startswith("use ") | _any(c, S.STRONG_TEST_PARTS) | (c.contains(":") & c.contains("="))


def function_context(name: Column) -> Column:
    """What a function of a test section is for, by its name."""
    low = F.lower(name)
    return F.when(low.contains("test"), "test").when(_any(low, S.FIXTURE_FUNCTIONS), "fixture").otherwise("unknown")


def test_line_context(c: Column, function: Column) -> Column:
    """What a line of a test section is for: its function's context, else its own look."""
    return (
        F.when(function.isin("fixture", "test"), function)
        .when(c.startswith("use "), "fixture")
        .when(_any(c, S.ASSERTIONS), "test")
        .when(c.contains(":") & c.contains("="), "fixture")
        .when(_any(c, S.FIXTURE_PARTS), "fixture")
        .otherwise("unknown")
    )


def line_contexts(lines: DataFrame, defined: DataFrame) -> DataFrame:
    """(path, line_number, code, context, in_test): source lines that can hold references.

    The state runs down each file: a test section never ends; the context
    function is the last function line before the line that no symbol defines;
    a test attribute waits for the next such line. ``defined``: (path,
    line_number) of symbols; their lines hold no references and move no state.
    """
    df = lines.withColumn("code", stripped(F.col("line"))).where("code <> ''").join(defined.select("path", "line_number").distinct().withColumn("is_definition", F.lit(True)).hint("merge"), ["path", "line_number"], "left")
    c = F.col("code")
    section = c.startswith("#[cfg(test)]") | c.startswith("mod tests ") | (c == "mod tests {")
    attribute = ~section & c.startswith("#[test]")
    plain = ~section & ~attribute & F.col("is_definition").isNull()
    name = F.regexp_extract(c, FUNCTION, 1)
    df = df.withColumns({"section": section, "attribute": attribute, "plain": plain, "function": F.when(plain & (name != ""), name)})
    before = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    test_path = R.test_path(F.col("path"))
    n = F.col("line_number")
    df = df.withColumns({
        "in_test": test_path | F.coalesce(F.max("section").over(to_here), F.lit(False)),
        "last_section": F.last(F.when(F.col("section"), n), True).over(before), "last_attribute": F.last(F.when(F.col("attribute"), n), True).over(before), "last_function": F.last(F.when(F.col("function").isNotNull(), n), True).over(before),
    })
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    # an attribute waits if no function line and no section line came after it
    waits = (zero("last_attribute") > 0) & (zero("last_attribute") > zero("last_function")) & (zero("last_attribute") > zero("last_section"))
    df = df.withColumn("of_function", F.when(F.col("function").isNotNull(), F.when(waits, "test").when(F.col("in_test"), function_context(F.col("function"))).otherwise("production")))
    df = df.withColumn("set_by", F.when(F.col("section"), "unknown").otherwise(F.col("of_function")))
    start = F.when(test_path, "unknown").otherwise("production")
    df = df.withColumn("current", F.coalesce(F.last("set_by", True).over(before), start))
    context = F.when(F.col("in_test"), test_line_context(c, F.col("current"))).otherwise("production")
    return df.where("plain").select("path", "line_number", "code", context.alias("context"), "in_test")


def use_names(body: Column) -> Column:
    """The last names of the paths of a ``use`` body: one level of braces, aliases dropped."""
    inner = F.regexp_extract(body, r"\{(.*)\}", 1)
    parts = F.when(body.contains("{"), F.split(inner, ",")).otherwise(F.array(body))
    last = lambda p: F.element_at(F.split(F.trim(F.regexp_replace(p, r"\s+as\s+.*$", "")), "::"), -1)
    return F.filter(F.transform(parts, lambda p: F.trim(last(p))), lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~x.isin("self", "super", "crate"))


def unique_definitions(symbols: DataFrame) -> DataFrame:
    """(symbol_name, target_file, target_line) of names that exactly one referenceable symbol has."""
    named = symbols.where(F.col("kind").isin(S.REFERENCEABLE_KINDS)).groupBy(F.col("name").alias("symbol_name"))
    return named.agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("target_file"), F.min("line_number").alias("target_line")).where("n = 1").drop("n")


def symbol_references(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_file, symbol_name, target_file, target_line, line_number, confidence, reason, context, additional_count) of Rust source lines.

    Names are found by an equi-join on the identifiers of a line.
    """
    source = lines.where(F.col("path").endswith(".rs") & (R.index_role(F.col("path")) == "source"))
    at = line_contexts(source, symbols.select(F.col("file_path").alias("path"), "line_number"))
    c = F.col("code")
    body = F.regexp_extract(c, USE, 1)
    counts = ~(c.contains('"') | c.contains("'") | F.col("in_test")) | strong_test_line(c)
    kind = lambda level, why: [F.lit(level).alias("confidence"), F.lit(why).alias("reason")]
    base = ["path", "line_number", "context"]
    used = at.where(body != "").select(*base, F.explode(use_names(body)).alias("symbol_name"), *kind("extracted", "use statement reference"))
    named = at.where((body == "") & counts).select(*base, F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(IDENTIFIER), F.lit(0)))).alias("symbol_name"), *kind("inferred", "qualified or token reference"))
    found = used.unionByName(named).join(unique_definitions(symbols).hint("merge"), "symbol_name")
    return found.groupBy(F.col("path").alias("from_file"), "symbol_name", "target_file", "context", "confidence", "reason").agg(
        F.min("target_line").alias("target_line"), F.min("line_number").alias("line_number"), (F.count(F.lit(1)) - 1).cast("int").alias("additional_count")
    )


def binding_references(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """References of imported names (from_file, symbol_name, target_file, line_number, confidence, reason) to the first line that defines them; others go."""
    lines = symbols.groupBy(F.col("file_path").alias("target_file"), F.col("name").alias("symbol_name")).agg(F.min("line_number").alias("target_line")).hint("merge")
    found = bindings.where("target_file is not null").join(lines, ["target_file", "symbol_name"])
    return found.select("from_file", "symbol_name", "target_file", "target_line", "line_number", "confidence", "reason", F.lit("production").alias("context"), F.lit(0).alias("additional_count")).distinct()


def module_uses(lines: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, line_number, module): lines with ``module::`` where no identifier runs into it; modules (module) are joined on their name."""
    names = F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_]+)::"), F.lit(1)))
    return lines.select("path", "line_number", F.explode(names).alias("module")).join(modules.select("module").distinct(), "module", "left_semi").select("path", "line_number", "module")
