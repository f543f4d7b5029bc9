"""Ignore files: their rules as rows, and the files that they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Names of ignore files; one that comes later goes before all that come earlier, at whatever depth.
NAMES = [".gitignore", ".ignore", ".rgignore"]


def to_regex(pattern: Column) -> Column:
    """The regular expression of a pattern without its negation and last slash, for paths below the rule's folder.

    A slash within or before it ties it to that folder; else it holds at any
    depth. Stars and question marks don't cross slashes, ``**`` does.
    """
    tied = pattern.contains("/")
    p = F.regexp_replace(pattern, "^/", "")
    p = F.regexp_replace(p, r"\\([ !#])", "$1")
    p = F.regexp_replace(p, r"([.+^$|(){}])", r"\\$1")
    p = F.regexp_replace(p, r"\[!", "[^")
    for what, by in ((r"(^|/)\*\*/", "$1\x01"), (r"/\*\*$", "/\x02"), (r"\*+", "\x03"), (r"\?", "[^/]")):
        p = F.regexp_replace(p, what, by)
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "\x01", "(?:.*/)?"), "\x02", ".+"), "\x03", "[^/]*")
    return F.concat(F.when(tied, "^").otherwise("^(?:.*/)?"), p, F.lit("$"))


def rules(files: DataFrame) -> DataFrame:
    """(folder, kind, place, regex, negated, only_folders) of the lines of ignore files (path, text); blank lines and comments are none."""
    name = T.basename(F.col("path"))
    kind = F.array_position(F.array(*map(F.lit, NAMES)), name)
    lines = files.where(name.isin(NAMES)).select(T.parent(F.col("path")).alias("folder"), kind.cast("int").alias("kind"), F.posexplode(F.split("text", "\r?\n")).alias("place", "line"))
    line = F.regexp_replace("line", r"(?<!\\)\s+$", "")
    each = lines.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    bare = F.regexp_replace("line", "^!", "")
    return each.select("folder", "kind", "place", to_regex(F.regexp_replace(bare, "/$", "")).alias("regex"), F.col("line").startswith("!").alias("negated"), bare.endswith("/").alias("only_folders")).where("regex not in ('^$', '^(?:.*/)?$')")


def ignored(files: DataFrame, of: DataFrame) -> DataFrame:
    """(path) of files that the rules ignore, themselves or by a folder that they are in.

    Of the rules that match a path, the later kind of file decides, then the
    deeper folder, then the later line; a negated one keeps. Each folder is
    judged once, however many files are in it.
    """
    parts = F.split("path", "/")
    above = lambda p: F.transform(F.sequence(F.lit(0), F.size(F.split(p, "/")) - 1), lambda n: F.array_join(F.slice(F.split(p, "/"), 1, n), "/"))
    each = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    each = each.withColumn("is_folder", F.col("prefix") != F.col("path"))
    asked = each.select("prefix", "is_folder").distinct().select("prefix", "is_folder", F.explode(above(F.col("prefix"))).alias("folder"))
    by_folder = of.groupBy("folder").agg(F.collect_list(F.struct("kind", "place", "regex", "negated", "only_folders")).alias("rules"))
    below = F.when(F.col("folder") == "", F.col("prefix")).otherwise(F.substring("prefix", F.length("folder") + 2, F.length("prefix")))
    hits = asked.join(by_folder, "folder").withColumn("below", below).select(
        "prefix", "is_folder", F.length("folder").alias("depth"), F.array_max(F.transform(F.filter("rules", lambda r: (F.col("is_folder") | ~r["only_folders"]) & F.rlike("below", r["regex"])), lambda r: F.struct(r["kind"].alias("kind"), r["place"].alias("place"), r["negated"].alias("negated")))).alias("hit")
    ).where("hit is not null")
    best = hits.groupBy("prefix", "is_folder").agg(F.max(F.struct("hit.kind", "depth", "hit.place", "hit.negated")).alias("best"))
    return each.join(best.where("not best.negated").select("prefix", "is_folder"), ["prefix", "is_folder"]).select("path").distinct()


def kept(files: DataFrame, of: DataFrame) -> DataFrame:
    """Files that no rule ignores."""
    return files.join(ignored(files, of), "path", "left_anti")
