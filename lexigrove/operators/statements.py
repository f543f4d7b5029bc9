"""Statements of source files: strings and comments masked, brackets balanced down the file, blocks told apart.

A file's text is cut once into comments, strings, brackets and what stands
between; that gives pieces which end with a semicolon, a brace or a line. Depth
of brackets, line numbers and the number of the statement are running values
over a file's pieces, so a statement is all pieces from one end to the next,
however many lines it spans. Known gaps: regular expressions of scripts are read
as code, and block comments of Rust nest four deep at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .extract import family

#: Ends a piece inside the text; a control character of the text itself counts as a space.
END = "\x01"

_LINE = r"//[^\n]*+"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+\*/"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]++|\\.)*+"', r"'(?:[^'\\\n]++|\\.)*+'"
_RAW = r'\bb?r(#*+)".*?"\1'
_BRACKETS = r"[(){}\[\];\n]"


def _nested(levels: int) -> str:
    inner = "|" + _nested(levels - 1) if levels else ""
    return r"/\*(?:[^*/]++|\*(?!/)|/(?!\*)" + inner + r")*+\*/"


#: By language: comments, strings.
MASKS = {
    "rust": ([_nested(3), _LINE], [_RAW, r'"(?:[^"\\]++|\\.)*+"', r"'(?:\\u\{[0-9A-Fa-f_]++\}|\\[^\n]|[^'\\\n])'"]),
    "python": ([r"#[^\n]*+"], [r'"""(?:[^"\\]++|\\.|"(?!""))*+"""', r"'''(?:[^'\\]++|\\.|'(?!''))*+'''", _DOUBLE, _SINGLE]),
    "script": ([_BLOCK, _LINE], [_DOUBLE, _SINGLE, r"`(?:[^`\\]++|\\.)*+`"]),
    "go": ([_BLOCK, _LINE], [r"`[^`]*+`", _DOUBLE, _SINGLE]),
}
#: By language: the characters that may begin a comment or a string.
_STARTS = {"rust": "\"'/", "python": "\"'#", "script": "\"'`/", "go": "\"'`/"}


def _tokens(text: Column, lang: str) -> Column:
    comments, strings = MASKS[lang]
    plain = f"[^{_STARTS[lang]}(){{}}\\[\\];\n]"
    run = f'(?:(?!\\bb?r#*+"){plain})++' if lang == "rust" else f"{plain}++"
    return F.regexp_extract_all(text, F.lit("(?s)" + "|".join([*comments, *strings, _BRACKETS, run, "."])), F.lit(0))


def _by_family(kind: Column, of) -> Column:
    out = F.when(kind == "rust", of("rust"))
    for lang in list(MASKS)[1:]:
        out = out.when(kind == lang, of(lang))
    return out


def pieces(files: DataFrame) -> DataFrame:
    """(path, family, pos, code, raw, bare) of files (path, text): code without comments, raw with them, bare without strings either."""
    kind = family(F.col("path"))
    clean = F.translate(F.col("text"), END, " ")

    def cut(lang: str) -> Column:
        comment = (lambda t: t.startswith("#")) if lang == "python" else (lambda t: t.startswith("//") | t.startswith("/*"))
        mark = lambda t: F.when(t.isin(";", "{", "}", "\n"), F.concat(t, F.lit(END)))

        def both(tokens: Column) -> Column:
            code = F.array_join(F.transform(tokens, lambda t: F.when(comment(t), F.concat(F.lit(" "), F.regexp_replace(t, "[^\n]", ""))).otherwise(F.coalesce(mark(t), t))), "")
            raw = F.array_join(F.transform(tokens, lambda t: F.coalesce(mark(t), t)), "")
            return F.arrays_zip(F.split(code, END).alias("code"), F.split(raw, END).alias("raw"))

        return T.let(_tokens(clean, lang), both)

    # whole files are dealt out by path, so that the windows over their pieces need no shuffle of their own
    whole = files.where(F.col("text").isNotNull() & kind.isin(*MASKS)).select("path", "text").repartition("path")
    cuts = whole.select("path", kind.alias("family"), F.posexplode(_by_family(kind, cut)).alias("pos", "x"))
    strings = lambda lang: F.regexp_replace("x.code", "(?s)" + "|".join(MASKS[lang][1]), '""')
    return cuts.select("path", "family", "pos", F.col("x.code").alias("code"), F.col("x.raw").alias("raw"), _by_family(F.col("family"), strings).alias("bare"))


def _count(c: Column | str, chars: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{chars}]", ""))


#: Statements whose text is wanted whole; of others, what stands outside braces.
WHOLE = r"^\s*(?:(?:pub\s*(?:\([^)]*\))?\s*)?use\b|import\b|from\b|export\s*(?:type\s*)?[{*]|(?:const|var|type)\s*\()"


def scanned(files: DataFrame) -> DataFrame:
    """Pieces with line_number (of the first character that isn't white space), depth and braces before them, and the statement they are of.

    A statement ends at depth 0: with a line (Python, Go, scripts; not after a
    backslash), a semicolon, a closing brace (Rust) or a closing attribute.
    """
    down = Window.partitionBy("path").orderBy("pos")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    line_end = F.col("bare").endswith("\n")
    end = F.when(F.col("family") == "rust", F.col("bare").rlike(r"[;}]$|\]\s*\n$")).when(F.col("family") == "python", (line_end & ~F.col("bare").endswith("\\\n")) | F.col("bare").endswith(";")).otherwise(line_end | F.col("bare").endswith(";"))
    # only the code goes through the windows; of the other texts, what is asked of them
    of = pieces(files).select(
        "path", "family", "pos", "code", F.col("raw").contains("pub ").alias("says_pub"), (~F.col("code").rlike("[^ \n\t\r]")).alias("blank"), end.alias("end"),
        (_count("bare", r"(\[{") - _count("bare", r")\]}")).alias("net"), (_count("bare", "{") - _count("bare", "}")).alias("net_braces"), _count("code", "\n").alias("lines"), _count(F.regexp_extract("code", r"^\s*", 0), "\n").alias("lead"),
    )
    of = of.withColumns({"depth": running("net"), "braces": running("net_braces"), "line_number": (F.lit(1) + running("lines") + F.col("lead")).cast("int")})
    over = (F.col("depth") + F.col("net") <= 0) & F.col("end")
    of = of.withColumn("statement", running(over.cast("int")))
    # statements only grow down a file, so the first piece of the present one is a running maximum of the same window
    first = F.max(F.when(~F.col("blank"), F.struct("statement", (-F.col("pos")).alias("minus_pos"), "code"))).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return of.withColumn("_first", first).withColumn("head", F.when(F.col("_first.statement") == F.col("statement"), F.col("_first.code"))).drop("_first")


#: What a script's statement holds inside is not looked at: bodies of functions and classes, values of variables, arguments of calls.
HIDES = (
    r"^\s*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\b|class\b|const\s|let\s|var\s|import\b|interface\b)"
    r"|^\s*(?!(?:\}\s*)?(?:if|for|while|switch|catch|with|else|try|do|finally|return)\b)[\w$.\[\]]+\s*\(|^\s*\("
)
#: Groups of declarations of Go, and the beginnings of lists of variables of scripts.
GROUP, VARIABLE = r"^\s*(type|const|var)\s*\(", r"^\s*(?:export\s+)?(?:const|let|var)\s+"


def units(files: DataFrame) -> DataFrame:
    """(path, family, pos, line_number, top, head, text, public_inside): what may declare or import something, blank ones left out.

    That is every statement (``top``), with the text that stands outside braces,
    or all of it for imports; and of scripts the pieces inside and those that
    begin with a comma, of groups of Go the lines, each with the beginning of its
    statement (``head``). ``public_inside`` tells of ``pub `` anywhere in a
    statement, comments and strings included. Units in bodies that aren't
    entered are left out.
    """
    of = scanned(files)
    blank = F.col("blank")
    wanted = (F.col("braces") == 0) | F.col("head").rlike(WHOLE)
    inner = ((F.col("family") == "script") & ((F.col("depth") > 0) | (F.col("head").rlike(VARIABLE) & F.col("code").rlike(r"^\s*,")))) | ((F.col("family") == "go") & (F.col("depth") == 1) & F.col("head").rlike(GROUP))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("pos", "code")))), lambda p: p["code"]), "")
    found = of.groupBy("path", "family", "statement").agg(
        F.min(F.when(~blank, F.struct("pos", "line_number", "code"))).alias("first"),
        text.alias("text"),
        F.max(F.col("says_pub") & F.col("head").isNotNull()).alias("public_inside"),
        F.collect_list(F.when(inner & ~blank, F.struct("pos", "line_number", F.lit(False).alias("top"), "depth", F.col("code").alias("text")))).alias("inner"),
    )
    itself = F.array(F.struct("first.pos", "first.line_number", F.lit(True).alias("top"), F.lit(0).cast("long").alias("depth"), "text"))
    each = found.where("first is not null").select("path", "family", F.col("first.code").alias("head"), "public_inside", F.explode(F.concat(itself, "inner")).alias("u")).select("path", "family", "head", "public_inside", "u.*")
    margin = F.length(F.regexp_replace(F.regexp_extract("head", r"([ \t]*)\S", 1), "\t", " " * 8))
    level = F.when(F.col("family") == "python", margin).otherwise(F.col("depth")).cast("int")
    flat = F.trim(F.regexp_replace("text", r"\\\n|\s+", " "))
    hides = F.when(F.col("family") == "python", flat.rlike(r"^(?:class|def|async def)\b")).when(F.col("family") == "script", F.col("text").rlike(HIDES)).otherwise(False)
    return visible(each.withColumns({"level": level, "hides": hides})).drop("depth", "level", "hides")


def shared(of: DataFrame) -> DataFrame:
    """``of`` behind one shuffle that every use of it reads.

    Spark makes a shuffle once if all of its uses ask for the same. So that
    neither columns nor filters of one use move below it, a row goes as one
    value, which is the key as well, and comes out of a generated row.
    """
    return of.select(F.struct(*of.columns).alias("_row")).repartition("_row").select(F.explode(F.array("_row")).alias("_row")).select("_row.*")


def visible(each: DataFrame) -> DataFrame:
    """Rows (path, pos, top, level, hides, ...) that no row with ``hides`` holds inside it.

    The row that holds another at some level is the last one before it whose
    level is no higher; so for each level at which something hides in the file,
    a running last value tells. All windows are within a file.
    """
    levels = F.collect_set(F.when(F.col("hides"), F.col("level"))).over(Window.partitionBy("path"))
    spread = each.withColumn("_levels", levels).select("*", F.explode_outer("_levels").alias("_w"))
    last = F.last(F.when(F.col("level") <= F.col("_w"), F.col("hides")), ignorenulls=True).over(Window.partitionBy("path", "_w").orderBy("pos", F.desc("top")).rowsBetween(Window.unboundedPreceding, -1))
    columns = [c for c in each.columns if c not in ("path", "pos", "top")]
    kept = spread.withColumn("_h", F.coalesce((F.col("level") > F.col("_w")) & last, F.lit(False))).groupBy("path", "pos", "top").agg(F.first(F.struct(*columns)).alias("_row"), F.max("_h").alias("_h"))
    return kept.where(~F.col("_h")).select("path", "pos", "top", "_row.*")
