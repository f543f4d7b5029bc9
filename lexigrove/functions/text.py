"""Text functions as Column -> Column, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators and case or digit boundaries between terms.
BOUNDARY = r"[/\\._\-: ]|(?<=[a-z])(?=[A-Z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[A-Z])(?=[A-Z][a-z])"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def terms(c: Column) -> Column:
    """Terms of an identifier, path or query: at least two bytes, ASCII lower case."""
    return F.filter(F.transform(F.split(c, BOUNDARY), ascii_lower), lambda t: F.octet_length(t) >= 2)


def lexical_terms(c: Column) -> Column:
    """Terms with at least three bytes that are not all digits."""
    return F.filter(terms(c), lambda t: (F.octet_length(t) >= 3) & ~t.rlike("^[0-9]+$"))


def normalize_phrase(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def squash(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def shorten(c: Column, width: int) -> Column:
    compact = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(compact) > width, F.concat(F.substring(compact, 1, width - 3), F.lit("..."))).otherwise(compact)


def singular(c: Column) -> Column:
    """A token without its plural ending; some endings go as a whole."""
    cut = lambda n: F.substring(c, F.lit(1), F.length(c) - n)
    out = F.when(F.octet_length(c) <= 3, c).when(c.endswith("ies"), F.concat(cut(3), F.lit("y")))
    for end in ("ses", "xes", "zes"):
        out = out.when(c.endswith(end), cut(3))
    for end in ("ches", "shes"):
        out = out.when(c.endswith(end), cut(4))
    return out.when(c.endswith("s") & ~c.endswith("ss"), cut(1)).otherwise(c)


def singular_of(token: str) -> str:
    """The same of a query's term."""
    if len(token.encode()) <= 3:
        return token
    if token.endswith("ies"):
        return token[:-3] + "y"
    for end in ("ses", "xes", "zes", "ches", "shes"):
        if token.endswith(end):
            return token[: -len(end)]
    return token[:-1] if token.endswith("s") and not token.endswith("ss") else token


def token_matches(token: Column, term: str, term_singular: str) -> Column:
    return (token == term) | (token == term_singular) | (singular(token) == term)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def term_counts(tokens: Column, limit: int) -> Column:
    """(term, tf) of the commonest tokens of an array, ties by term: runs of the sorted array, within the row."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.try_element_at(s, F.greatest(i - 1, F.lit(1)))))
        runs = let(starts, lambda at: F.transform(at, lambda p, i: F.struct((p - F.coalesce(F.try_element_at(at, i + 2), F.size(s) + 1)).alias("minus_tf"), F.element_at(s, p).alias("term"))))
        return F.transform(F.slice(F.array_sort(runs), 1, limit), lambda x: F.struct(x["term"].alias("term"), (-x["minus_tf"]).cast("int").alias("tf")))

    return F.when(F.size(tokens) > 0, let(F.array_sort(tokens), counted)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def round2(x: Column) -> Column:
    """Half away from zero at two places, by way of hundredths."""
    return F.round(x * 100, 0) / 100


def ranges(numbers: Column) -> Column:
    """Sorted distinct numbers as runs, written ``a-b``; for the few lines of a match list."""

    def joined(n: Column) -> Column:
        starts, ends = F.filter(n, lambda x: ~F.array_contains(n, x - 1)), F.filter(n, lambda x: ~F.array_contains(n, x + 1))
        one = lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("-"), r["b"].cast("string")))
        return F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), one), ", ")

    return let(numbers, joined)


def range_list(numbers: Column) -> Column:
    """The same as an array of (start, end)."""

    def pairs(n: Column) -> Column:
        starts, ends = F.filter(n, lambda x: ~F.array_contains(n, x - 1)), F.filter(n, lambda x: ~F.array_contains(n, x + 1))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.struct(r["a"].cast("int").alias("start"), r["b"].cast("int").alias("end")))

    return let(numbers, pairs)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def normal_path(path: Column) -> Column:
    """A path with ``\\`` as ``/``, without empty and ``.`` segments, and ``..`` taken out with what it leaves; at the top it goes."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def test_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(stem(path), "^(test_)+", ""), "(_test)+$", ""), r"(\.test)+$", ""), r"(\.spec)+$", "")


def path_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bounded(text: Column, needle: str) -> Column:
    """Whether ``needle`` occurs with no letter or digit on either side."""
    return text.rlike(r"(?<![\p{L}\p{N}])\Q" + needle + r"\E(?![\p{L}\p{N}])")
