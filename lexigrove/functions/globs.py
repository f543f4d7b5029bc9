"""Glob filters as regular expressions; a star crosses slashes."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename


def to_regex(glob: str) -> str:
    """An anchored regular expression, the same in Java and RE2."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += ".*"
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(to_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches the path, or the base name if the glob has no slash."""
    tests = [path.rlike(to_regex(g)) for g in globs] + [basename(path).rlike(to_regex(g)) for g in globs if "/" not in g and "\\" not in g]
    return reduce(or_, tests, F.lit(False))


def kept(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    return (matches(path, list(include)) if include else F.lit(True)) & ~matches(path, list(exclude))
