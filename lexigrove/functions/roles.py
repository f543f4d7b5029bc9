"""Path classifiers as CASE expressions over the lower-cased path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .text import basename, terms


def _any(p: Column, parts: list[str] = (), ends: list[str] = ()) -> Column:
    """Whether a path holds one of the parts or ends so; one pattern, so that the path is written out once in the plan."""
    return p.rlike("|".join([re.escape(x) for x in parts] + [re.escape(x) + r"\z" for x in ends]))


def _role(path: Column, config_ends: list[str], more_source: Column) -> Column:
    p = F.lower(path)
    site = (p.startswith("site/") | p.contains("/site/")) & p.endswith("index.html")
    return (
        F.when(_any(p, S.GENERATED_PARTS) | site, "generated")
        .when(_any(p, ends=S.LOCKFILE_ENDS), "lockfile")
        .when(_any(p, S.TEST_PARTS, S.TEST_ENDS), "test")
        .when(_any(p, S.DOC_PARTS, S.DOC_ENDS), "doc")
        .when(_any(p, S.CONFIG_PARTS, config_ends), "config")
        .when(_any(p, S.SOURCE_PARTS, S.SOURCE_ENDS) | more_source, "source")
        .otherwise("other")
    )


def test_path(path: Column) -> Column:
    """Whether a path is that of a test, whatever its other roles."""
    return _any(F.lower(path), S.TEST_PARTS, S.TEST_ENDS)


def index_role(path: Column) -> Column:
    """The role that an index stores."""
    return _role(path, S.CONFIG_ENDS, F.lit(False))


def rank_role(path: Column) -> Column:
    """The role that ranking uses: no .jsonc, and a file name with the token src, lib or app is source."""
    return _role(path, [e for e in S.CONFIG_ENDS if e != ".jsonc"], F.arrays_overlap(terms(basename(path)), F.array(*map(F.lit, ("src", "lib", "app")))))


def language(path: Column) -> Column:
    out = None
    for name, ends in S.LANGUAGE_ENDS.items():
        hit = _any(path, ends=ends)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def area_key(path: Column) -> Column:
    """The area of a source path: one or two leading segments."""
    parts = F.split(path, "/")
    first, second = parts[0], F.try_element_at(parts, F.lit(2))
    two = F.concat(first, F.lit("/"), second)
    return (
        F.when(first.isin(S.AREA_ROOTS), F.when(second.isNotNull() & ~second.contains("."), two).otherwise(first))
        .when(first.isin(S.AREA_GROUPS) & second.isNotNull(), two)
        .otherwise(first)
    )
