"""Positions of regular-expression matches with built-in functions only.

``split`` gives what lies between the matches and ``regexp_extract_all`` the
matches; running sums of their lengths are the positions, in code points.
Running values are folded in blocks and over blocks, so that a text with very
many matches is not copied once a match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:int,e:int,m:string>>"
#: Elements that are folded together.
BLOCK = 256


def none() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row; inside a lambda an expression is computed once an element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def blocks(items: Column, size: int = BLOCK) -> Column:
    """An array in slices of ``size``; none of an empty array."""
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / F.lit(size)).cast("int"))
    return F.transform(F.when(F.size(items) > 0, starts).otherwise(F.array().cast("array<int>")), lambda b: F.slice(items, b * size + 1, F.lit(size)))


def before(values: Column, combine: Callable[[Column, Column], Column], size: int = BLOCK) -> Column:
    """For each value the combination (from 0) of those before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(combine(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def spread(parts: Column) -> Column:
        offsets = F.aggregate(F.transform(parts, lambda x: x["at"]), start, step, lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(parts.alias("i"), offsets.alias("o")), lambda z: F.transform(z["i"]["out"], lambda y: combine(y, z["o"]).cast("int"))))

    return let(values, lambda v: let(F.transform(blocks(v, size), lambda part: F.aggregate(part, start, step)), spread))


def find(text: Column, pattern: Column | str, quick: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end, match); ``quick`` rules rows out cheaply."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(places: Column) -> Column:
        starts = before(F.transform(places, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
        return F.transform(F.arrays_zip(places.alias("x"), starts.alias("at")), lambda z: F.struct(
            (z["at"] + z["x"]["gap"]).cast("int").alias("s"), (z["at"] + z["x"]["gap"] + z["x"]["n"]).cast("int").alias("e"), z["x"]["m"].alias("m")))

    def paired(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, p, -1), F.lit(1), F.size(found)).alias("p"), found.alias("m"))
        return let(F.transform(pairs, lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("n"), x["m"].alias("m"))), placed)

    spans = let(F.regexp_extract_all(text, p, F.lit(0)), paired)
    return F.when(text.rlike(pattern) if quick is None else quick, spans).otherwise(none())


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans as (start, order of the kind, kind, end, match), which sort as the contracts ask."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e"), x["m"].alias("m")))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of sorted tagged spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, by start; null for null spans.

    One sweep over both in order: how far the others before a span reach, and
    where the first of those after it starts, are running values.
    """
    last = F.lit(2**31 - 1)
    # at one start the others come first, so that they count as before
    both = F.array_sort(F.concat(*(F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("own"), x["e"].alias("e"), x.alias("x"))) for k, a in enumerate((others, spans)))))

    def swept(y: Column) -> Column:
        reach = before(F.transform(y, lambda v: F.when(v["own"] == 0, v["e"]).otherwise(0)), F.greatest)
        ahead = F.reverse(before(F.reverse(F.transform(y, lambda v: F.when(v["own"] == 0, last - v["s"]).otherwise(0))), F.greatest))
        return F.filter(F.arrays_zip(y.alias("y"), reach.alias("r"), ahead.alias("a")), lambda z: (z["y"]["own"] == 1) & (z["r"] <= z["y"]["s"]) & (last - z["a"] >= z["y"]["e"]))

    return F.when(spans.isNotNull(), F.transform(let(both, swept), lambda z: z["y"]["x"]))


def replaced(text: Column, spans: Column, fill: Callable[[Column], Column]) -> Column:
    """The text with each run of overlapping sorted spans replaced by ``fill`` of its first."""
    reach = before(F.transform(spans, lambda x: x["e"]), F.greatest)
    firsts = F.filter(F.transform(F.arrays_zip(spans.alias("x"), reach.alias("at")), lambda z: F.struct(z["at"].alias("at"), z["x"]["s"].alias("s"), fill(z["x"]).alias("fill"))), lambda z: z["s"] >= z["at"])

    def part(runs: Column) -> Column:
        # what the block covers is cut out once, since a place in a text is counted from its beginning
        base = runs[0]["at"]
        own = F.substring(text, base + 1, F.element_at(runs, -1)["s"] - base)
        return let(own, lambda own: F.array_join(F.transform(runs, lambda r: F.concat(F.substring(own, r["at"] - base + 1, r["s"] - r["at"]), r["fill"])), ""))

    rest = F.substring(text, F.array_max(F.transform(spans, lambda x: x["e"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(let(firsts, lambda v: F.transform(blocks(v), part)), ""), rest)).otherwise(text)


def row_key(id_col: Column, text: Column) -> Column:
    """A 128-bit name of (id, text); a null id is unlike every other, and no id and text can pass for another pair."""
    key = id_col.cast("string")
    own = F.coalesce(F.concat(F.length(key).cast("string"), F.lit(":"), key), F.lit("-"))
    return F.md5(F.concat(own, F.lit(":"), text).cast("binary"))
