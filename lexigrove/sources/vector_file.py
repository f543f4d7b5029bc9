"""Vectors in one binary file: two numbers of 32 bits (how many vectors, how many places), then the places as floats, low byte first.

Files are read by Spark's binary source and decoded by expressions, a float from
its 32 bits; writing is the reverse. A file is one row, as its format has no
place to cut it without its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER, WIDTH = 8, 4


def _unsigned(raw: Column) -> Column:
    """Four bytes, low byte first, as a number."""
    h = F.hex(raw)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


def _bytes(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def to_float(raw: Column) -> Column:
    """The float that four bytes are: sign, exponent and fraction; all ones as exponent is infinite or no number."""
    n = _unsigned(raw)
    sign = F.when(F.shiftright(n, 31).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(n, 23).bitwiseAND(F.lit(255)), n.bitwiseAND(F.lit((1 << 23) - 1)).cast("double") / float(1 << 23)
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small = sign * fraction * F.lit(2.0**-126)
    return F.when(exponent == 255, special).when(exponent == 0, small).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))).cast("float")


def to_bits(x: Column) -> Column:
    """The 32 bits of a float as a number; null counts as no number."""
    d = F.abs(x.cast("double"))
    # the logarithm may be one off next to a power of two
    guess = F.floor(F.log2(d))
    exponent = F.when(d >= F.pow(F.lit(2.0), guess + 1.0), guess + 1).when(d < F.pow(F.lit(2.0), guess.cast("double")), guess - 1).otherwise(guess)
    normal = (exponent + 127) * (1 << 23) + F.round((d / F.pow(F.lit(2.0), exponent.cast("double")) - 1) * float(1 << 23)).cast("long")
    small = F.round(d * F.lit(2.0**126) * float(1 << 23)).cast("long")
    size = F.when(x.isNull() | F.isnan(x), F.lit(0x7FC00000)).when(d == F.lit(float("inf")), F.lit(0x7F800000)).when(d < F.lit(2.0**-126), small).otherwise(normal)
    negative = (x < 0) | ((x == 0) & (F.concat(x.cast("string"), F.lit("")) == "-0.0"))
    return (size + F.when(negative & x.isNotNull() & ~F.isnan(x), F.lit(1 << 31)).otherwise(F.lit(0))).cast("long")


def encoded(vectors: Column, dimensions: int) -> Column:
    """The content of a file with an array of vectors."""
    body = F.array_join(F.transform(F.flatten(vectors), lambda x: _bytes(to_bits(x))), "")
    return F.unhex(F.concat(_bytes(F.size(vectors).cast("long")), _bytes(F.when(F.size(vectors) > 0, F.size(vectors[0])).otherwise(dimensions).cast("long")), body))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of vector files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def problem(content: Column) -> Column:
    """Why a file can't be decoded, or null."""
    size = F.octet_length(content)
    wanted = F.lit(HEADER) + _unsigned(F.substring(content, 1, 4)) * _unsigned(F.substring(content, 5, 4)) * WIDTH
    return F.when(size < HEADER, "vectors file is too short").when(size < wanted, F.concat(F.lit("vectors file truncated (expected "), wanted.cast("string"), F.lit(" bytes, got "), size.cast("string"), F.lit(")")))


def decoded(files: DataFrame) -> DataFrame:
    """(path, ordinal, embedding) of files (path, content) that can be decoded.

    A file's content is cut into its vectors before they become rows, so that a
    row carries its own bytes only.
    """
    n, d = _unsigned(F.substring("content", 1, 4)), _unsigned(F.substring("content", 5, 4))
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.col("content").substr((F.lit(HEADER + 1) + k * d * WIDTH).cast("int"), (d * WIDTH).cast("int"))))
    rows = files.where(problem(F.col("content")).isNull()).select("path", d.alias("d"), F.posexplode(cut).alias("ordinal", "raw"))
    value = F.transform(F.sequence(F.lit(0), F.col("d").cast("int") - 1), lambda i: to_float(F.col("raw").substr(i * WIDTH + 1, F.lit(WIDTH))))
    return rows.select("path", "ordinal", F.when(F.col("d") > 0, value).otherwise(F.array().cast("array<float>")).alias("embedding"))


def loaded(files: DataFrame, meta: DataFrame, unusable: Column) -> DataFrame:
    """(path, problem, name, embedding): vectors with the names that their file's ``meta`` (path, files, ...) lists, place by place.

    A file with a problem, its own, of its description (``unusable``, of the
    columns of ``meta``) or as the numbers of names and vectors differ, gives one
    row that says so.
    """
    count = _unsigned(F.substring("content", 1, 4))
    first = F.coalesce(unusable, problem(F.col("content")), F.when(F.size("files") != count, F.concat(F.lit("corrupt ("), F.size("files").cast("string"), F.lit(" file entries, "), count.cast("string"), F.lit(" vectors)"))))
    judged = files.join(meta, "path").withColumn("problem", first)
    bad = judged.where("problem is not null").select("path", "problem", F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<float>").alias("embedding"))
    good = judged.where("problem is null")
    names = good.select("path", F.posexplode("files").alias("ordinal", "name"))
    return bad.unionByName(decoded(good).join(names, ["path", "ordinal"]).select("path", F.lit(None).cast("string").alias("problem"), "name", "embedding"))
