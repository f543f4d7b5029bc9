"""Secret scan with corpus-wide ownership frequency, in built-in functions only.

Base detectors find assignments, access keys and long hex strings. The values
of assignments and access keys are learnt, and every run of the value alphabet
that equals one is a use of it, with no assignment needed beside it. All uses
are counted over the corpus by distinct repositories and distinct owners: a
value that many of either hold is a widely copied example (or an ordinary
word), one that few hold looks live. Bare uses of live values are added as
``reuse`` spans.

Null or empty texts: no spans, one row. Null ids: a repository of their own,
each row keeping its own spans. Null owner or repository: counted as one unnamed
owner. Repeated rows count once for each distinct repository and owner and get
a row each. Ties: spans at one start are in the order of KINDS. Very long texts
are scanned whole; positions are folded in blocks. Empty table: no rows. Other
columns of the input are not looked at, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import cut, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: A maximal run shorter than asked fails from each of its starts, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What a bare use can look like: a whole run of the value alphabet; a full stop or hyphen at its end belongs to the sentence.
LEAST = 8
RUN = rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}"
TAIL = r"[.-]+$"
KINDS = ("assign", "access", "hex", "reuse")
#: A value held by so many owners, or in so many repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20
#: Learnt values up to this many are sent to all tasks; more are joined by a shuffle.
BROADCAST_VALUES = 100_000


def value_of(kind: Column, match: Column) -> Column:
    """The credential inside a match."""
    return F.regexp_replace(F.when(kind == "assign", F.regexp_replace(match, ASSIGN_VALUE, "")).otherwise(match), TAIL, "")


def base_spans(text: Column) -> Column:
    """Sorted tagged spans of the three base detectors."""
    assign = F.filter(S.find(text, ASSIGN), lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_VALUE, "")) >= 8)
    access = S.find(text, ACCESS, text.contains("AKIA"))
    long_hex = S.find(text, HEX)
    return F.array_sort(F.concat(*(S.tagged(x, KINDS[i], i) for i, x in enumerate((assign, access, long_hex)))))


def _trimmed(run: Column) -> Column:
    return F.regexp_replace(run, TAIL, "")


def runs(text: Column) -> Column:
    """The distinct candidate runs of a text."""
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), _trimmed)), lambda r: F.length(r) >= LEAST)


def hashed(value: Column) -> Column:
    return F.sha2(value, 256)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_VALUES else df


def ownership(uses: DataFrame) -> DataFrame:
    """(value, repos, owners) of (value, repo, owner) rows, over the whole corpus.

    Distinct (value, repository) and (value, owner) rows are made before and
    after the shuffle, so a value in a third of all rows is no hot key.
    """
    repos = uses.select("value", "repo").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("repos"))
    owners = uses.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    return repos.join(owners, "value")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row a document: ``base`` and ``all_spans`` (tagged, sorted), ``n_live`` and ``n_example``.

    ``n_live`` counts base spans whose value fewer than EXAMPLE_OWNERS owners
    and EXAMPLE_REPOS repositories hold, ``n_example`` the others. ``reuse``
    spans are bare uses of live learnt values; they are in ``all_spans`` besides
    all base spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    who = [F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner")]
    key = S.row_key(F.col(id_col), text).alias("_row")
    found = cut(docs.select(F.col(id_col).alias("doc_id"), key, *who, base_spans(text).alias("base")))
    base = found.select("_row", "repo", "owner", F.explode("base").alias("x")).withColumn("m", value_of(F.col("x.kind"), F.col("x.m")))
    base = base.select("_row", "repo", "owner", hashed(F.col("m")).alias("value"), ((F.col("x.kind") != "hex") & (F.length("m") >= LEAST)).alias("learnt"), F.col("x.s").alias("s"), F.col("x.k").alias("k"))
    learnt = _few(cut(base.where("learnt").select("value").distinct()))
    bare = docs.select(key, *who, F.explode(runs(text)).alias("run")).withColumn("value", hashed(F.col("run")))
    bare = cut(bare.join(learnt, "value").select("_row", "repo", "owner", "value", "run"))
    counted = cut(ownership(base.select("value", "repo", "owner").unionByName(bare.select("value", "repo", "owner"))))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    known = _few(counted.select("value", example.alias("example")))
    placed = base.select("_row", "s", "k", "value").distinct()  # repeated rows have one key
    verdicts = placed.join(known, "value").groupBy("_row").agg(F.count(F.when(~F.col("example"), 1)).alias("n_live"), F.count(F.when(F.col("example"), 1)).alias("n_example"))
    live = bare.join(known.where("not example"), "value").select("_row", "run").distinct()
    # only texts with live uses are read again; their runs with places meet the uses of the same text
    texts = docs.select(key, text.alias("_text")).join(live.select("_row").distinct(), "_row").dropDuplicates(["_row"])
    places = texts.select("_row", F.explode(S.find(F.col("_text"), RUN)).alias("x")).select("_row", "x.s", _trimmed(F.col("x.m")).alias("run"))
    span = F.struct(F.col("s"), (F.col("s") + F.length("run")).cast("int").alias("e"), F.col("run").alias("m"))
    reused = places.join(live, ["_row", "run"]).groupBy("_row").agg(S.tagged(F.collect_list(span), "reuse", KINDS.index("reuse")).alias("_more"))
    nothing = F.filter("base", lambda x: F.lit(False))
    return found.join(verdicts, "_row", "left").join(reused, "_row", "left").select(
        "doc_id",
        "base",
        F.array_sort(F.concat("base", F.coalesce(S.apart(F.col("_more"), F.col("base")), nothing))).alias("all_spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def op8_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(S.digest(F.col("base")), 256).alias("base_sha256"), S.digest(F.col("all_spans")).alias("spans"), "n_live", "n_example")
