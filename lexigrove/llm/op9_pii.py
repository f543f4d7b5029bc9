"""Personal data and the terms that give it away, in built-in functions only.

Base detectors find emails, addresses, card and phone numbers. Each found value
is a protected entity. Over the whole corpus, the pointwise mutual information
of an entity and a term of the same text, as a share of the entity's own
information, is the term's disclosure: 1 means that the term occurs only with
the entity. Terms at or over the threshold with enough documents behind them are
generalised wherever they stand, also in texts without the entity, together with
the base spans (``term`` spans). A term is any whole word with a letter in it:
letters and digits, hyphens between them, of every length; support decides.

Entities of the same texts are compared once, and so are terms of the same
texts. Texts with very many entities and terms are left out of the search for
pairs, but not of the counts: a pair meets in another text, or both its sides
are in SUPPORT of these.

Null or empty texts: no spans, one row. Null ids: each row keeps its own spans.
Repeated rows count once for each (id, text) and get a row each. Ties: spans at
one start are in the order of KINDS. Very long texts are scanned whole;
positions are folded in blocks. An entity in every document carries no
information and discloses nothing. Empty table: no rows. Other columns of the
input are not looked at, and ``redacted`` keeps them, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import cut, table

#: Possessive repeats and the guards before them only keep the matcher from scanning a run twice;
#: what they match is what the plain patterns match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
WORD = r"(?=[\p{N}-]*+\p{L})[\p{L}\p{N}]++(?:-[\p{L}\p{N}]++)*+"
TERM = rf"(?<![\p{{L}}\p{{N}}@._%+-]){WORD}(?![\p{{L}}\p{{N}}@_%+-])"
#: Documents that a pair needs, and the share of the entity's information.
SUPPORT, DISCLOSURE = 3, 0.9
#: Candidate terms up to this many are sent to all tasks; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Entities times terms of a text from which it is one of the large ones, whose pairs are dealt into SALTS tasks.
LARGE, SALTS = 2_000_000, 32


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(places, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Sorted tagged spans of the four base detectors."""
    email = S.find(text, EMAIL, text.contains("@") & text.rlike(EMAIL))
    ip = F.filter(S.find(text, IP), lambda x: F.forall(F.split(x["m"], r"\."), lambda p: p.rlike(OCTET)))
    runs = S.find(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    card = F.filter(runs, lambda x: F.when(F.length(_digits(x["m"])).between(14, 19), _luhn(_digits(x["m"]))).otherwise(False))
    phone = F.filter(S.find(text, PHONE, text.contains("+") & text.rlike(PHONE)), lambda x: F.length(_digits(x["m"])).between(10, 15))
    return F.array_sort(F.concat(*(S.tagged(x, KINDS[i], i) for i, x in enumerate((email, ip, card, phone)))))


def _words(text: Column) -> Column:
    """The distinct terms of a text as they are written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def _kinds_of(postings: DataFrame, name: str, n: str) -> tuple[DataFrame, DataFrame]:
    """(name, n, head) of everything in at least SUPPORT texts, and (head, n): those of the same texts share a head."""
    texts = (F.bit_xor(F.xxhash64("_row")).alias("_x"), F.sum(F.xxhash64("_row", F.lit(1)).cast("decimal(38,0)")).alias("_y"))
    known = cut(postings.groupBy(name).agg(F.count(F.lit(1)).alias(n), *texts).where(F.col(n) >= SUPPORT))
    heads = known.groupBy(n, "_x", "_y").agg(F.min(name).alias("head"))
    known = cut(known.join(heads, [n, "_x", "_y"]).select(name, n, "head"))
    return known, known.where(F.col(name) == F.col("head")).select(name, n)


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, disclosure) of the pairs at or over the threshold; of entities of the same texts only the first.

    ``found``: (_row, entities, terms) of the texts with entities. Document
    frequencies of the candidate terms are taken over all texts.
    """
    n = F.lit(float(max(docs.count(), 1)))
    own = F.log(n / F.col("n_entity"))

    def share(n_both: Column, n_term: Column) -> Column:
        return F.log(n * n_both / (F.col("n_entity") * n_term)) / own

    large = F.size("entities").cast("long") * F.size("terms") > LARGE
    entities = found.select("_row", large.alias("large"), F.explode("entities").alias("entity"))
    terms = found.select("_row", large.alias("large"), F.explode("terms").alias("term"))
    _, entity_heads = _kinds_of(entities, "entity", "n_entity")
    known_terms, term_heads = _kinds_of(terms, "term", "n_near")
    entities = entities.join(_few(entity_heads.where(own > 0)), "entity")
    terms = terms.join(_few(term_heads), "term")
    # a pair is in no more documents than either of its sides, and a term is in no fewer than it is beside an entity in
    possible = share(F.least("n_entity", "n_near"), F.col("n_near")) >= DISCLOSURE
    pair = ["entity", "term", "n_entity", "n_near"]
    count = lambda name: F.count(F.lit(1)).alias(name)
    both = entities.where("not large").drop("large").join(terms.where("not large").drop("large"), "_row").where(possible).groupBy(*pair).agg(count("n_both"))
    if found.where(large).limit(1).count():
        both = _with_large(cut(both), entities.where("large").drop("large"), terms.where("large").drop("large"), possible, pair)
    both = both.where((F.col("n_both") >= SUPPORT) & (share(F.col("n_both"), F.col("n_near")) >= DISCLOSURE))
    both = cut(both.withColumnRenamed("term", "head").join(known_terms.select("head", "term"), "head").drop("head"))
    terms = cut(both.select("term").distinct())
    words = docs.select(F.explode(F.array_distinct(F.transform(_words(F.col(text_col)), F.lower))).alias("term"))
    # terms that fit into every task meet the words where they are; otherwise words are counted before anything is shuffled
    few = terms.count() <= BROADCAST_TERMS
    df = words.join(F.broadcast(terms), "term").groupBy("term").agg(count("n_term")) if few else words.groupBy("term").agg(count("n_term")).join(terms, "term")
    disclosure = share(F.col("n_both"), F.greatest("n_term", "n_near"))
    return both.join(df, "term").select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def _with_large(both: DataFrame, entities: DataFrame, terms: DataFrame, possible: Column, pair: list[str]) -> DataFrame:
    """``both``, the counts over texts that aren't large, with those of the large ones added.

    A pair of ``both`` is looked up in the large texts of its entity. A pair that
    is in none but large ones has both its sides in SUPPORT of them.
    """
    in_large = lambda df, name: df.groupBy(name).agg(F.count(F.lit(1)).alias(f"{name}_large"))
    of_entity, of_term = cut(in_large(entities, "entity")), cut(in_large(terms, "term"))
    reach = F.col("n_both") + F.least(F.coalesce("entity_large", F.lit(0)), F.coalesce("term_large", F.lit(0)))
    met = cut(both.join(of_entity, "entity", "left").join(of_term, "term", "left").where(reach >= SUPPORT))
    looked = met.where("entity_large > 0 and term_large > 0").select("entity", "term").join(entities.select("entity", "_row"), "entity").join(terms.select("term", "_row"), ["term", "_row"])
    more = looked.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_more"))
    met = met.join(more, ["entity", "term"], "left").select(*pair, (F.col("n_both") + F.coalesce("n_more", F.lit(0))).alias("n_both"))
    left = entities.join(of_entity.where(F.col("entity_large") >= SUPPORT), "entity").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = terms.join(of_term.where(F.col("term_large") >= SUPPORT), "term").withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    only = left.join(right, ["_row", "_salt"]).where(possible).groupBy(*pair).agg(F.count(F.lit(1)).alias("n_both"))
    return met.unionByName(only.join(both, ["entity", "term"], "left_anti"))


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(_row, _more): every place of ``terms`` in the (_row, _text) that have some, as tagged spans."""
    flagged = _few(terms)
    words = texts.select("_row", F.explode(_words(F.col("_text"))).alias("word"))
    hits = cut(words.join(flagged, F.lower("word") == F.col("term")).select("_row").distinct())
    # always by shuffle, so that disk grows with the input and not by a change of plan
    placed = texts.join(hits.hint("merge"), "_row").dropDuplicates(["_row"]).select("_row", F.explode(S.find(F.col("_text"), TERM)).alias("x"))
    own = placed.join(flagged, F.lower("x.m") == F.col("term")).groupBy("_row").agg(F.collect_list("x").alias("x"))
    return own.select("_row", S.tagged(F.col("x"), "term", KINDS.index("term")).alias("_more"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, id, base, all_spans) of every row: base spans, and disclosing terms beside them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(S.row_key(F.col(id_col), text).alias("_row"), text.alias("_text"))
    found = docs.select(F.col(id_col).alias("doc_id"), S.row_key(F.col(id_col), text).alias("_row"), base_spans(text).alias("base"), text.alias("_text"))
    beside = F.when(F.size("base") > 0, F.array_distinct(F.transform(_words(S.replaced(F.col("_text"), F.col("base"), lambda x: F.lit("@"))), F.lower)))
    found = cut(found.withColumn("terms", beside).drop("_text"))
    entities = F.array_distinct(F.transform("base", lambda b: F.sha2(F.concat(b["kind"], F.lit(":"), b["m"]), 256)))
    private = cut(found.where("size(base) > 0").select("_row", entities.alias("entities"), "terms").dropDuplicates(["_row"]))
    flagged = cut(disclosing(docs, private, text_col).select("term").distinct())
    spans = occurrences(texts, flagged)
    empty = F.filter("base", lambda x: F.lit(False))
    return found.join(spans, "_row", "left").select("_row", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce(S.apart(F.col("_more"), F.col("base")), empty))).alias("all_spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping sorted spans replaced by the tag of its first."""
    return S.replaced(text, spans, lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in the text, other columns as they were.

    Only rows with spans are joined; a null text stays null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = sanitise(docs.select(id_col, text_col), id_col, text_col).where("size(all_spans) > 0").select("_row", "all_spans").dropDuplicates(["_row"])
    # the row is carried as one struct, so that no name of its columns can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), S.row_key(F.col(id_col), text).alias("_row"))
    own = F.col("doc")[text_col]
    fresh = F.when(F.col("all_spans").isNull(), own).otherwise(redact(own, F.col("all_spans")))
    return rows.join(spans, "_row", "left").select(F.col("doc").withField(f"`{text_col}`", fresh).alias("doc")).select("doc.*")


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", *(n(k) for k in KINDS[:4]), F.sha2(S.digest(F.col("base")), 256).alias("base_sha256"), S.digest(F.col("all_spans")).alias("spans")
    )
