"""An index as a set of Parquet tables: what is read of the files, writing, state and removal."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import roles as R
from . import ignore, lexical


def walked(files: DataFrame, hidden: bool = False, rules: DataFrame | None = None) -> DataFrame:
    """Files that are indexed: no programs, nothing of the version control's own folder, no hidden files unless asked for, none that ``rules`` ignore."""
    if rules is not None:
        files = ignore.kept(files, rules)
    p = F.col("path")
    ignored = F.lower(p).rlike(r"\.(exe|dll|pdb)$") | p.rlike(r"(^|/)\.git(/|$)")
    return files.where(~ignored if hidden else ~ignored & ~p.rlike(r"(^|/)\.[^/]"))


def pruned(files: DataFrame) -> DataFrame:
    """Files that a line scan looks at: none under build, output and test-run folders."""
    return files.where(~F.col("path").rlike("(^|/)(" + "|".join(S.PRUNED_FOLDERS) + ")(/|$)") & ~F.col("path").contains("manual-test/"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size_bytes, modified_unix) of the files under a folder; paths are relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    # the qualified root is cut off as it stands; what comes before it is the file system's name
    path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return raw.select(F.substring(path, F.lit(len(whole) + 1), F.length(path)).alias("path"), "content", F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("modified_unix"))


def text_of(content: Column, path: Column) -> Column:
    """The text of a file: of a known language at any size, of others up to the limit; null if it is no UTF-8."""
    readable = R.language(path).isNotNull() | (F.octet_length(content) <= S.READ_LIMIT_BYTES)
    return F.when(readable & F.is_valid_utf8(content.cast("string")), content.cast("string"))


def indexed_files(files: DataFrame) -> DataFrame:
    """(path, role, size_bytes, content_hash, doc_length, terms) of files (path, text); large files have no hash and no terms."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    small = size <= S.READ_LIMIT_BYTES
    lex = lexical.lexical_rows(files.where(small & F.col("text").isNotNull()))
    rows = files.select("path", R.index_role(F.col("path")).alias("role"), size.cast("long").alias("size_bytes"), F.when(small & F.col("text").isNotNull(), F.xxhash64("text")).alias("content_hash"))
    return rows.join(lex, "path", "left")


def distinct_facts(facts: DataFrame, key: list[str]) -> DataFrame:
    """Symbols, edges or references without repeats; all columns that tell them apart are in the key."""
    return facts.dropDuplicates(key)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder, so that no use of it holds its plan; as it is where there is no such folder."""
    folder = shared_folder(df.sparkSession)
    if not folder:
        return df
    path = f"{folder}/facts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rust_facts(tree: DataFrame, fallback: DataFrame, edges: DataFrame) -> DataFrame:
    """Item-level symbols of Rust files, or those of any line if the former and the edges found nothing at all."""
    rust = F.col("path").endswith(".rs")
    some = tree.where(rust).select(F.lit(1).alias("x")).unionByName(edges.where(F.col("src").endswith(".rs")).select(F.lit(1).alias("x"))).agg(F.count("x").alias("n"))
    more = fallback.where(rust).join(F.broadcast(some)).where("n = 0").drop("n")  # one row
    return tree.unionByName(more)


def state(indexed_rev: Column, current_rev: Column, exists: Column) -> Column:
    """missing, fresh, stale, or unverifiable if there is no current revision."""
    return F.when(~exists, "missing").when(current_rev.isNull(), "unverifiable").when(indexed_rev.eqNullSafe(current_rev), "fresh").otherwise("stale")


def semantic_problem(version: int, model: str, dims: int, rev: str | Column | None) -> Column:
    """Why vectors described by (schema_version, model_name, dimensions, repo_rev) can't be used, or null; the first of these that differs."""
    c, now = F.col, rev if isinstance(rev, Column) else F.lit(rev).cast("string")
    stale = c("repo_rev").isNotNull() & now.isNotNull() & (c("repo_rev") != now)
    return F.when(c("schema_version") != version, "version").when((c("model_name") != model) | (c("dimensions") != dims), "model").when(F.coalesce(stale, F.lit(False)), "stale")


#: Folders that the postings are parted into by a hash of the term.
BUCKETS = 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share (spark.checkpoint.dir); a session in one process that names none gets a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there or not spark.sparkContext.master.startswith("local"):
        return there
    made = getattr(spark.sparkContext, "_lexigrove_folder", None) or tempfile.mkdtemp(prefix="lexigrove-")
    spark.sparkContext._lexigrove_folder = made
    return made


def revision(spark: SparkSession, source: DataFrame) -> str:
    """A name of the state of a table's files: their paths, lengths and times."""
    conf, jvm, seen = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm, []
    for name in sorted(source.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:24]


def stored(spark: SparkSession, source: DataFrame, files: DataFrame) -> Index | None:
    """The lexical index of ``files``, made from the table ``source``: the stored one while the table is as it was, else it is written first.

    It is written beside its place and then moved there, so a reader never sees
    a part of it. None where there is no folder to share.
    """
    folder = shared_folder(spark)
    if not folder:
        return None
    rev = revision(spark, source)
    index = Index(spark, f"{folder.rstrip('/')}/lexigrove-index-{rev}")
    if index.status(rev) != "fresh":
        draft = Index(spark, f"{index.folder}-{uuid.uuid4().hex}")
        draft.write_lexical(rev, files)
        fs, there = index._path()
        if not fs.rename(draft._path()[1], there) or fs.exists(there.suffix("/" + draft._path()[1].getName())):
            draft.clear()  # another session was first
    return index


@dataclass
class Index:
    """Tables of an index under one folder, each written as Parquet."""

    spark: SparkSession
    folder: str

    def write(self, rev: str | None, **tables: DataFrame) -> None:
        """Write the tables, then the revision they were made from.

        Tables with buckets of terms are parted by them and sorted, so that a
        query opens few folders and row groups; a term of very many files is
        dealt out over tasks by path.
        """
        for name, df in tables.items():
            by = [c for c in ("bucket", "term", "path") if c in df.columns]
            if "bucket" in by:
                df.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/{name}")
            else:
                (df.repartitionByRange("term").sortWithinPartitions("term") if "term" in by else df).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.spark.createDataFrame([(rev, S.INDEX_VERSION)], "rev string, schema_version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/meta")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write_lexical(self, rev: str | None, files: DataFrame) -> None:
        """Write what BM25 needs: each file's length and terms (the texts are read for these alone), then from them postings, frequencies and one row of counts."""
        lexical.lexical_rows(files).write.mode("overwrite").parquet(f"{self.folder}/files")
        rows = self.read("files")
        posts = rows.select("path", "doc_length", F.explode("terms").alias("x")).select("x.term", "path", "x.tf", "doc_length").withColumn("bucket", bucket(F.col("term")))
        self.write(
            rev,
            postings=posts,
            frequencies=posts.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")),
            stats=rows.agg(F.count(F.lit(1)).alias("lex_file_count"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length")),
        )

    def of_terms(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of some terms; only the folders of their buckets are opened."""
        return self.read(name).where(F.col("bucket").isin([bucket(F.lit(t)) for t in terms]) & F.col("term").isin(terms))

    def bm25(self, terms: list[str]) -> DataFrame:
        """The same as ``lexical.bm25`` from what is stored; no text is read."""
        wanted = list(dict.fromkeys(terms))
        if not wanted:
            wanted = [""]
        tf = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{i}") for i, t in enumerate(wanted)]
        files = self.of_terms("postings", wanted).groupBy("path", "doc_length").agg(*tf)
        df = self.of_terms("frequencies", wanted).agg(*[F.greatest(F.coalesce(F.max(F.when(F.col("term") == t, F.col("df"))), F.lit(1)), F.lit(1)).alias(f"df_{i}") for i, t in enumerate(wanted)])
        stats = self.read("stats").join(F.broadcast(df))  # one row each
        return lexical.bm25_of(files.join(F.broadcast(stats)), terms, wanted)

    def _path(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def status(self, rev: str | None) -> str:
        fs, path = self._path()
        if not fs.exists(path.suffix("/meta")):
            return "missing"
        meta = self.read("meta").select(state(F.col("rev"), F.lit(rev).cast("string"), F.lit(True)).alias("s")).first()
        return meta.s

    def clear(self) -> bool:
        fs, path = self._path()
        return fs.delete(path, True)
