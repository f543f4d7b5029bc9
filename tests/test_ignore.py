"""Ignore rules, and the lexical index as it is stored and read."""

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import ignore as O
from lexigrove.operators import index as K
from lexigrove.operators import lexical as L
from lexigrove.operators import rank as R


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def left(spark, paths, rules):
    table = files(spark, dict.fromkeys(paths, "") | rules)
    return {r.path for r in O.kept(table, O.rules(table)).collect() if r.path in paths}


def test_nested_ignore_files(spark):
    assert left(spark, ["nested/src/keep.rs", "nested/ignored/skip.rs", "ignored/other.rs"], {"nested/.rgignore": "ignored/\n"}) == {"nested/src/keep.rs", "ignored/other.rs"}


@pytest.mark.parametrize(
    ("rules", "gone"),
    [
        ({".gitignore": "*.o"}, {"a.o", "d/b.o", "d/e/c.o"}), ({".gitignore": "/*.o"}, {"a.o"}), ({".gitignore": "d/*.o"}, {"d/b.o"}), ({".gitignore": "d/**/*.o"}, {"d/b.o", "d/e/c.o"}), ({".gitignore": "**/e"}, {"d/e/c.o"}),
        ({".gitignore": "d/"}, {"d/b.o", "d/e/c.o"}), ({".gitignore": "a.o/"}, set()), ({".gitignore": "*.o\n!b.o"}, {"a.o", "d/e/c.o"}), ({".gitignore": "d/\n!d/b.o"}, {"d/b.o", "d/e/c.o"}), ({".gitignore": "!b.o\n*.o"}, {"a.o", "d/b.o", "d/e/c.o"}),
        ({".gitignore": "*.o", "d/.gitignore": "!*.o"}, {"a.o"}), ({".ignore": "!*.o", "d/.gitignore": "*.o"}, set()), ({".gitignore": "!*.o", ".rgignore": "?.o"}, {"a.o", "d/b.o", "d/e/c.o"}), ({".gitignore": "[ac].o"}, {"a.o", "d/e/c.o"}),
        ({".gitignore": "[!a].o"}, {"d/b.o", "d/e/c.o"}), ({".gitignore": "# *.o\n\n  \n\\#x"}, {"#x"}), ({".gitignore": "d/e/**"}, {"d/e/c.o"}), ({".gitignore": "a.o  \r\n"}, {"a.o"}), ({".gitignore": "a+o\na.O"}, set()), ({"d/.gitignore": "/e"}, {"d/e/c.o"}), ({}, set()),
    ],
)
def test_rules(spark, rules, gone):
    paths = {"a.o", "d/b.o", "d/e/c.o", "#x"}
    assert paths - left(spark, sorted(paths), rules) == gone


def test_walked_files(spark):
    table = files(spark, {"a.rs": "", ".hidden/x.rs": "", "out/b.rs": "", ".gitignore": "out", "c.exe": "", "null.rs": None})
    assert {r.path for r in K.walked(table, rules=O.rules(table)).collect()} == {"a.rs", "null.rs"}
    assert O.rules(files(spark, {"a": ""})).count() == 0 and O.ignored(table.where("path = ''"), O.rules(table)).count() == 0


def test_read_files_cut_the_root_as_it_stands(spark, tmp_path):
    root = tmp_path / "data" / "x+y" / "data"
    (root / "data").mkdir(parents=True)
    (root / "data" / "f.rs").write_text("fn f() {}")
    (root / "g.rs").write_text("x")
    for name in (str(root), f"{root}/", f"file://{root}"):
        assert {r.path for r in K.read_files(spark, name).collect()} == {"data/f.rs", "g.rs"}


def test_a_stored_index_scores_like_the_texts(spark, tmp_path):
    words = "alpha beta gamma delta apple license version the core".split()
    rows = [(f"src/f{i}.rs", " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 40)) if i % 11 else None) for i in range(200)]
    spark.createDataFrame(rows, "path string, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    index = K.stored(spark, table, table)
    assert index.status(K.revision(spark, table)) == "fresh" and K.stored(spark, table, table).folder == index.folder
    for terms in (["alpha"], ["license", "version", "license"], ["nowhere"], ["nowhere", "core"], []):
        score = lambda df: sorted((r.path, round(r.score, 9), r.lex_file_count, r.lexical_terms) for r in df.collect())
        assert score(index.bm25(terms)) == (score(L.bm25(table, terms)) if terms else [])
    plan = index.bm25(["alpha", "beta"])._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Physical Plan ==")[1] and "PartitionFilters: [bucket" in plan
    lines = table.select("path", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_number"), "line")
    assert R.find_indexed(lines, table, "license version", index=index).collect() == R.find_indexed(lines, table, "license version").collect()
    table.limit(5).write.mode("append").parquet(f"{tmp_path}/t")
    again = spark.read.parquet(f"{tmp_path}/t")
    assert K.stored(spark, again, again).folder != index.folder  # the table has changed
    assert index.clear() and index.status("x") == "missing"
