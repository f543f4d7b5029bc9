import pytest
from pyspark.sql import functions as F

from lexigrove.functions import globs, roles
from lexigrove.functions import text as T


def values(spark, inputs, build):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_terms_split_cases_digits_and_separators(spark):
    got = values(spark, ["HTTPServer2Go", "snake_case-kebab/path.rs", "a::b", "x", "", None, "main()\nnext"], T.terms)
    assert got == [["http", "server", "go"], ["snake", "case", "kebab", "path", "rs"], [], [], [], None, ["main()\nnext"]]


def test_lexical_terms_drop_short_and_digits(spark):
    assert values(spark, ["ab abc 1234 a1234b"], T.lexical_terms) == [["abc", "1234"][:1]]


def test_singular(spark):
    words = ["cities", "boxes", "classes", "bus", "buses", "glass", "cats", "matches", "dishes"]
    assert values(spark, words, T.singular) == ["city", "bo", "clas", "bus", "bu", "glass", "cat", "mat", "di"]


def test_phrase_squash_shorten(spark):
    assert values(spark, ["  Big\t Red\n Dog "], T.normalize_phrase) == ["big red dog"]
    assert values(spark, ["A-b_C 1é"], T.squash) == ["abc1"]
    assert values(spark, ["x" * 10, "x" * 11], lambda c: T.shorten(c, 10)) == ["x" * 10, "x" * 7 + "..."]


@pytest.mark.parametrize(
    ("path", "role"),
    [
        ("tests/a.rs", "source"), ("src/latest_x.rs", "test"), ("a.test.ts", "source"), ("src/config.rs", "config"), ("x/generated/a.md", "generated"),
        ("Cargo.lock", "lockfile"), ("docs/a.md", "doc"), ("a/docs/b.bin", "doc"), ("a/src/b.bin", "source"), ("b.bin", "other"), ("site/x/index.html", "generated"), ("x.jsonc", "config"),
    ],
)
def test_index_role(spark, path, role):
    assert values(spark, [path], roles.index_role) == [role]


def test_rank_role_differs(spark):
    assert values(spark, ["x.jsonc", "my_lib.bin"], roles.rank_role) == ["other", "source"]


def test_area_and_language(spark):
    assert values(spark, ["src/a/b.rs", "src/a.rs", "packages/p/x.ts", "web/x.ts"], roles.area_key) == ["src/a", "src", "packages/p", "web"]
    assert values(spark, ["a.rs", "a.mts", "a.tsx", "a.cjs", "a.txt"], roles.language) == ["rust", "typescript", "tsx", "javascript", None]


def test_globs(spark):
    paths = ["src/a.css", "a.css", "src/x/b.css", "src/x/b.ts"]
    assert values(spark, paths, lambda c: globs.kept(c, ["*.css"])) == [True, True, True, False]
    assert values(spark, paths, lambda c: globs.kept(c, ["src/**/*.css"])) == [True, False, True, False]
    assert values(spark, paths, lambda c: globs.kept(c, [], ["src/x/*"])) == [True, True, False, False]
    assert values(spark, paths, lambda c: globs.kept(c, ["*.{ts,js}"])) == [False, False, False, True]


def test_round2(spark):
    df = spark.range(1).select(T.round2(F.lit(0.285)), T.round2(F.lit(-0.125)))
    assert tuple(df.first()) == (0.28, -0.13)


def test_test_stem(spark):
    assert values(spark, ["tests/session_test.rs", "test_a.py", "x/b.test.ts", ".env"], T.test_stem) == ["session", "a", "b", ".env"]
