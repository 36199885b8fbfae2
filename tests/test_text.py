import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()[0]


def test_terms(spark):
    assert one(spark, "what starts a pipeline execution when it is triggered", T.search_terms) == ["starts", "pipeline", "execution", "triggered"]
    assert one(spark, "the of a", T.search_terms) == ["the", "of", "a"]
    assert one(spark, 'Retry "pattern" retry!', T.query_terms) == ["Retry", "pattern"]
    assert one(spark, "!!!", T.query_terms) == []


def test_identifier_terms(spark):
    got = one(spark, "AccountService.getAccounts(ad_decision, HTTPServer, plain)", T.identifier_terms)
    assert " ".join(got) == "account service get accounts ad decision http server"


def test_tokens_and_ids(spark):
    assert one(spark, "", T.estimate_tokens) == 1
    assert one(spark, "abcde", T.estimate_tokens) == 2
    a = one(spark, "x", lambda v: T.chunk_id(F.lit("s"), F.lit("p"), v))
    assert len(a) == 16 and a != one(spark, "y", lambda v: T.chunk_id(F.lit("s"), F.lit("p"), v))


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("docs/**/*.md", "docs/a.md", True),
        ("docs/**/*.md", "docs/a/b/c.md", True),
        ("docs/**/*.md", "src/a.md", False),
        ("**/*.md", "a.md", True),
        ("src/**", "src/a/b", True),
        ("docs/*.md", "docs/a/b.md", False),
        ("docs", "docs/a/b.md", True),
        ("docs", "docs2/a.md", False),
        ("./X", "X", True),
        ("a[!b].c", "ad.c", True),
        ("a[!b].c", "ab.c", False),
        ("a?.c", "a/.c", False),
    ],
)
def test_globs(spark, pattern, path, hit):
    assert one(spark, path, lambda v: T.matches_glob(v, pattern)) is hit


def test_languages_and_test_paths(spark):
    assert one(spark, "src/A.KT", T.detect_language) == "kotlin"
    assert one(spark, "README", T.detect_language) is None
    for path, want in (("a/test/B.kt", True), ("a/latest/B.kt", False), ("a/FooTest.java", True), ("a/Testing.java", False)):
        assert one(spark, path, T.is_test_path) is want
