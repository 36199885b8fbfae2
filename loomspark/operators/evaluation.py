"""Measuring retrieval: questions with expected paths and entities against packs and candidates, all questions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that make an expectation a glob, and how a fact cites a place.
GLOB_MARKS = r"[*?\[]"
CITED = r"(?<![\w/.-])([\w./-]+\.\w+)#L\d+"


def with_tags(questions: DataFrame, tags: list[str]) -> DataFrame:
    """Questions that carry one of the tags; all of them if none is asked for."""
    return questions.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else questions


def path_matches(expected: Column, path: Column, regex: Column | None = None) -> Column:
    """Whether a path is the expected one or ends in it; a glob matches by ``regex``, its translation."""
    plain = (path == expected) | path.endswith(F.concat(F.lit("/"), expected))
    return plain if regex is None else F.when(expected.rlike(GLOB_MARKS), F.rlike(path, regex)).otherwise(plain)


def cited_paths(fact: Column) -> Column:
    return F.regexp_extract_all(fact, F.lit(CITED), F.lit(1))


def fact_names(facts: Column) -> Column:
    """The names that an array of facts is about."""
    return F.transform(facts, lambda f: F.lower(F.trim(F.substring_index(f, " — ", 1))))


def entity_present(expected: Column, facts: Column, headings: Column) -> Column:
    """Whether an entity is the subject of a fact (or its owner or member), or part of a heading."""
    e = F.lower(expected)
    by_fact = F.exists(fact_names(facts), lambda n: (n == e) | n.startswith(F.concat(e, F.lit("."))) | n.endswith(F.concat(F.lit("."), e)))
    parts = F.flatten(F.transform(headings, lambda h: F.transform(F.split(F.lower(h), " > "), lambda p: F.trim(p))))
    return by_fact | F.exists(parts, lambda p: (p == e) | p.endswith(F.concat(F.lit("."), e)))


def expectation_hits(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, group, hit) of expectations (query_id, group, expected) against paths (query_id, path).

    Expectations of one group are alternatives: the group counts once, and is met by any of them.
    """
    pairs = expected.join(found.select("query_id", "path").distinct(), "query_id").where(path_matches(F.col("expected"), F.col("path")))
    met = pairs.select("query_id", "group").distinct().withColumn("hit", F.lit(1))
    return expected.select("query_id", "group").distinct().join(met, ["query_id", "group"], "left").select("query_id", "group", F.coalesce("hit", F.lit(0)).alias("hit"))


def question_recalls(expected: DataFrame, packed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, total, in_pack, in_candidates, cut): what of the expected was packed, was found, was found but cut."""
    both = expectation_hits(expected, packed).withColumnRenamed("hit", "p").join(expectation_hits(expected, candidates).withColumnRenamed("hit", "c"), ["query_id", "group"])
    return both.groupBy("query_id").agg(F.count("*").alias("total"), F.sum("p").alias("in_pack"), F.sum("c").alias("in_candidates"), F.sum(F.when((F.col("c") == 1) & (F.col("p") == 0), 1).otherwise(0)).alias("cut"))


def report(recalls: DataFrame) -> DataFrame:
    """One row: questions, mean recalls to three places (half to even), expectations cut and not found."""
    mean = lambda x: F.bround(F.avg(F.col(x) / F.col("total")), 3)
    return recalls.agg(F.count("*").alias("questions"), mean("in_pack").alias("path_recall"), mean("in_candidates").alias("candidate_recall"), F.sum("cut").alias("cut"), F.sum(F.col("total") - F.col("in_candidates")).alias("not_found"))
