"""Queries over the stored inverted index: built from the corpus, then searched for all questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import search
from loomspark.operators.index import InvertedIndex, search_lists
from loomspark.plans.oracles import _CORPUS, _HITS, _shown, _top
from loomspark.plans.oracles import ORACLE_SQL as PLAIN
from loomspark.sources.shared import shared_folder
from loomspark.sources.tables import corpus, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _terms(spark, d):
    return search.question_terms(table(spark, d, "benchmark"), "item_id")


def _built(spark, d):
    index = InvertedIndex(spark, shared_folder(spark, "index"))
    index.ingest(corpus(spark, d), name="corpus")
    return index


@query
def index_top10(spark, d):
    """The ten best documents of each question, from the index."""
    return _built(spark, d).top_k(_terms(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query
def index_mode_rrf(spark, d):
    """Strict and loose lists of the index, fused."""
    return search_lists(_built(spark, d), _terms(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"), "rank", "mode")


@query
def index_after_ingest(spark, d):
    """The ten best after a second ingest: documents of one bucket, indexed by their paths at first, get their texts, and Spanish ones go."""
    rows = corpus(spark, d)
    index = InvertedIndex(spark, shared_folder(spark, "index"))
    index.ingest(rows.withColumn("text", F.when(F.col("bucket") == "norms", F.col("path")).otherwise(F.col("text"))), name="first")
    index.ingest(rows.where("bucket = 'norms' AND lang <> 'es'"), rows.where("lang = 'es'").select("id"), "second")
    return index.top_k(_terms(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


ORACLE_SQL: dict[str, str] = {
    "index_top10": PLAIN["bm25_loose"],
    "index_mode_rrf": PLAIN["bm25_mode_rrf"],
    "index_after_ingest": f"WITH {_HITS} ".replace(_CORPUS, _CORPUS.replace("FROM documents)", "FROM documents WHERE lang <> 'es')")) + _shown(_top("hits", 10)),
}
