"""The pipeline over ``documents``: language ID, near-duplicates, surrogates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import read_table, write_out
from loomspark.llm.language_id import identify_languages, row_key
from loomspark.llm.mixing import mix_documents
from loomspark.llm.packing import pack_documents
from loomspark.llm.pii import replace_entities
from loomspark.llm.shingle_join import shingle_components

#: Words of a shingle and least similarity (per cent) of near-duplicates in this pipeline.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _rows(docs: DataFrame, **own: Column) -> DataFrame:
    """``docs`` as one struct, so that no column of it clashes with those of a stage."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))


def _columns(docs: DataFrame, **new: Column) -> list[Column]:
    return [new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known here; ``lang`` is the language found.

    Each row is judged by its own text, so of repeated ids with different texts only the rejected go. Null and empty texts
    and texts without letters are rejected; rows with a null id are judged like others; ties go to the first language by
    name; very long texts are judged whole; extra columns stay, whatever their names; an empty table gives an empty table.
    """
    k1, k2 = row_key()
    judged = identify_languages(docs, read_table(spark, sf_dir, "pages"), keyed=True).select("k1", "k2", "language", "kept")
    judged = write_out(judged, "judged").distinct()
    declared = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("lang").alias("declared"))
    # Rows that are rejected, or found in another language than they declare, are few against all.
    odd = judged.where("not kept").select("k1", "k2", "language", "kept")
    odd = odd.unionByName(judged.where("kept").join(declared, ["k1", "k2"]).where("declared is null or declared <> language").select("k1", "k2", "language", "kept"))
    odd = write_out(odd.distinct(), "odd")
    rows = _rows(docs, k1=k1, k2=k2).join(odd, ["k1", "k2"], "left").where("kept is null or kept")
    return rows.select(*_columns(docs, lang=F.coalesce("language", "row.lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id.

    Of rows that repeat an id one stays (that of the least text, then of the least row); rows with a null id, null, empty
    and very short texts without equals link with nothing and stay; very long texts are compared whole; extra columns
    stay, whatever their names; an empty table gives an empty table.
    """
    found = shingle_components(docs, k=SHINGLE_WORDS, percent=SIMILARITY)
    gone = write_out(found.where("component_id <> doc_id").select(F.col("doc_id").alias("own_id")).distinct(), "gone")
    repeated = write_out(docs.groupBy(F.col("doc_id").alias("own_id")).agg(F.count("*").alias("n")).where("n > 1 and own_id is not null").select("own_id"), "repeated")
    kept = _rows(docs, own_id=F.col("doc_id")).join(gone, "own_id", "left_anti")
    if repeated.limit(1).count():
        least = F.min(F.struct("row.text", "row")).alias("least")  # a partial aggregate: a hot id meets in no one task
        once = kept.join(repeated, "own_id", "left_semi").groupBy("own_id").agg(least).select("own_id", F.col("least.row").alias("row"))
        kept = kept.join(repeated, "own_id", "left_anti").unionByName(once)
    return kept.select(*_columns(docs))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, and their length; every row stays.

    A null text stays null, with a null length; empty and very long texts are taken whole; rows with a null id are replaced
    like others; repeated rows get equal texts; extra columns stay, whatever their names; an empty table gives an empty
    table.
    """
    out = replace_entities(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the domains say.

    Null and empty texts have no tokens and are copied by their posteriors' rate; rows with a null id are rated like
    others; repeated rows get equal rates and equal fates; very long texts are read whole; extra columns stay, whatever
    their names; without labels of two domains every row stays once; an empty table gives an empty table.
    """
    return mix_documents(docs, read_table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences.

    Null and empty texts are one piece with the end id; very long texts are cut into pieces; rows with a null or repeated
    id are packed each; extra columns are ignored; an empty table gives an empty table.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("surrogates", replace_personal_data),
    ("mixing", mix_to_targets),
    ("packing", pack),
]

#: The stages' classifiers, tokenizer and genetic algorithm are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_out(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
