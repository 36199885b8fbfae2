"""Readers: the given tables, files of a repository as rows, and the corpus of chunks that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import detect_language, estimate_tokens, text_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer parts than there are cores (a small file of one row group, say) dealt to all cores; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def repository_files(spark: SparkSession, root: str, max_kb: int = 512) -> DataFrame:
    """(path, text, language, skipped) of all files below ``root``; skipped: 'too large' or 'binary' (a NUL among the first 8192 bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    large = F.lit(max_kb > 0) & (F.col("length") > max_kb * 1024)
    binary = F.locate("\0", F.decode(F.substring("content", 1, 8192), "ISO-8859-1")) > 0
    skipped = F.when(large, "too large").when(binary, "binary")
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.select(path.alias("path"), F.when(skipped.isNull(), F.decode("content", "UTF-8")).alias("text"), detect_language(F.col("path")).alias("language"), skipped.alias("skipped"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as chunks: id, source_id, path, bucket, text, tokens, hash."""
    docs = spread(table(spark, sf_dir, "documents"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md")))
    bucket = F.element_at(F.array(F.lit("knowledge"), F.lit("expertise"), F.lit("norms")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), path.alias("path"), bucket.alias("bucket"), "text", "lang", estimate_tokens(F.col("text")).alias("tokens"), text_hash(F.col("text")).alias("hash"))
