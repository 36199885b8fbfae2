"""Pages over the tables: files, chunks, entities, sources; and the small tables that keep a corpus current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import is_test_path


def chunks_with_sources(chunks: DataFrame, sources: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Chunks with the type and bucket of their source, of the given types only."""
    known = sources.where(F.col("type").isin(*types)) if types else sources
    return chunks.join(known.select("source_id", F.col("type").alias("source_type")), "source_id")


def languages_filter(files: DataFrame, source_type: Column, language: Column, allowed: list[str]) -> DataFrame:
    """Files that a source takes: of code sources those in an allowed language, of others all."""
    return files.where((source_type != "code") | (language.isin(*allowed) if allowed else F.lit(True)))


def holding(column: Column, asked: str | None) -> Column:
    """Whether a column holds the asked text, letter case apart; nothing asked holds everywhere."""
    return F.contains(F.lower(column), F.lit(asked.lower())) if asked else F.lit(True)


def files_view(chunks: DataFrame, files: DataFrame, asked: str | None = None) -> DataFrame:
    """(path, source_id, chunks, tokens, kind, owner, test): files with what their entities (path, kind, owner) say."""
    own = chunks.where(holding(F.col("path"), asked)).groupBy("path").agg(F.min("source_id").alias("source_id"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    return own.join(files.select("path", "kind", "owner"), "path", "left").withColumn("test", is_test_path(F.col("path")))


def chunk_rows(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """(path, id, start_line, end_line, heading, tokens, embedded): chunks of files in order; no heading is an empty one."""
    done = embedded.select("id").distinct().withColumn("embedded", F.lit(True))
    out = chunks.join(done, "id", "left")
    return out.select("path", "id", "start_line", "end_line", F.coalesce("heading", F.lit("")).alias("heading"), "tokens", F.coalesce("embedded", F.lit(False)).alias("embedded"))


def file_texts(chunks: DataFrame) -> DataFrame:
    """(path, text, tokens): lower-cased texts of a file's chunks in the order of their lines; a file has a bounded size."""
    rows = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", F.lower("text").alias("text")))).alias("parts"), F.sum("tokens").alias("tokens"))
    return rows.select("path", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), "tokens")


def entity_list(entities: DataFrame, degrees: DataFrame, type_: str | None = None, asked: str | None = None) -> DataFrame:
    """(id, type, name, in_degree, out_degree) of entities of a type whose names hold a text."""
    rows = entities.where(holding(F.col("name"), asked) & (F.col("type") == type_ if type_ else F.lit(True)))
    zero = F.lit(0).cast("long")
    return rows.join(degrees, "id", "left").select("id", "type", "name", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def entity_chunks(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity, id): chunks of an entity's file that share a line with it; all of them if it has no lines."""
    near = entities.where("path is not null").select(F.col("id").alias("entity"), "path", F.col("start_line").alias("first"), F.col("end_line").alias("last")).join(chunks, "path")
    return near.where("first is null or last is null or (end_line >= first and start_line <= last)").select("entity", "id")


def mentioned_in(mentions: DataFrame, chunks: DataFrame, limit: int = 50) -> DataFrame:
    """(entity, id, path, place): the first chunks, by path and line, that mention an entity."""
    order = Window.partitionBy("entity").orderBy("path", "start_line", "id")
    rows = mentions.select("entity", "id").distinct().join(chunks.select("id", "path", "start_line"), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("entity", "id", "path", "place")


def counts_by(rows: DataFrame, **columns: str) -> DataFrame:
    """(what, value, n): counts of the values of several columns in one pass."""
    parts = F.array(*(F.struct(F.lit(what).alias("what"), F.col(c).cast("string").alias("value")) for what, c in columns.items()))
    return rows.select(F.inline(parts)).where("value is not null").groupBy("what", "value").agg(F.count("*").alias("n"))


def latest_sources(states: DataFrame, configured: DataFrame) -> DataFrame:
    """(source_id, ...): the latest state (by seq) of each source that is still configured."""
    columns = [c for c in states.columns if c != "source_id"]
    last = states.groupBy("source_id").agg(F.max_by(F.struct(*columns), "seq").alias("s"))
    return last.join(configured.select("source_id").distinct(), "source_id", "left_semi").select("source_id", "s.*")


def one_model(old: DataFrame, new: DataFrame, model: str) -> DataFrame:
    """Embeddings (id, model, vector) of one model: new ones replace old ones, other models' go."""
    old, new = old.where(F.col("model") == model), new.where(F.col("model") == model)
    return old.join(new.select("id").distinct(), "id", "left_anti").unionByName(new.dropDuplicates(["id"]))


def append_log(log: DataFrame, path: str) -> None:
    """Add rows of a query log, with their sources distinct and sorted."""
    log.withColumn("sources", F.array_sort(F.array_distinct("sources"))).write.mode("append").parquet(path)


def findings(log: DataFrame, chunks: DataFrame, sources: DataFrame, embedded: DataFrame, most: int, budget_share: float = 0.5, fallback_share: float = 0.3) -> DataFrame:
    """(finding, subject, n) about a log (mode, candidates, over_budget, sources), chunks and sources.

    Empty sources, sources never retrieved, a high share of fall-back answers, questions without candidates, packs that
    often meet their budget, chunks without a vector, and oversized chunks.
    """
    row = lambda df, name, subject="source_id", n="n": df.select(F.lit(name).alias("finding"), F.col(subject).cast("string").alias("subject"), F.col(n).cast("long").alias("n"))
    by_source = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    seen = log.select(F.explode("sources").alias("source_id")).distinct()
    totals = log.agg(F.count("*").alias("queries"), F.count_if(F.col("mode") == "any").alias("fallbacks"), F.count_if(F.col("candidates") == 0).alias("zero"), F.count_if(F.col("over_budget") > 0).alias("over"))
    totals = totals.withColumn("all", F.lit("log"))
    out = row(sources.join(by_source, "source_id", "left_anti").withColumn("n", F.lit(0)), "empty_sources")
    out = out.unionByName(row(by_source.join(seen, "source_id", "left_anti"), "never_retrieved"))
    out = out.unionByName(row(totals.where(F.col("fallbacks") > fallback_share * F.col("queries")), "fallback_rate", "all", "fallbacks"))
    out = out.unionByName(row(totals.where("zero > 0"), "zero_hits", "all", "zero"))
    out = out.unionByName(row(totals.where(F.col("over") > budget_share * F.col("queries")), "budget_ceiling", "all", "over"))
    out = out.unionByName(row(chunks.join(embedded.select("id").distinct(), "id", "left_anti").groupBy("source_id").agg(F.count("*").alias("n")), "embedding_gap"))
    return out.unionByName(row(chunks.where(F.col("tokens") > 1.5 * most).groupBy("source_id").agg(F.count("*").alias("n")), "oversized_chunks"))
