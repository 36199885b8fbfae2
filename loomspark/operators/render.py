"""Packs as Markdown, and structure read from markup. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fence(text: Column) -> Column:
    """A code fence longer than any run of backticks in the text, of three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s#L%d-%d", path, start, end)


def markdown_packs(rows: DataFrame, buckets: tuple[str, ...] = ("norms", "expertise", "knowledge")) -> DataFrame:
    """(query_id, markdown) from included chunks (query_id, rank, bucket, path, start_line, end_line, text)."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, buckets)), F.col("bucket")), F.lit(len(buckets) + 1)).cast("int")
    mark = fence(F.col("text"))
    body = F.concat(F.lit("### "), citation(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit("\n"), mark, F.lit("\n"), F.col("text"), F.lit("\n"), mark)
    parts = rows.select("query_id", order.alias("place"), "rank", "bucket", body.alias("body"))
    sections = parts.groupBy("query_id", "place", "bucket").agg(F.array_sort(F.collect_list(F.struct("rank", "body"))).alias("own"))
    text = F.concat(F.lit("## "), F.col("bucket"), F.lit("\n\n"), F.array_join(F.transform("own", lambda x: x["body"]), "\n\n"))
    whole = sections.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))).alias("all"))
    return whole.select("query_id", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("markdown"))


def json_packs(rows: DataFrame) -> DataFrame:
    """(query_id, json) from included chunks (query_id, rank, bucket, path, start_line, end_line, tokens, text), keys in one order."""
    own = F.struct("rank", citation(F.col("path"), F.col("start_line"), F.col("end_line")).alias("citation"), "bucket", "tokens", "text")
    packs = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(own)).alias("chunks"), F.sum("tokens").alias("used_tokens"))
    return packs.select("query_id", F.to_json(F.struct("query_id", "used_tokens", F.array_distinct(F.transform("chunks", lambda c: c["bucket"])).alias("buckets"), "chunks")).alias("json"))


def page_structure(pages: DataFrame) -> DataFrame:
    """(page_id, lang, title, n_links, n_paragraphs) of HTML pages."""
    html = F.col("html")
    count = lambda pattern: F.regexp_count(html, F.lit(pattern)).cast("long")
    return pages.select(
        "page_id",
        F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"),
        count("<a href=").alias("n_links"),
        count("<p>").alias("n_paragraphs"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, target, n): link targets of HTML pages."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("page_id", "target").agg(F.count("*").alias("n"))
