"""Loaders as table functions: each turns a file into chunks by a lateral join, and is chosen by the type of the file's source.

A loader is a class whose ``eval(path, text)`` yields (start_line, end_line, heading, body); ``analyze`` gives the columns, and
says before any task runs what is wrong with a call. Those here cut Markdown, prose and code; others are added by name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from loomspark.functions.text import chunk_id, detect_language, estimate_tokens, identifier_terms, text_hash
from loomspark.operators.chunking import chunk_spans, lines_of
from loomspark.operators.code_chunks import code_spans, python_blocks

CHUNK = StructType().add("start_line", IntegerType()).add("end_line", IntegerType()).add("heading", StringType()).add("body", StringType())


class Loader:
    """A loader's frame: subclasses give ``spans(path, text)``, (first line, last line, heading) from 1."""

    @staticmethod
    def analyze(path: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        for argument in (path, text):
            if not isinstance(argument.dataType, StringType):
                raise ValueError("a loader takes the path and the text of a file, both strings")
        return AnalyzeResult(CHUNK)

    def eval(self, path: str, text: str | None) -> Iterator[tuple[int, int, str, str]]:
        lines = lines_of(text or "")
        for a, b, heading in self.spans(path, text or ""):
            yield a, b, heading, "\n".join(lines[a - 1 : b])


class MarkdownLoader(Loader):
    def spans(self, path: str, text: str):
        return chunk_spans(text, headings=True)


class TextLoader(Loader):
    def spans(self, path: str, text: str):
        return chunk_spans(text, headings=False)


class CodeLoader(Loader):
    """Python by its blocks, all else by windows (``code_chunks`` cuts brace languages, whose declarations are a table)."""

    def spans(self, path: str, text: str):
        return code_spans(text, python_blocks(lines_of(text)) if path.endswith(".py") else [])


class LoaderRegistry:
    """Loaders by source type, registered as SQL table functions ``load_<type>``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.loaders = spark, {}
        for name, loader in (("markdown", MarkdownLoader), ("text", TextLoader), ("code", CodeLoader)):
            self.register(name, loader)

    def register(self, source_type: str, loader: type) -> None:
        """Add a loader, or replace the one of that type."""
        self.loaders[source_type] = F.udtf(loader)
        self.spark.udtf.register(f"load_{source_type}", self.loaders[source_type])

    def load(self, files: DataFrame) -> DataFrame:
        """(id, source_id, path, language, start_line, end_line, heading, text, terms, tokens, hash) of files (source_id, source_type, path, text).

        Sources of a type without a loader raise; null and blank texts have no chunks.
        """
        types = [r[0] for r in files.select("source_type").distinct().collect()]  # a few, as configured
        unknown = sorted(str(t) for t in types if t not in self.loaders)
        if unknown:
            raise ValueError(f"no loader for sources of type {', '.join(unknown)}; there are {', '.join(sorted(self.loaders))}")
        out = None
        for t in sorted(types):
            rows = files.where(F.col("source_type") == t).select("source_id", "path", "text")
            own = rows.lateralJoin(self.loaders[t](F.col("path").outer(), F.col("text").outer())).drop("text")
            out = own if out is None else out.unionByName(own)
        if out is None:
            out = self.spark.createDataFrame([], "source_id string, path string, start_line int, end_line int, heading string, body string")
        place = F.concat(F.lit("["), "path", F.when(F.col("heading") != "", F.concat(F.lit(" > "), "heading")).otherwise(""), F.lit("]\n"))
        named = F.concat(F.substring_index("path", "/", -1), F.lit(" "), "heading", F.lit("\n"), "body")
        rows = out.select("source_id", "path", detect_language(F.col("path")).alias("language"), "start_line", "end_line", "heading", F.concat(place, "body").alias("text"), identifier_terms(named).alias("terms"))
        return rows.select(chunk_id(F.col("source_id"), F.col("path"), F.col("text")).alias("id"), "*", estimate_tokens(F.col("text")).alias("tokens"), text_hash(F.col("text")).alias("hash"))
