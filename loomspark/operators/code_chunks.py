"""Chunks of source code that are cut at declarations.

Declarations of brace languages come from ``operators.code`` as a table; a file's own meet its text, and a small function
partitions the file's lines: a declaration stays whole unless it is too large and holds others. Python's blocks are read
by indentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import detect_language, estimate_tokens, identifier_terms
from loomspark.operators import code
from loomspark.operators.chunking import LEAST, MOST, OVERLAP, TARGET, Sizes, cut_sections, lines_of

#: (first line, one past the last, qualified name), lines from 0.
Block = tuple[int, int, str]

#: A Python declaration, and lines that belong to the declaration below them.
PYTHON_BLOCK = re.compile(r"^([ \t]*)(?:async[ \t]+def|def|class)[ \t]+(\w+)")
LEADING = re.compile(r"^\s*(?://|/\*|\*|#|@|\[)")


def python_blocks(lines: list[str]) -> list[Block]:
    """Functions and classes by indentation: a block ends before the next filled line that is not indented deeper."""
    out: list[Block] = []
    open_: list[tuple[int, int, str]] = []  # indentation, first line, qualified name
    last = 0

    def close(indent: int) -> None:
        while open_ and open_[-1][0] >= indent:
            _, start, name = open_.pop()
            out.append((start, last, name))

    for i, line in enumerate(lines):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        close(len(line) - len(line.lstrip()))
        if m := PYTHON_BLOCK.match(line):
            open_.append((len(m[1]), i, ".".join([*(name.split(".")[-1] for _, _, name in open_), m[2]])))
        last = i + 1
    close(0)
    return sorted(out)


def with_headers(lines: list[str], blocks: list[Block]) -> list[Block]:
    """Blocks with the comments and annotations right above them."""
    out = []
    for start, end, name in blocks:
        while start > 0 and LEADING.match(lines[start - 1]):
            start -= 1
        out.append((start, end, name))
    return out


def partition(lines: list[str], span: tuple[int, int], title: str, blocks: list[Block], most: int) -> list[tuple[tuple[int, int], str]]:
    """Sections of a span: itself if it is small enough or holds no block, else its outermost blocks and what lies between."""
    own = [b for b in blocks if span[0] <= b[0] and b[1] <= span[1] and b != (*span, title)]
    if not own or (title and Sizes(lines[slice(*span)]).tokens((0, span[1] - span[0])) <= most):
        return [(span, title)]
    out, at = [], span[0]
    for start, end, name in sorted(own, key=lambda b: (b[0], -b[1])):
        if start < at:  # inside the block before
            continue
        if start > at:
            out.append(((at, start), title))
        out += partition(lines, (start, end), name, own, most)
        at = end
    if at < span[1]:
        out.append(((at, span[1]), title))
    return [x for x in out if any(line.strip() for line in lines[slice(*x[0])])]


def code_spans(text: str, blocks: list[Block], target: int = TARGET, most: int = MOST, least: int = LEAST, overlap: float = OVERLAP) -> list[tuple[int, int, str]]:
    """(first line, last line, name) of a file's chunks, lines from 1."""
    lines = lines_of(text)
    sections = partition(lines, (0, len(lines)), "", with_headers(lines, blocks), most) if text.strip() else []
    return [*cut_sections(lines, [0] * len(lines), sections, target, most, least, overlap)]


def code_chunks(files: DataFrame, **sizes: float) -> DataFrame:
    """(path, language, chunk_no, start_line, end_line, heading, text, terms, tokens) of source files (path, text)."""
    known = files.select("path", "text", detect_language(F.col("path")).alias("language")).where("text is not null")
    declared = code.declarations(code.code_lines(known.where("language is null or language <> 'python'").select("path", "text")))
    blocks = declared.groupBy("path").agg(F.collect_list(F.struct("start_line", "end_line", "qualified")).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text, language, found in zip(pdf["path"], pdf["text"], pdf["language"], pdf["blocks"], strict=True):
                lines = lines_of(text)
                own = python_blocks(lines) if language == "python" else [(b["start_line"] - 1, b["end_line"], b["qualified"]) for b in (found if found is not None else [])]
                for n, (a, b, title) in enumerate(code_spans(text, own, **sizes)):
                    rows.append((path, language, n, a, b, title, "\n".join(lines[a - 1 : b])))
            yield pd.DataFrame(rows, columns=["path", "language", "chunk_no", "start_line", "end_line", "heading", "body"])

    rows = known.join(blocks, "path", "left").mapInPandas(run, "path string, language string, chunk_no int, start_line int, end_line int, heading string, body string")
    place = F.concat(F.lit("["), "path", F.when(F.col("heading") != "", F.concat(F.lit(" > "), "heading")).otherwise(""), F.lit("]\n"))
    named = F.concat(F.substring_index("path", "/", -1), F.lit(" "), "heading", F.lit("\n"), "body")
    out = rows.select("path", "language", "chunk_no", "start_line", "end_line", "heading", F.concat(place, "body").alias("text"), identifier_terms(named).alias("terms"))
    return out.withColumn("tokens", estimate_tokens(F.col("text")))
