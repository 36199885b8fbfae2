"""Cutting texts into line-addressed chunks.

Sections and windows of lines are folds over lines, as JVM-side ``aggregate`` expressions. Whole document chunks (sections,
with small ones merged and large ones cut at paragraphs with overlap) come from prefix sums of the lines' sizes, in which the ends of windows are
looked up; a small function does so on Arrow batches, and Spark deals the texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import estimate_tokens, identifier_terms

TARGET, MOST, LEAST, OVERLAP = 600, 800, 40, 0.1

#: How Markdown marks a fence and a heading.
FENCE = r"^[ \t]{0,3}(`{3,}|~{3,})"
HEADING = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"


def split_lines(text: Column) -> Column:
    """Lines without their ends; no last empty line."""
    lines = F.split(text, "\\R|[\\x1c-\\x1e]", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def heading_sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a section that starts at a heading outside fences: section_no, heading trail, start_line, end_line, body."""
    step = """named_struct(
      'n', s.n + 1,
      'fence', CASE WHEN l RLIKE {fence} THEN
          CASE WHEN s.fence = '' THEN regexp_extract(l, {fence}, 1)
               WHEN substring(trim(l), 1, 1) = substring(s.fence, 1, 1) AND length(regexp_extract(l, {fence}, 1)) >= length(s.fence) THEN ''
               ELSE s.fence END
          ELSE s.fence END,
      'trail', CASE WHEN s.fence = '' AND l RLIKE {heading} THEN {trail} ELSE s.trail END,
      'cuts', CASE WHEN s.fence = '' AND l RLIKE {heading} THEN
          concat(filter(s.cuts, c -> c.at < s.n + 1), array(named_struct('at', s.n + 1, 'heading', array_join(transform({trail}, t -> t.title), ' > '))))
          ELSE s.cuts END)"""
    trail = """concat(filter(s.trail, t -> t.level < length(regexp_extract(l, {heading}, 1))),
          array(named_struct('level', length(regexp_extract(l, {heading}, 1)), 'title', trim(regexp_extract(l, {heading}, 2)))))"""
    for name, value in (("{trail}", trail), ("{fence}", _literal(FENCE)), ("{heading}", _literal(HEADING))):
        step = step.replace(name, value)
    start = "named_struct('n', 0, 'fence', '', 'trail', CAST(array() AS array<struct<level:int,title:string>>), 'cuts', array(named_struct('at', 1, 'heading', '')))"
    folded = docs.withColumn("lines", split_lines(F.col(text_col)))
    folded = folded.withColumn("cuts", F.expr(f"aggregate(lines, {start}, (s, l) -> {step}, s -> s.cuts)"))
    # A heading on the first line replaces the empty opening section.
    folded = folded.withColumn("cuts", F.expr("filter(cuts, (c, i) -> i = size(cuts) - 1 OR cuts[i + 1].at > c.at)"))
    rows = folded.select("*", F.posexplode("cuts").alias("section_no", "cut"))
    end = F.expr("CASE WHEN section_no + 1 < size(cuts) THEN cuts[section_no + 1].at - 1 ELSE size(lines) END")
    rows = rows.withColumn("end_line", end).withColumn("start_line", F.col("cut.at")).withColumn("heading", F.col("cut.heading"))
    rows = rows.withColumn("body", F.expr("array_join(slice(lines, start_line, greatest(0, end_line - start_line + 1)), '\n')"))
    return rows.where(F.trim("body") != "").drop("lines", "cuts", "cut")


def line_windows(docs: DataFrame, text_col: str = "text", target: int = TARGET, most: int = MOST) -> DataFrame:
    """One row a window of lines: window_no, start_line, end_line, body, tokens.

    A text of no more than ``most`` tokens is one window; else lines are taken while their tokens stay within ``target``.
    """
    size = "greatest(1, CAST(floor((length(l) + 3) / 4) AS INT))"
    step = f"CASE WHEN s.tok + {size} > {target} AND s.n >= element_at(s.starts, -1) THEN named_struct('n', s.n + 1, 'tok', {size}, 'starts', concat(s.starts, array(s.n + 1))) ELSE named_struct('n', s.n + 1, 'tok', s.tok + {size}, 'starts', s.starts) END"
    rows = docs.withColumn("lines", split_lines(F.col(text_col))).where(F.size("lines") > 0)
    whole = estimate_tokens(F.array_join("lines", "\n")) <= most
    rows = rows.withColumn("starts", F.when(whole, F.array(F.lit(1))).otherwise(F.expr(f"aggregate(lines, named_struct('n', 0, 'tok', 0, 'starts', array(1)), (s, l) -> {step}, s -> s.starts)")))
    rows = rows.select("*", F.posexplode("starts").alias("window_no", "start_line"))
    rows = rows.withColumn("end_line", F.expr("CASE WHEN window_no + 1 < size(starts) THEN starts[window_no + 1] - 1 ELSE size(lines) END"))
    rows = rows.withColumn("body", F.expr("array_join(slice(lines, start_line, end_line - start_line + 1), '\n')"))
    return rows.withColumn("tokens", estimate_tokens(F.col("body"))).drop("lines", "starts")


_LINE_ENDS = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
Span = tuple[int, int]


class Sizes:
    """Prefix sums over the lines of a text, from which the size of any span follows at once."""

    def __init__(self, lines: list[str]):
        self.chars = [0, *accumulate(len(line) + 1 for line in lines)]
        self.by_line = [0, *accumulate(max(1, (len(line) + 3) // 4) for line in lines)]

    def tokens(self, span: Span) -> int:
        """The tokens of the lines joined, one at least."""
        return max(1, (self.chars[span[1]] - self.chars[span[0]] + 2) // 4)


def _reach(sums: list[int], start: int, limit: int, most: int) -> int:
    """How far from ``start`` a span goes whose sum stays within ``limit``: one step at least, and not beyond ``most``."""
    return min(most, max(start + 1, bisect_right(sums, sums[start] + limit) - 1))


def _fences(lines: list[str]) -> list[int]:
    """For each line the number of its fenced block, marks included, from 1; 0 outside."""
    out, mark, n = [], "", 0
    for line in lines:
        m = re.match(FENCE, line)
        n += bool(m and not mark)
        out.append(n if mark or m else 0)
        if m and not mark:
            mark = m[1]
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark):
            mark = ""
    return out


def _titled(lines: list[str], fenced: list[int]) -> list[tuple[Span, str]]:
    """Sections from one heading outside fences to the next, with the trail of titles; blank ones are left out."""
    cuts, trail = [(0, "")], []
    for i, line in enumerate(lines):
        m = None if fenced[i] else re.match(HEADING, line)
        if m:
            trail = [t for t in trail if t[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            cuts.append((i, " > ".join(t for _, t in trail)))
    ends = [at for at, _ in cuts[1:]] + [len(lines)]
    spans = [((at, end), title) for (at, title), end in zip(cuts, ends, strict=True)]
    return [x for x in spans if any(line.strip() for line in lines[slice(*x[0])])]


def _merged(sections: list[tuple[Span, str]], sizes: Sizes, target: int, least: int) -> Iterator[tuple[Span, str]]:
    """Runs of sections that stand as one: a section opens a new run unless it is small, or follows a small run and fits
    ``target`` with it. A run has the first title that is not empty."""
    run: list[tuple[Span, str]] = []
    for section in [*sections, None]:
        if run:
            whole = (run[0][0][0], run[-1][0][1])
            own = sizes.tokens(section[0]) if section else 0
            small = section and (own < least or sizes.tokens(whole) < least and sizes.tokens(whole) + own <= target)
            if not small:
                yield whole, next((title for _, title in run if title), "")
                run = []
        if section:
            run.append(section)


def _paragraphs(lines: list[str], fenced: list[int], sizes: Sizes, span: Span, target: int, most: int) -> Iterator[Span]:
    """Runs of lines that are not blank, a fenced block being one of its own; one of more than ``most`` tokens in pieces that
    reach as far as ``target`` lets them."""
    for kind, run in groupby(range(*span), key=lambda i: fenced[i] or (0 if lines[i].strip() else None)):
        if kind is not None:
            block = [*run]
            at, end = block[0], block[-1] + 1
            limit = target if sizes.tokens((at, end)) > most else sizes.by_line[-1]
            while at < end:
                to = _reach(sizes.by_line, at, limit, end)
                yield at, to
                at = to


def _windows(paragraphs: list[Span], sizes: Sizes, target: int, overlap: int) -> Iterator[Span]:
    """Windows of whole paragraphs within ``target``, but of one that is new in any case. The next one begins ``overlap`` tokens
    back at most, at a paragraph of the last one."""
    sums = [0, *accumulate(map(sizes.tokens, paragraphs))]
    first = fresh = 0
    while fresh < len(paragraphs):
        end = max(fresh + 1, _reach(sums, first, target, len(paragraphs)))
        yield paragraphs[first][0], paragraphs[end - 1][1]
        first, fresh = bisect_left(sums, sums[end] - overlap, first, end), end


def cut_sections(lines: list[str], fenced: list[int], sections: list[tuple[Span, str]], target: int, most: int, least: int, overlap: float) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, title), lines from 1: sections merged, cut into windows, without blank lines at either end."""
    sizes = Sizes(lines)
    for span, title in _merged(sections, sizes, target, least):
        cut = sizes.tokens(span) > most
        for a, b in _windows([*_paragraphs(lines, fenced, sizes, span, target, most)], sizes, target, int(target * overlap)) if cut else [span]:
            filled = [i for i in range(a, b) if lines[i].strip()]
            if filled:
                yield filled[0] + 1, filled[-1] + 1, title


def lines_of(text: str) -> list[str]:
    """Lines without their ends; no last empty line."""
    lines = _LINE_ENDS.split(text)
    return lines[:-1] if lines[-1] == "" else lines


def chunk_spans(text: str, headings: bool = True, target: int = TARGET, most: int = MOST, least: int = LEAST, overlap: float = OVERLAP) -> list[tuple[int, int, str]]:
    """(first line, last line, heading) of a text's chunks, lines from 1, without blank lines at either end."""
    lines = lines_of(text)
    fenced = _fences(lines)
    sections = _titled(lines, fenced) if headings else [((0, len(lines)), "")] if text.strip() else []
    return [*cut_sections(lines, fenced, sections, target, most, least, overlap)]


def document_chunks(docs: DataFrame, headings: bool = True, **sizes: float) -> DataFrame:
    """(path, chunk_no, start_line, end_line, heading, text, terms, tokens) of documents (path, text).

    A chunk's text starts with its path and heading in brackets; ``terms`` are the parts of compound identifiers in the
    file's name, the heading and the body. Null and blank texts have no chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                lines = lines_of(text)
                for n, (a, b, title) in enumerate(chunk_spans(text, headings, **sizes)):
                    rows.append((path, n, a, b, title, "\n".join(lines[a - 1 : b])))
            yield pd.DataFrame(rows, columns=["path", "chunk_no", "start_line", "end_line", "heading", "body"])

    rows = docs.select("path", "text").where("text is not null").mapInPandas(run, "path string, chunk_no int, start_line int, end_line int, heading string, body string")
    place = F.concat(F.lit("["), "path", F.when(F.col("heading") != "", F.concat(F.lit(" > "), "heading")).otherwise(""), F.lit("]\n"))
    named = F.concat(F.substring_index("path", "/", -1), F.lit(" "), "heading", F.lit("\n"), "body")
    out = rows.select("path", "chunk_no", "start_line", "end_line", "heading", F.concat(place, "body").alias("text"), identifier_terms(named).alias("terms"))
    return out.withColumn("tokens", estimate_tokens(F.col("text")))
