"""Source files without the contents of strings and comments, and the depth of braces, as scans over lines.

What a line does to a lexer depends on where the lexer stands when the line begins: in code, in a block comment or in a
template literal (other strings end with their line). So a line is a function from three states to three, which built-in
expressions find by letting one pattern run from each state. Functions compose associatively: they are composed in groups
of ``GROUP`` lines, and each group then hands the state that it begins in to its lines. All of it happens in the row that
holds the file's text: no text is shuffled, and only what is left of the code is written.

Depth is a running sum of braces that a closing brace without an opening one does not take below 0: the sum less its
running minimum, both plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import detect_language
from loomspark.operators.chunking import split_lines
from loomspark.sources.shared import stored

GROUP = 256
CODE, COMMENT, TEMPLATE = 0, 1, 2

#: Languages in which a single quote opens no string, and those with template literals.
NO_SINGLE_QUOTE = ("rust",)
BACKTICK = ("javascript", "typescript", "go")


def _string(quote: str) -> str:
    # Possessive, so that matching needs no stack and no way back, however long the line.
    return rf"{quote}(?:[^{quote}\\]++|\\.)*+(?:{quote}|\\?$)"


def _token(single: bool, template: bool, rest: str) -> str:
    """A pattern of a comment or string; ``rest``: what else it may match."""
    parts = [r"//.*", r"/\*.*?\*/", r"(/\*).*", _string('"')]
    if single:
        parts.append(_string("'"))
    if template:
        parts += [r"`(?:[^`\\]++|\\.)*+`", r"(`).*"]
    return "|".join([*parts, *([rest] if rest else [])])


def _per_language(language: Column, build) -> Column:
    """``build(single, template)`` for the language of a row."""
    single = ~F.coalesce(language.isin(*NO_SINGLE_QUOTE), F.lit(False))
    template = F.coalesce(language.isin(*BACKTICK), F.lit(False))
    return F.when(~single, build(False, False)).when(template, build(True, True)).otherwise(build(True, False))


def _end_state(code: Column, language: Column) -> Column:
    """The state after a piece of a line that begins in code: what a comment or template leaves open."""

    def build(single: bool, template: bool) -> Column:
        left = F.regexp_replace(code, _token(single, template, ""), " $1$2 " if template else " $1 ")
        opened = F.when(F.contains(left, F.lit("/*")), COMMENT)
        return opened.when(F.contains(left, F.lit("`")), TEMPLATE).otherwise(CODE) if template else opened.otherwise(CODE)

    return _per_language(language, build)


_LEAVES = {COMMENT: r"^.*?\*/", TEMPLATE: r"^(?:[^`\\]++|\\.)*+`"}


#: A line without these characters leaves every state as it is, and code as it stands.
_STARTS = "[\"'`/*]"


def line_function(line: Column, language: Column) -> Column:
    """The states after a line that begins in code, in a comment, in a template."""
    ends = [_end_state(line, language)]
    for state, leaves in _LEAVES.items():
        ends.append(F.when(line.rlike(leaves), _end_state(F.regexp_replace(line, leaves, ""), language)).otherwise(state))
    return F.when(line.rlike(_STARTS), F.array(*ends)).otherwise(F.array(*map(F.lit, (CODE, COMMENT, TEMPLATE))))


def line_states(functions: Column) -> Column:
    """The state that each line begins in, of the lines' functions in order."""
    starts = F.sequence(F.lit(1), F.size(functions), F.lit(GROUP))
    groups = F.when(F.size(functions) > 0, F.transform(starts, lambda i: F.slice(functions, i, F.lit(GROUP)))).otherwise(F.array())
    last = lambda states: F.element_at(states, -1)
    # The states before each of some functions, and one after the last.
    walk = lambda fs, start: F.aggregate(fs, F.array(start), lambda s, f: F.concat(s, F.array(f[last(s)])))
    whole = F.transform(groups, lambda g: F.aggregate(g, F.array(*map(F.lit, (CODE, COMMENT, TEMPLATE))), lambda s, f: F.transform(s, lambda x: f[x])))
    each = F.zip_with(groups, F.slice(walk(whole, F.lit(CODE)), F.lit(1), F.size(groups)), lambda g, start: F.slice(walk(g, start), F.lit(1), F.size(g)))
    return F.flatten(each)


def masked(line: Column, language: Column, state: Column) -> Column:
    """The line with blanks for what strings and comments hold; quotes stay, and every character its place."""
    blank = lambda text: F.repeat(F.lit(" "), F.length(text))

    def code(text: Column) -> Column:
        def build(single: bool, template: bool) -> Column:
            stop = "/\"" + "'" * single + "`" * template
            tokens = F.regexp_extract_all(text, F.lit(_token(single, template, rf"[^{stop}]+|.")), F.lit(0))

            def shown(t: Column) -> Column:
                first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
                quotes = F.lit("\"") if not single else F.lit("\"'") if not template else F.lit("\"'`")
                # A string that its line ends may end in an escaped quote, which is part of its content.
                closed = (F.length(t) > 1) & (first == last) & (F.length(F.regexp_extract(F.substring(t, 2, 1 << 30), r"(\\*).$", 1)) % 2 == 0)
                string = F.concat(first, F.when(closed, F.concat(F.repeat(F.lit(" "), F.length(t) - 2), last)).otherwise(F.repeat(F.lit(" "), F.length(t) - 1)))
                return F.when(t.startswith("//") | t.startswith("/*"), blank(t)).when(F.locate("x", F.translate(first, "\"'`", "xxx")).eqNullSafe(1) & F.contains(quotes, first), string).otherwise(t)

            return F.array_join(F.transform(tokens, shown), "")

        return _per_language(language, build)

    out = F.when(state == CODE, F.when(line.rlike(_STARTS), code(line)).otherwise(line))
    for own, leaves in _LEAVES.items():
        head, tail = F.regexp_extract(line, leaves, 0), F.regexp_replace(line, leaves, "")
        closing = F.lit("  ") if own == COMMENT else F.lit("`")
        left = F.concat(F.repeat(F.lit(" "), F.length(head) - F.length(closing)), closing, code(tail))
        out = out.when((state == own) & line.rlike(leaves), left)
    return out.otherwise(blank(line))


def masked_files(files: DataFrame) -> DataFrame:
    """Files (path, text, and their language if it is known) with their ``lines`` and, masked, their ``code``, as arrays."""
    language = F.col("language") if "language" in files.columns else detect_language(F.col("path"))
    rows = files.withColumn("language", language).withColumn("lines", split_lines(F.col("text")))
    rows = rows.withColumn("functions", F.transform("lines", lambda line: line_function(line, F.col("language"))))
    code = F.zip_with("lines", line_states(F.col("functions")), lambda line, state: masked(line, F.col("language"), state))
    return rows.withColumn("code", code).drop("functions")


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no, code) of masked files (path, code)."""
    rows = files.select("path", F.posexplode("code").alias("at", "code"))
    return rows.select("path", (F.col("at") + 1).alias("line_no"), "code")


def masked_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, code) of files (path, text, and their language if it is known): each line masked."""
    # Stored, so that no reader runs the patterns again.
    return lines_of(stored(masked_files(files).select("path", "code"), "masked"))


def with_depths(lines: DataFrame) -> DataFrame:
    """Masked lines with the depth of braces before and after each."""
    braces = F.regexp_replace("code", "[^{}]+", "")
    steps = F.filter(F.split(braces, ""), lambda c: c != "")
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("least")), lambda s, c: F.struct((s["sum"] + F.when(c == "{", 1).otherwise(-1)).alias("sum"), F.least(s["least"], s["sum"] + F.when(c == "{", 1).otherwise(-1)).alias("least")))
    upto = Window.partitionBy("path").orderBy("line_no")
    own = lines.withColumn("walk", walk).withColumn("total", F.sum("walk.sum").over(upto))
    own = own.withColumn("lowest", F.least(F.lit(0), F.min(F.col("total") - F.col("walk.sum") + F.col("walk.least")).over(upto)))
    after = F.col("total") - F.col("lowest")
    before = F.coalesce(F.lag(after).over(upto), F.lit(0))
    return own.withColumn("after", after).withColumn("before", before).drop("walk", "total", "lowest")
