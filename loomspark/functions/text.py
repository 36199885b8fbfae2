"""Scalar column functions on texts, paths and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

#: Words that carry no signal in a question.
STOPWORDS = (
    "a an the and or of in on to for with by is are was be it its this that how what which where when who why do does did "
    "we our i my you can should from into at as if then there their them they not no any all one use used using via about "
    "up out so has have had me us want need way thing things"
).split()

#: Languages with their file extensions.
EXTENSIONS = {
    "apex": ["cls", "trigger", "apex"],
    "visualforce": ["page", "component"],
    "aura": ["cmp", "app", "evt", "design"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
    "scala": ["scala"],
    "groovy": ["groovy", "gradle"],
    "csharp": ["cs"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hh"],
    "objc": ["m"],
    "swift": ["swift"],
    "go": ["go"],
    "rust": ["rs"],
    "dart": ["dart"],
    "php": ["php"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx"],
    "css": ["css", "scss"],
    "html": ["html"],
    "xml": ["xml"],
    "python": ["py"],
    "ruby": ["rb"],
    "shell": ["sh", "bash"],
    "sql": ["sql", "soql"],
    "yaml": ["yaml", "yml"],
    "json": ["json"],
    "toml": ["toml"],
}

#: Folders and names of test files.
TEST_PATH = r"(^|/)(test|tests|spec|specs|__tests__|testing)(/|$)|(Test|Tests|Spec|IT)\.\w+$"


def estimate_tokens(text: Column) -> Column:
    """About four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def chunk_id(source_id: Column, path: Column, text: Column) -> Column:
    zero = F.lit("\0")
    return F.substring(F.sha2(F.concat(source_id, zero, path, zero, text, zero), 256), 1, 16)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def query_terms(text: Column) -> Column:
    """Words in the order of their first occurrence, one spelling of each (the first)."""
    pairs = F.transform(words(text), lambda w, i: F.struct(F.lower(w).alias("k"), i.alias("i"), w.alias("w")))
    keys = F.transform(pairs, lambda p: p["k"])
    return F.transform(F.filter(pairs, lambda p: F.array_position(keys, p["k"]) == p["i"] + 1), lambda p: p["w"])


def search_terms(text: Column) -> Column:
    """Query terms less stopwords and terms of one or two letters; all of them if none is left."""
    terms = query_terms(text)
    stop = F.array(*map(F.lit, STOPWORDS))
    kept = F.filter(terms, lambda t: ~F.array_contains(stop, F.lower(t)) & (F.length(t) > 2))
    return F.when(F.size(kept) > 0, kept).otherwise(terms)


def identifier_terms(text: Column, limit: int = 400) -> Column:
    """Distinct lower-case parts of compound identifiers (snake or camel case), in order."""
    camel = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
    names = F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    parts = F.transform(names, lambda n: F.transform(F.regexp_extract_all(n, F.lit(camel), F.lit(0)), lambda p: F.lower(p)))
    compound = F.flatten(F.filter(parts, lambda p: F.size(p) >= 2))
    return F.slice(F.array_distinct(F.filter(compound, lambda p: F.length(p) >= 2)), 1, limit)


def folder_of(path: Column) -> Column:
    """A path without its last part; empty for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def kebab_to_camel(name: Column) -> Column:
    """``my-part-name`` as ``myPartName``."""
    parts = F.split(name, "-")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20)))
    return F.concat(parts[0], F.array_join(rest, ""))


def class_of(qualified: Column) -> Column:
    """The first part of a dotted name."""
    return F.substring_index(qualified, ".", 1)


def short_name(qualified: Column) -> Column:
    """The last part of a dotted name."""
    return F.substring_index(qualified, ".", -1)


def entity_id(type_: str, name: Column) -> Column:
    """Files by their path, all else by its lower-cased name."""
    return F.concat(F.lit(f"{type_}:"), name if type_ == "file" else F.lower(name))


def symbol_id(name: Column, path: Column) -> Column:
    return F.concat(F.lit("symbol:"), name, F.lit("@"), path)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def detect_language(path: Column) -> Column:
    pairs = [F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts for x in (e, lang)]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(F.lower(path), r"\.([^.]*)$", 1))


def glob_regex(pattern: str) -> str:
    """A regular expression for whole paths: ``*`` within a segment, ``**`` across segments; a literal takes its subtree."""
    pattern = pattern.strip().removeprefix("./").rstrip("/")
    plain = not any(c in pattern for c in "*?[")
    out, at = "", 0
    tokens = (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]"))
    while at < len(pattern):
        hit = next(((g, r) for g, r in tokens if pattern.startswith(g, at)), None)
        close = pattern.find("]", at + 1)
        if hit:
            out, at = out + hit[1], at + len(hit[0])
        elif pattern[at] == "[" and close > 0:
            body = pattern[at + 1 : close].replace("\\", "\\\\")
            out, at = out + ("[^" + body[1:] if body.startswith("!") else "[" + body) + "]", close + 1
        else:
            c = pattern[at]
            out, at = out + ("\\" + c if c in r".^$+{}()|\[]" else c), at + 1
    return f"^{out}(?:/.*)?$" if plain else f"^{out}$"


def matches_glob(path: Column, *patterns: str) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(glob_regex(p))
    return hit
