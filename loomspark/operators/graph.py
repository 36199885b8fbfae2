"""Building and querying a typed graph of entities, edges and mentions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import glob_regex, words
from loomspark.sources.shared import stored


def merge_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, seq, n, via): counts of one edge add up, its first ``via`` stays; loops go."""
    return edges.where("src <> dst").groupBy("src", "dst", "kind").agg(F.sum("n").alias("n"), F.min_by("via", "seq").alias("via"))


def merge_entities(entities: DataFrame, attributes: list[str]) -> DataFrame:
    """(id, seq, attributes): the first writer of each attribute wins, later ones fill gaps."""
    firsts = [F.min_by(a, F.when(F.col(a).isNotNull(), F.col("seq"))).alias(a) for a in attributes]
    return entities.groupBy("id").agg(*firsts)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) in numbers of edges."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select("src", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, id, kind, direction) one step along edges either way."""
    out = start.join(edges, F.col("start") == F.col("src")).select("start", F.col("dst").alias("id"), "kind", F.lit("out").alias("direction"))
    back = start.join(edges, F.col("start") == F.col("dst")).select("start", F.col("src").alias("id"), "kind", F.lit("in").alias("direction"))
    return out.unionAll(back).distinct()


#: Kinds of edges that only say where things are.
STRUCTURAL = ("contains", "declares", "authored", "part_of", "member_of", "shows")


#: Fixed value: about how many paths a cell of a step joins.
CELL = 2_000_000


def _step(reach: DataFrame, near: DataFrame, depth: int) -> DataFrame:
    """(start, id, depth): what is reached so far and, by one of ``near`` (src, id), from what was reached last.

    There are far more paths than edges, so edges come to the paths: a path is joined in the cell of its start's block and its
    end's block, to which ``reach`` goes for all blocks of ends and ``near`` for all blocks of starts. Ends of a start are told
    apart in the cell, paths are not shuffled, and those of a hub are spread over all cells.
    """
    # A loop at each vertex keeps what is reached already.
    onward = near.unionByName(reach.select(F.col("id").alias("src"), "id").distinct())
    ways = reach.groupBy(F.col("id").alias("src")).agg(F.count("*").alias("n")).join(onward.groupBy("src").agg(F.count("*").alias("m")), "src")
    paths = ways.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    blocks = math.ceil(math.sqrt(max(1, paths / CELL)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    row = F.sequence(block("start") * blocks, block("start") * blocks + blocks - 1)
    column = F.sequence(block("id"), block("id") + blocks * (blocks - 1), F.lit(blocks))
    begun = reach.select("start", F.col("id").alias("src"), "depth", F.explode(row).alias("cell")).repartitionById(blocks**2, "cell")
    ended = onward.select("src", "id", F.explode(column).alias("cell")).repartitionById(blocks**2, "cell")
    loop = F.col("src") == F.col("id")
    # Merged even where a side is small: after a broadcast, paths would be dealt anew.
    paths = begun.join(ended.hint("merge"), ["cell", "src"]).where(loop | (F.col("depth") == depth - 1))
    paths = paths.select("cell", "start", "id", F.when(loop, F.col("depth")).otherwise(depth).alias("depth"))
    return paths.groupBy("cell", "start", "id").agg(F.min("depth").alias("depth")).select("start", "id", "depth")


def neighbourhood(edges: DataFrame, start: DataFrame, fans: tuple[int | None, ...] = (None, None), most: int | None = None) -> DataFrame:
    """(start, id, depth): vertices near each start by semantic edges in either direction, ``len(fans)`` steps far at most.

    All of them, unless an excerpt is asked for: where ``fans[step]`` is a number, each vertex of the frontier gives so many
    neighbours, of the most incoming edges; those not seen before go on; with ``most``, so many vertices stay a start (nearer
    ones first, then by incoming edges and id). The whole result grows with the number of paths.
    """
    semantic = edges.where(~F.col("kind").isin(*STRUCTURAL)).select("src", F.col("dst").alias("id"))
    both = semantic.unionByName(semantic.select(F.col("id").alias("src"), F.col("src").alias("id"))).where("src <> id").distinct()
    weight = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("incoming"))

    def placed(rows: DataFrame, by: str, *first: str) -> DataFrame:
        order = Window.partitionBy(by).orderBy(*first, F.desc(F.coalesce("incoming", F.lit(0))), "id")
        return rows.join(weight, "id", "left").withColumn("place", F.row_number().over(order)).drop("incoming")

    # Stored, as each step reads it with a limit of its own.
    near = stored(both if fans.count(None) == len(fans) else placed(both, "src"), "near")
    first = start.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct()
    seen = first
    for depth, fan in enumerate(fans, 1):
        seen = _step(seen, (near if fan is None else near.where(F.col("place") <= fan)).select("src", "id"), depth)
        if depth < len(fans):
            seen = stored(seen, "seen")  # read by the next step several times
    seen = seen.unionByName(first.where("start is null"))
    return seen if most is None else placed(seen, "start", "depth").where(F.col("place") <= most).drop("place").select("start", "id", "depth")


def co_changes(touches: DataFrame, least: int = 2, most_files: int = 30) -> DataFrame:
    """(a, b, n): pairs of files that one commit touches, in ``least`` commits at least; commits of too many files are no evidence."""
    size = touches.groupBy("commit").agg(F.count("*").alias("files")).where(F.col("files") <= most_files)
    own = touches.join(size, "commit").select("commit", "file")
    pairs = own.alias("x").join(own.alias("y"), "commit").where("x.file < y.file")
    return pairs.groupBy(F.col("x.file").alias("a"), F.col("y.file").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def top_partners(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Pairs that either side counts among its ``k`` most frequent."""
    sides = pairs.select(F.col("a").alias("file"), F.col("b").alias("other"), "n").unionAll(pairs.select("b", "a", "n"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), F.desc("other")))
    kept = sides.withColumn("r", rank).where(F.col("r") <= k)
    return kept.select(F.least("file", "other").alias("a"), F.greatest("file", "other").alias("b"), "n").distinct()


def last_match(files: DataFrame, rules: list[tuple[str, str]], path: str = "path") -> Column:
    """The owner of the last rule whose pattern matches, null if none does. Rules are few, so each is one condition."""
    owner = F.lit(None).cast("string")
    for pattern, who in rules:
        owner = F.when(F.col(path).rlike(glob_regex(pattern)), F.lit(who)).otherwise(owner)
    return owner


def first_claim(files: DataFrame, sources: list[tuple[str, str]], path: str = "path") -> Column:
    """The first source whose pattern matches."""
    claim = F.lit(None).cast("string")
    for name, pattern in reversed(sources):
        claim = F.when(F.col(path).rlike(glob_regex(pattern)), F.lit(name)).otherwise(claim)
    return claim


def name_mentions(texts: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """(id, name, n): names of at least ``least`` letters among the words of texts, whatever their case."""
    tokens = texts.select("id", F.explode(words(F.lower("text"))).alias("name"))
    known = names.select(F.lower("name").alias("name")).where(F.length("name") >= least).distinct()
    return tokens.groupBy("id", "name").agg(F.count("*").alias("n")).join(known, "name").select("id", "name", "n")


def resolve_unique(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """References (ref, key, scope) to candidates (target, key, scope): the only one, else the only one of the same scope, else none."""
    all_of = candidates.groupBy("key").agg(F.count("*").alias("n"), F.min("target").alias("only"))
    own = candidates.groupBy("key", "scope").agg(F.count("*").alias("m"), F.min("target").alias("near"))
    out = references.join(all_of, "key", "left").join(own, ["key", "scope"], "left")
    return out.select("ref", "key", F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("near")).alias("target"))


def find_by_name(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, id, how) entities by exact lower-case name; where there is none, by the part after the last dot or slash."""
    asked = names.select(F.lower("asked").alias("asked")).distinct()
    exact = asked.join(entities, F.col("asked") == F.lower("name")).select("asked", "id", F.lit("exact").alias("how"))
    rest = asked.join(exact.select("asked").distinct(), "asked", "left_anti")
    tail = F.regexp_extract(F.lower("name"), r"[./]([^./]+)$", 1)
    return exact.unionAll(rest.join(entities.withColumn("tail", tail), F.col("asked") == F.col("tail")).select("asked", "id", F.lit("suffix")))
