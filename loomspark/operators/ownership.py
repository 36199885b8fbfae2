"""Who owns a file: services by path patterns, rules of an owners' file, and what files inherit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import detect_language, glob_regex

#: Where an owners' file may be, the first there counts.
OWNER_FILES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")


def file_entities(chunks: DataFrame) -> DataFrame:
    """(id, type, name, kind) of every path: code, doc (Markdown) or text."""
    kind = F.when(detect_language(F.col("path")).isNotNull(), "code").when(F.col("path").rlike(r"\.(md|markdown)$"), "doc").otherwise("text")
    return chunks.select("path").distinct().select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("name"), kind.alias("kind"))


def service_patterns(spark: SparkSession, services: list[dict]) -> DataFrame:
    """(pos, service, team, regex) of a configured list of services (name, team, paths): one row a pattern."""
    rows = [(pos, s["name"], s.get("team"), glob_regex(p)) for pos, s in enumerate(services) for p in ([s["paths"]] if isinstance(s.get("paths"), str) else s.get("paths") or [])]
    return spark.createDataFrame(rows, "pos int, service string, team string, regex string")


def service_files(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, service, pos, team): every service one of whose patterns fits; patterns are a configuration, not data."""
    fits = files.select("path").distinct().join(patterns, F.expr("path RLIKE regex"))
    return fits.groupBy("path", "pos").agg(F.first("service").alias("service"), F.first("team").alias("team"))


def owner_rules(text: str) -> list[tuple[str, list[str]]]:
    """(glob, owners) of the lines of an owners' file: comments and marks go, names without a slash fit at any depth."""
    rules = []
    for line in text.splitlines():
        pattern, *owners = line.split("#", 1)[0].split() or [""]
        if owners:
            at_root = pattern.startswith("/") or "/" in pattern.rstrip("/")
            rules.append((pattern.removeprefix("/") if at_root else "**/" + pattern, [o.lstrip("@") for o in owners]))
    return rules


def read_owner_rules(spark: SparkSession, root: str) -> list[tuple[str, list[str]]]:
    """The rules of the first owners' file below ``root``, which is a small file."""
    for place in OWNER_FILES:
        try:
            content = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{place}").select("content").first()
        except AnalysisException:  # no such file
            continue
        if content is not None:
            return owner_rules(bytes(content[0]).decode("utf-8", "replace"))
    return []


def file_owners(files: DataFrame, patterns: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """(path, service, owner): the last fitting service and its team, else the first owner of the last fitting rule."""
    last = service_files(files, patterns).groupBy("path").agg(F.max_by("service", "pos").alias("service"), F.max_by(F.struct("team"), F.when(F.col("team").isNotNull(), F.col("pos"))).alias("t"))
    out = files.select("path").distinct().join(last, "path", "left")
    ruled = F.lit(None).cast("string")
    for pattern, owners in rules:
        ruled = F.when(F.col("path").rlike(glob_regex(pattern)), F.lit(owners[0])).otherwise(ruled)
    return out.select("path", "service", F.coalesce("t.team", ruled).alias("owner"))


def ownership_edges(files: DataFrame, patterns: DataFrame, members: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(src, dst, kind, via) of people in teams (person, team), teams that own services, services that contain files, and
    dependencies (source, target, via) between services."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.lower(c))
    none = F.lit(None).cast("string").alias("via")
    contains = service_files(files, patterns).select(named("service", "service").alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("contains").alias("kind"), none)
    owns = patterns.where("team is not null").select(named("team", "team").alias("src"), named("service", "service").alias("dst"), F.lit("owns").alias("kind"), none).distinct()
    member = members.select(named("person", "person").alias("src"), named("team", "team").alias("dst"), F.lit("member_of").alias("kind"), none).distinct()
    depends = dependencies.select(named("service", "source").alias("src"), named("service", "target").alias("dst"), F.lit("depends_on").alias("kind"), F.coalesce("via", F.lit("unknown")).alias("via")).distinct()
    return contains.unionByName(owns).unionByName(member).unionByName(depends)
