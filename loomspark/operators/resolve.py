"""Resolving names that files use to the entities that they mean: by imports and folders, by markup, by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import folder_of, kebab_to_camel

#: How sources import a class or a field's schema, and how markup names a component.
CLASS_IMPORT = r"@salesforce/apex/(\w+)\.(\w+)"
SCHEMA_IMPORT = r"@salesforce/schema/(\w+)(?:\.(\w+))?"
COMPONENT_TAG = r"<c-([a-z0-9]+(?:-[a-z0-9]+)*)"
IMPORT_LINE = r"(?m)^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;?\s*$"


def imported_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IMPORT_LINE), F.lit(1))


def imports_of(files: DataFrame) -> DataFrame:
    """(path, pos, package): the imports of source files (path, and text or its ``imports``) in order, as folders."""
    names = F.col("imports") if "imports" in files.columns else imported_names(F.col("text"))
    rows = files.select("path", F.posexplode(names).alias("pos", "name"))
    return rows.select("path", "pos", F.replace("name", F.lit("."), F.lit("/")).alias("package"))


def folder_runs(path: Column) -> Column:
    """All runs of neighbouring folders of a path, joined by slashes: what an import of a package can lead to."""
    parts = F.filter(F.split(folder_of(path), "/"), lambda p: p != "")
    ends = F.sequence(F.lit(1), F.size(parts))
    runs = F.transform(ends, lambda i: F.transform(F.sequence(F.lit(1), i), lambda j: F.array_join(F.slice(parts, j, i - j + 1), "/")))
    return F.when(F.size(parts) > 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def resolve_by_imports(references: DataFrame, candidates: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, target) of references (ref, key, path) to candidates (key, target, path): the only candidate of the name; else the
    first by path below the package of the file's earliest import that leads to one (an import of the name itself counts by its
    package); else the first of the file's own folder; else none.

    Packages meet candidates by an equi-join with the candidates' runs of folders; names with one candidate take no part in it.
    """
    cand = candidates.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("path", "target")).alias("only"))
    many = candidates.join(cand.where("n > 1").select("key"), "key", "left_semi")
    refs = references.join(cand, "key", "left")
    asked = refs.where("n > 1").select("ref", "key", "path")
    used = imports.select("path", "pos", "package").join(asked.select("path").distinct(), "path", "left_semi")
    parent = F.when(F.lower(F.substring_index("package", "/", -1)) == F.col("key"), folder_of(F.col("package"))).otherwise(F.col("package"))
    led = asked.join(used, "path").select("ref", "key", "pos", parent.alias("run"))
    runs = many.select("key", "target", F.col("path").alias("target_path"), F.explode(folder_runs(F.col("path"))).alias("run"))
    first = runs.groupBy("key", "run").agg(F.min(F.struct("target_path", "target")).alias("t"))
    by_import = led.join(first, ["key", "run"]).groupBy("ref").agg(F.min_by("t.target", "pos").alias("imported"))
    folders = many.groupBy("key", folder_of(F.col("path")).alias("folder")).agg(F.min(F.struct("path", "target")).alias("near"))
    by_folder = asked.select("ref", "key", folder_of(F.col("path")).alias("folder")).join(folders, ["key", "folder"]).select("ref", F.col("near.target").alias("neighbour"))
    out = refs.join(by_import, "ref", "left").join(by_folder, "ref", "left")
    return out.select("ref", F.coalesce(F.when(F.col("n") == 1, F.col("only.target")), "imported", "neighbour").alias("target"))


def resolve_deferred(pending: DataFrame, kinds: list[DataFrame]) -> DataFrame:
    """(src, kind, target) of names (src, kind, name) that were left open: the first of ``kinds`` (id, name) that has the
    name, whatever its case, gives the target; names that none has are dropped."""
    rows = pending.withColumn("key", F.lower("name"))
    for i, known in enumerate(kinds):
        first = known.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias(f"t{i}"))
        rows = rows.join(first, "key", "left")
    target = F.coalesce(*(F.col(f"t{i}") for i in range(len(kinds))))
    return rows.select("src", "kind", target.alias("target")).where("target is not null")


def import_references(files: DataFrame, symbols: DataFrame, fields: DataFrame) -> DataFrame:
    """(path, target, via) of imports in component scripts (path, text): the method if there is one of the name, else its
    class; the field if it is known, else its object."""
    each = lambda pattern: files.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("x")).select("path", F.regexp_extract("x", pattern, 1).alias("outer"), F.regexp_extract("x", pattern, 2).alias("inner")).distinct()
    whole = F.lower(F.concat_ws(".", "outer", F.when(F.col("inner") != "", F.col("inner"))))

    def found(rows: DataFrame, known: DataFrame, via: str) -> DataFrame:
        ids = known.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))
        full = rows.withColumns({"whole": whole, "part": F.lower("outer")}).join(ids.withColumnsRenamed({"name": "whole", "id": "full"}), "whole", "left")
        both = full.join(ids.withColumnsRenamed({"name": "part", "id": "outer_id"}), "part", "left")
        return both.select("path", F.coalesce("full", "outer_id").alias("target"), F.lit(via).alias("via")).where("target is not null")

    return found(each(CLASS_IMPORT), symbols, "import").unionByName(found(each(SCHEMA_IMPORT), fields, "schema")).distinct()


def component_tags(files: DataFrame, components: DataFrame) -> DataFrame:
    """(path, target): components (id, name) that the markup of files (path, text) names as ``<c-my-part>``."""
    tags = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(COMPONENT_TAG), F.lit(1))).alias("tag")).distinct()
    own = components.select(F.lower("name").alias("key"), F.col("id").alias("target"))
    return tags.withColumn("key", F.lower(kebab_to_camel(F.col("tag")))).join(own, "key").select("path", "target").distinct()


def first_choice(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """One row of each ``by``: the first in the given order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("place = 1").drop("place")
