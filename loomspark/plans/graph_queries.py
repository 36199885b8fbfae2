"""Queries over a graph that is assembled from source files made of all documents: a class each, around the document as a comment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import masking
from loomspark.operators.assemble import Graph, build_graph
from loomspark.operators.mentions import phrase_mentions
from loomspark.sources.tables import corpus, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Names of classes repeat after so many documents; every third one imports the class of the document ``AHEAD`` of it.
NAMES, AHEAD = 97, 13


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """(id, path, text, source_type): a Java file a document."""
    docs = corpus(spark, d).select("id", "source_id", "lang", "text")
    ahead = docs.select((F.col("id") - AHEAD).alias("id"), F.concat_ws(".", "source_id", "lang").alias("package"))
    # Texts are shuffled of those documents only that can have an import.
    third = F.coalesce(F.col("id") % 3 == 0, F.lit(False))
    rows = docs.where(third).join(ahead.where(third), "id", "left").unionByName(docs.where(~third).withColumn("package", F.lit(None).cast("string")))
    own, other = F.col("id") % NAMES, F.when(F.col("package").isNotNull(), (F.col("id") + AHEAD) % NAMES).otherwise((F.col("id") + 1) % NAMES)
    imported = F.when(F.col("package").isNotNull(), F.concat(F.lit("import "), "package", F.lit(".Kind"), other, F.lit(";\n"))).otherwise("")
    body = F.concat(F.lit("package "), "source_id", F.lit("."), "lang", F.lit(";\n"), imported, F.lit("/* "), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit(" ")), F.lit(" */\npublic class Kind"), own, F.lit(" {\n  Kind"), other, F.lit(" other;\n  void go() {\n    stop();\n  }\n  void stop() {\n  }\n}\n"))
    return rows.select("id", F.concat(F.lit("src/"), "source_id", F.lit("/"), "lang", F.lit("/Kind"), own, F.lit("_"), "id", F.lit(".java")).alias("path"), body.alias("text"), F.lit("code").alias("source_type"))


def _graph(spark, d) -> Graph:
    return build_graph(source_files(spark, d).drop("id"))


@query
def graph_edges(spark, d):
    """All edges of the assembled graph: declares, contains, references (by imports, packages and folders) and calls."""
    return _graph(spark, d).edges.select("src", "dst", "kind", "n")


@query
def graph_entities(spark, d):
    """All entities with attributes that differ by type, read from VARIANT."""
    attr = lambda key, kind="string": F.variant_get("attrs", f"$.{key}", kind).alias(key)
    return _graph(spark, d).entities.select("id", "type", "name", attr("kind"), attr("language"), attr("path"), attr("simple"), (F.variant_get("attrs", "$.end_line", "int") - F.variant_get("attrs", "$.start_line", "int")).alias("lines"))


@query
def masked_code(spark, d):
    """How much of each file is left of its code, and how deep its braces go."""
    lines = masking.with_depths(masking.masked_lines(source_files(spark, d).select("path", "text")))
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.length(F.regexp_replace("code", r"\s+", ""))).alias("code"), F.max("after").alias("deepest"))


@query
def phrases_in_documents(spark, d):
    """Which phrases of three words, each a question's first, occur in which documents."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.array_join(F.slice(words, 1, 3), " ").alias("name"))
    return phrase_mentions(corpus(spark, d).select("id", "text"), names)


_FILES = rf"""c AS (SELECT d.doc_id AS id, d.source, d.lang, d.text, d.doc_id % {NAMES} AS m, a.source AS s2, a.lang AS l2,
    'src/' || d.source || '/' || d.lang || '/Kind' || d.doc_id % {NAMES} || '_' || d.doc_id || '.java' AS path,
    CASE WHEN a.doc_id IS NOT NULL THEN (d.doc_id + {AHEAD}) % {NAMES} ELSE (d.doc_id + 1) % {NAMES} END AS o
  FROM documents d LEFT JOIN documents a ON a.doc_id = d.doc_id + {AHEAD} AND d.doc_id % 3 = 0)"""

_SYMBOL = "'symbol:Kind' || {0}m || '@' || {0}path"

ORACLE_SQL: dict[str, str] = {
    "graph_edges": f"""WITH {_FILES},
      n AS (SELECT m, count(*) AS n FROM c GROUP BY 1),
      r AS (SELECT c.path, {_SYMBOL.format("c.")} AS src, CASE WHEN c.s2 IS NULL THEN 1 ELSE 2 END AS uses,
        CASE WHEN n.n = 1 THEN (SELECT min({_SYMBOL.format("x.")}) FROM c x WHERE x.m = c.o)
          ELSE coalesce((SELECT arg_min({_SYMBOL.format("x.")}, x.path) FROM c x WHERE x.m = c.o AND x.source = c.s2 AND x.lang = c.l2), (SELECT arg_min({_SYMBOL.format("x.")}, x.path) FROM c x WHERE x.m = c.o AND x.source = c.source AND x.lang = c.lang)) END AS dst
        FROM c JOIN n ON n.m = c.o WHERE c.o <> c.m)
      SELECT src, dst, 'references' AS kind, CAST(uses AS BIGINT) AS n FROM r WHERE dst IS NOT NULL
      UNION ALL SELECT 'file:' || path, {_SYMBOL.format("")}, 'declares', NULL FROM c
      UNION ALL SELECT {_SYMBOL.format("")}, 'symbol:Kind' || m || '.' || f || '@' || path, 'contains', NULL FROM c, (SELECT unnest(['go', 'stop']) AS f)
      UNION ALL SELECT 'symbol:Kind' || m || '.go@' || path, 'symbol:Kind' || m || '.stop@' || path, 'calls', 1 FROM c""",
    "graph_entities": f"""WITH {_FILES}
      SELECT 'file:' || path AS id, 'file' AS type, path AS name, 'code' AS kind, 'java' AS language, NULL AS path, NULL AS simple, CAST(NULL AS INTEGER) AS lines FROM c
      UNION ALL SELECT {_SYMBOL.format("")}, 'symbol', 'Kind' || m, 'class', 'java', path, 'Kind' || m, 7 FROM c
      UNION ALL SELECT 'symbol:Kind' || m || '.' || f || '@' || path, 'symbol', 'Kind' || m || '.' || f, 'function', 'java', path, f, CASE f WHEN 'go' THEN 2 ELSE 1 END FROM c, (SELECT unnest(['go', 'stop']) AS f)""",
    "masked_code": rf"""WITH {_FILES} SELECT path, CAST(len(string_split(replace(coalesce(text, ''), '*/', ' '), chr(10))) + CASE WHEN s2 IS NULL THEN 1 ELSE 2 END + 8 AS BIGINT) AS lines,
      CAST(length('package' || source || '.' || lang || ';') + CASE WHEN s2 IS NULL THEN 0 ELSE length('import' || s2 || '.' || l2 || '.Kind' || o || ';') END
        + length('publicclassKind' || m || '{{Kind' || o || 'other;voidgo(){{stop();}}voidstop(){{}}}}') AS BIGINT) AS code, 2 AS deepest FROM c""",
}
