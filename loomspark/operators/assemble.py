"""One plan from files to a typed graph: entities with attributes, edges, and mentions in prose.

The steps follow each other by what they need, as joins of tables: files; ownership; the structure of code; metadata;
references and calls, once all names are known; history; deferred names last. Each gives entities and edges with the number of its
step, so that merging is an aggregation: the first writer of an attribute wins, and counts of an edge add up. Attributes
are dynamic: a VARIANT object of whatever keys the writers have. Edges of which an end is no entity go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import detect_language, symbol_id
from loomspark.operators import code, metadata, resolve
from loomspark.operators.graph import co_changes, top_partners
from loomspark.operators.masking import lines_of, masked_files, with_depths
from loomspark.operators.mentions import phrase_mentions
from loomspark.sources.shared import stored

#: Kinds of declarations that are types, entities that prose may mention, languages with packages, of scripts, of markup.
TYPE_KINDS = ("class", "interface", "enum", "trigger", "record", "struct", "trait", "object", "module", "namespace", "protocol", "extension", "impl")
MENTIONED = ("symbol", "object", "service", "team", "component", "flow")
PACKAGED = ("java", "kotlin", "groovy", "scala")
SCRIPTS, MARKUP = ("javascript", "typescript"), "html"

#: What a trigger stands on, what a query reads, names in code, folders of components.
TRIGGER_ON = r"(?i)\btrigger\s+\w+\s+on\s+(\w+)"
QUERY_FROM = r"(?i)\bFROM\s+([A-Za-z_]\w*)"
CAPITAL_NAME = r"\b[A-Z][A-Za-z0-9_]*\b"
CUSTOM_NAME = r"\b\w+__[cr]\b"
COMPONENT_FOLDER = r"(?:^|/)(lwc|aura)/([^/]+)/"

ENTITY = ["id", "type", "name", "attrs", "step"]
EDGE = ["src", "dst", "kind", "n", "via", "step"]


@dataclass
class Graph:
    """``entities`` (id, type, name, attrs VARIANT), ``edges`` (src, dst, kind, n, via), ``mentions`` (id, entity_id)."""

    entities: DataFrame
    edges: DataFrame
    mentions: DataFrame | None


def _entities(rows: DataFrame, step: int, type_: str, id_: Column, name: Column, **attrs: Column) -> DataFrame:
    """Rows as entities; attributes that are null are left out of a row's object."""
    return rows.select(id_.alias("id"), F.lit(type_).alias("type"), name.alias("name"), (F.to_json(F.struct(*(c.alias(k) for k, c in attrs.items()))) if attrs else F.lit("{}")).alias("attrs"), F.lit(step).alias("step"))


def _edges(rows: DataFrame, step: int, src: Column, dst: Column, kind: str, n: Column | None = None, via: Column | None = None) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), (F.lit(None) if n is None else n).cast("long").alias("n"), (F.lit(None) if via is None else via).cast("string").alias("via"), F.lit(step).alias("step"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _of(type_: str, name: Column) -> Column:
    return F.concat(F.lit(f"{type_}:"), name)


def merged_entities(rows: DataFrame) -> DataFrame:
    """(id, type, name, attrs): rows (id, type, name, attrs as JSON, step) of one entity as one, key by key the first writer's value."""
    keys = rows.select("id", "step", F.explode(F.from_json("attrs", "map<string,variant>")).alias("key", "value"))
    values = keys.select("id", "key", "step", F.to_json("value").alias("value")).groupBy("id", "key").agg(F.min(F.struct("step", "value")).alias("v"))
    quoted = F.regexp_replace(F.to_json(F.array("key")), r"^\[|\]$", "")
    pairs = values.groupBy("id").agg(F.array_sort(F.collect_list(F.concat(quoted, F.lit(":"), "v.value"))).alias("pairs"))
    first = rows.groupBy("id").agg(F.min(F.struct("step", "type", "name")).alias("f"))
    attrs = F.parse_json(F.concat(F.lit("{"), F.coalesce(F.array_join("pairs", ","), F.lit("")), F.lit("}")))
    return first.join(pairs, "id", "left").select("id", "f.type", "f.name", attrs.alias("attrs"))


def merged_edges(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst, kind, n, via): counts of one edge add up, its first ``via`` stays; loops and edges without an end go."""
    known = entities.select("id")
    one = rows.where("src <> dst").groupBy("src", "dst", "kind").agg(F.sum("n").alias("n"), F.min_by("via", F.when(F.col("via").isNotNull(), F.struct("step", "via"))).alias("via"))
    return one.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind", "n", "via")


def source_of(files: DataFrame) -> DataFrame:
    """What the graph needs of source files (path, text, language), found in one pass over their texts.

    (path, language, code, imports, heads, text): masked lines; names that packaged languages import; (start_line, head) of
    lines that may begin a trigger, with the two lines after each; the text of scripts and markup only.
    """
    head = lambda line, i: F.when(F.contains(line, F.lit("trigger")), F.struct((i + 1).alias("start_line"), F.array_join(F.slice("lines", i + 1, F.lit(3)), "\n").alias("head")))
    heads = F.filter(F.transform("lines", head), lambda h: h.isNotNull())
    imports = F.when(F.col("language").isin(*PACKAGED), resolve.imported_names(F.col("text")))
    text = F.when(F.col("language").isin(*SCRIPTS, MARKUP), F.col("text"))
    return masked_files(files).select("path", "language", "code", imports.alias("imports"), heads.alias("heads"), text.alias("text"))


def structure(files: DataFrame, declared: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Entities and edges of code, and (path, src): the entity that a file's references start from.

    That is the file's component, else its first type, else the file.
    """
    own = _of("file", F.col("path"))
    sym = symbol_id(F.col("qualified"), F.col("path"))
    decl = declared.join(files.select("path", "language"), "path")
    entities = [_entities(decl, 3, "symbol", sym, F.col("qualified"), kind=F.col("kind"), language=F.col("language"), path=F.col("path"), start_line=F.col("start_line"), end_line=F.col("end_line"), simple=F.col("name"))]
    top = ~F.contains("qualified", F.lit("."))
    parent = F.regexp_extract("qualified", r"^(.*)\.[^.]+$", 1)
    edges = [_edges(decl.where(top), 3, own, sym, "declares"), _edges(decl.where(~top), 3, symbol_id(parent, F.col("path")), sym, "contains")]
    heads = files.select("path", F.inline("heads"))
    on = decl.where("kind = 'trigger'").join(heads, ["path", "start_line"]).select("qualified", "path", "head")
    on = on.withColumn("object", F.regexp_extract("head", TRIGGER_ON, 1)).where("object <> ''")
    standard = lambda c: ~c.endswith("__c")
    entities.append(_entities(on, 3, "object", _of("object", F.col("object")), F.col("object"), standard=standard(F.col("object"))))
    edges.append(_edges(on, 3, sym, _of("object", F.col("object")), "triggers_on"))
    parts = files.select("path", F.regexp_extract("path", COMPONENT_FOLDER, 1).alias("kind"), F.regexp_extract("path", COMPONENT_FOLDER, 2).alias("component")).where("component <> ''")
    entities.append(_entities(parts, 3, "component", _of("component", F.col("component")), F.col("component"), kind=F.col("kind")))
    edges.append(_edges(parts, 3, own, _of("component", F.col("component")), "part_of"))
    read = files.where("language = 'apex'").select(F.array_join("code", "\n").alias("code"))
    asked = read.select(F.explode(F.regexp_extract_all("code", F.lit(QUERY_FROM), F.lit(1))).alias("object")).where(F.col("object").rlike("^[A-Z]")).distinct()
    entities.append(_entities(asked, 3, "object", _of("object", F.col("object")), F.col("object"), standard=standard(F.col("object"))))
    types = decl.where(top & F.col("kind").isin(*TYPE_KINDS)).groupBy("path").agg(F.min_by(sym, F.struct("start_line", -F.col("end_line"))).alias("type"))
    primary = files.select("path").join(types, "path", "left").join(parts.select("path", "component"), "path", "left")
    return entities, edges, primary.select("path", F.coalesce(_of("component", F.col("component")), "type", own).alias("src"))


def reference_edges(files: DataFrame, lines: DataFrame, primary: DataFrame, entities: DataFrame) -> list[DataFrame]:
    """References of files to types, objects and fields by their names in code, and of components' scripts and markup."""
    names = entities.select("id", "type", F.lower("name").alias("key"), F.variant_get("attrs", "$.kind", "string").alias("kind"), F.variant_get("attrs", "$.path", "string").alias("path"))
    types = names.where((F.col("type") == "symbol") & ~F.contains("key", F.lit(".")) & F.col("kind").isin(*TYPE_KINDS))
    objects, fields = names.where("type = 'object'").select("key", F.col("id").alias("object")), names.where("type = 'field'")
    words = lines.select("path", F.explode(F.regexp_extract_all("code", F.lit(CAPITAL_NAME), F.lit(0))).alias("word")).groupBy("path", F.lower("word").alias("key")).agg(F.count("*").alias("n"))
    self_name = primary.join(entities.select(F.col("id").alias("src"), F.lower("name").alias("own")), "src").select("path", "src", "own")
    used = words.join(self_name, "path").where("key <> own").select("path", "src", "key", "n", F.concat_ws("|", "path", "key").alias("ref"))
    packaged = files.where(F.col("language").isin(*PACKAGED))
    found = resolve.resolve_by_imports(used.select("ref", "key", "path"), types.select("key", F.col("id").alias("target"), "path"), resolve.imports_of(packaged))
    known = types.select("key").distinct().withColumn("is_type", F.lit(True))
    hits = used.join(found, "ref").join(known, "key", "left").join(objects, "key", "left")
    # A name of types that stays ambiguous means none of them, and no object either.
    out = [_edges(hits.withColumn("to", F.when(F.col("is_type"), F.col("target")).otherwise(F.col("object"))).where("to is not null"), 5, F.col("src"), F.col("to"), "references", F.col("n"))]
    custom = lines.select("path", F.explode(F.regexp_extract_all("code", F.lit(CUSTOM_NAME), F.lit(0))).alias("word")).groupBy("path", F.lower("word").alias("key")).agg(F.count("*").alias("n")).join(primary, "path")
    whole = fields.select("key", F.col("id").alias("field"))
    simple = fields.groupBy(F.substring_index("key", ".", -1).alias("key")).agg(F.count("*").alias("m"), F.collect_list("id").alias("of_name")).where("m <= 2")  # more objects have it: too ambiguous
    targets = custom.join(objects, "key", "left").join(whole, "key", "left").join(simple, "key", "left")
    to = F.coalesce(F.when(F.col("object").isNotNull(), F.array("object")), F.when(F.col("field").isNotNull(), F.array("field")), "of_name")
    out.append(_edges(targets.select("src", "n", F.explode(to).alias("to")), 5, F.col("src"), F.col("to"), "references", F.col("n")))
    scripts = files.where(F.col("language").isin(*SCRIPTS))
    single = types.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("id")).where("m = 1").select("id", F.col("key").alias("name"))
    methods = names.where((F.col("type") == "symbol") & F.contains("key", F.lit("."))).select("id", F.col("key").alias("name"))
    things = objects.select(F.col("object").alias("id"), F.col("key").alias("name")).unionByName(fields.select("id", F.col("key").alias("name")))
    imported = resolve.import_references(scripts, methods.unionByName(single), things).join(primary, "path")
    out.append(_edges(imported.where("via = 'import'"), 5, F.col("src"), F.col("target"), "calls"))
    out.append(_edges(imported.where("via = 'schema'"), 5, F.col("src"), F.col("target"), "references", F.lit(1)))
    components = names.where("type = 'component'").select("id", F.col("key").alias("name"))
    tags = resolve.component_tags(files.where(F.col("language") == MARKUP), components).join(primary, "path")
    out.append(_edges(tags, 5, F.col("src"), F.col("target"), "uses"))
    return out


def history_edges(commits: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """People and what they wrote, files that change together, and the files' last change: of commits (commit, author, day, path)."""
    touched = commits.select("commit", "author", "day", F.col("path").alias("file")).distinct()
    own = lambda c: _of("file", F.col(c))
    last = touched.groupBy("file").agg(F.countDistinct("commit").alias("commits"), F.max(F.struct("day", "commit", "author")).alias("last"))
    entities = [_entities(touched.select("author").distinct(), 6, "person", _of("person", F.lower("author")), F.col("author")), _entities(last, 6, "file", own("file"), F.col("file"), commits=F.col("commits"), last_author=F.col("last.author"), last_day=F.col("last.day").cast("string"))]
    edges = [_edges(touched.groupBy("author", "file").agg(F.countDistinct("commit").alias("n")), 6, _of("person", F.lower("author")), own("file"), "authored", F.col("n"))]
    pairs = top_partners(co_changes(touched.select("commit", "file")))
    edges.append(_edges(pairs, 6, own("a"), own("b"), "co_changed", F.col("n")))
    return entities, edges


def build_graph(files: DataFrame, ownership: DataFrame | None = None, owners: DataFrame | None = None, commits: DataFrame | None = None, prose: DataFrame | None = None, keep=stored) -> Graph:
    """The graph of files (path, text, source_type: code, markdown or text).

    ``ownership``: edges (src, dst, kind, via) of teams, people and services; ``owners``: (path, service, owner) of files;
    ``commits``: (commit, author, day, path); ``prose``: texts (id, text) in which entities are mentioned. ``keep`` stores
    what several steps read. Null texts count as files without content; repeated paths
    merge; an empty table gives an empty graph.
    """
    plain = files.select("path", "text", "source_type", detect_language(F.col("path")).alias("language"))
    kind = F.when(F.col("source_type") == "code", "code").when(F.col("source_type") == "markdown", "doc").otherwise("text")
    entities = [_entities(plain, 0, "file", _of("file", F.col("path")), F.col("path"), kind=kind, language=F.when(F.col("source_type") == "code", F.col("language")))]
    edges: list[DataFrame] = []
    if ownership is not None:
        ends = ownership.select(F.col("src").alias("id")).unionByName(ownership.select(F.col("dst").alias("id"))).distinct().where("id not like 'file:%'")
        split = ends.select(F.substring_index("id", ":", 1).alias("type"), F.expr("substring(id, instr(id, ':') + 1)").alias("name"), "id")
        entities += [_entities(split.where(F.col("type") == t), 1, t, F.col("id"), F.col("name")) for t in ("team", "person", "service")]
        edges.append(ownership.select("src", "dst", "kind", F.lit(None).cast("long").alias("n"), "via", F.lit(1).alias("step")))
    if owners is not None:
        entities.append(_entities(owners, 2, "file", _of("file", F.col("path")), F.col("path"), service=F.col("service"), owner=F.col("owner")))
    source = keep(source_of(plain.where("source_type = 'code' AND text is not null")), "source")
    lines = keep(with_depths(lines_of(source)), "lines")
    declared = keep(code.declarations(lines), "declared")
    own_entities, own_edges, primary = structure(source, declared)
    primary = keep(primary, "primary")
    entities, edges = entities + own_entities, edges + own_edges
    data = files.where(F.col("path").endswith("-meta.xml") & F.col("text").isNotNull()).select("path", "text")
    meta, links = keep(metadata.metadata_files(data), "definitions"), keep(metadata.metadata_edges(data), "metadata")
    named = F.expr("substring(id, instr(id, ':') + 1)")
    entities += [_entities(meta.where(F.col("type") == t), 4, t, F.col("id"), named, path=F.col("path")) for t in metadata.PATHS]
    objects = links.where("dst like 'object:%'").select(F.col("dst").alias("id")).distinct()
    entities.append(_entities(objects, 4, "object", F.col("id"), named, standard=~F.col("id").endswith("__c")))
    edges.append(links.where("dst not like 'name:%'").select("src", "dst", "kind", F.lit(None).cast("long").alias("n"), F.col("detail").alias("via"), F.lit(4).alias("step")))
    if commits is not None:
        more_entities, more_edges = history_edges(commits.join(files.select("path").distinct(), "path", "left_semi"))
        entities, edges = entities + more_entities, edges + more_edges
    whole = keep(merged_entities(_union(entities)), "entities")
    referred = keep(_union(reference_edges(source, lines, primary, whole)), "references")
    edges.append(referred)
    refs = referred.where("kind = 'references' AND dst like 'symbol:%'").join(primary, "src").select("path", F.expr("substring(dst, 8)").alias("target"))
    called = code.resolve_calls(code.calls(lines, declared), declared, refs)
    edges.append(_edges(called, 5, symbol_id(F.col("caller"), F.col("path")), symbol_id(F.col("target"), F.col("target_path")), "calls", F.col("n")))
    pending = links.where("dst like 'name:%'").select("src", "kind", F.expr("substring(dst, 6)").alias("name"))
    rungs = [whole.where((F.col("type") == "symbol") & ~F.contains("name", F.lit("."))), *(whole.where(F.col("type") == t) for t in ("object", "component", "flow"))]
    late = resolve.resolve_deferred(pending, [r.select("id", "name") for r in rungs])
    edges.append(_edges(late, 7, F.col("src"), F.col("target"), "calls"))
    found = None
    if prose is not None:
        plain_names = whole.where(F.col("type").isin(*MENTIONED) & ~((F.col("type") == "symbol") & F.contains("name", F.lit("."))))
        found = phrase_mentions(prose, plain_names.select(F.col("id").alias("entity_id"), "name"))
    return Graph(whole, merged_edges(_union(edges), whole), found)
