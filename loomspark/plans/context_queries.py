"""Queries over an entity graph and its pages: ownership, facts, questions, evaluation, views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.text import estimate_tokens, text_hash
from loomspark.operators import chunking, evaluation, facts, graph, ownership, render, search, views
from loomspark.plans import queries as base
from loomspark.sources.shared import stored
from loomspark.sources.tables import corpus, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# The graph: nations are services, regions teams, suppliers people, documents files.


def _patterns(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    team = F.when(F.col("r_name") != "ASIA", F.col("r_name"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("service"), team.alias("team"), F.concat(F.lit("^src"), "n_nationkey", F.lit("/.*$")).alias("regex"))


def _edges(spark, d):
    n, r, s, c = (table(spark, d, t) for t in ("nation", "region", "supplier", "customer"))
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    members = s.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("person"), F.col("r_name").alias("team"))
    pairs = c.join(s, F.col("c_custkey") == F.col("s_suppkey"))
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target"))
    depends = pairs.join(a, "c_nationkey").join(b, "s_nationkey").select("source", "target", F.lower("c_mktsegment").alias("via"))
    return ownership.ownership_edges(corpus(spark, d), _patterns(spark, d), members, depends)


def _owners(spark, d):
    return ownership.file_owners(corpus(spark, d), _patterns(spark, d), [(p, [who]) for p, who in base.OWNERS[2:]])


def _entities(spark, d):
    """(id, type, name, kind, path) of services, teams, people and files."""
    named = lambda t, c, type_: table(spark, d, t).select(F.concat(F.lit(f"{type_}:"), F.lower(c)).alias("id"), F.lit(type_).alias("type"), F.col(c).alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("path"))
    files = ownership.file_entities(corpus(spark, d)).withColumn("path", F.col("name"))
    return named("nation", "n_name", "service").unionByName(named("region", "r_name", "team")).unionByName(named("supplier", "s_name", "person")).unionByName(files)


@query
def ownership_edges(spark, d):
    return _edges(spark, d)


@query
def file_owners(spark, d):
    return _owners(spark, d)


@query
def file_kinds(spark, d):
    return views.counts_by(ownership.file_entities(corpus(spark, d)), kind="kind", type="type")


LABELS = {("owns", "in"): "owned by", ("owns", "out"): "owns", ("member_of", "in"): "members", ("depends_on", "out"): "depends on", ("depends_on", "in"): "used by", ("contains", "out"): "files"}


@query
def entity_facts(spark, d):
    """One line of facts for every service and team."""
    found = facts.describe(_entities(spark, d), _edges(spark, d), LABELS)
    return found.where("id LIKE 'service:%' OR id LIKE 'team:%'")


@query
def entity_json(spark, d):
    return facts.describe_json(_entities(spark, d).where("type <> 'file'"), _edges(spark, d))


# Questions: symbols are the first words of documents.


def _symbols(spark, d):
    c = corpus(spark, d).withColumn("name", F.regexp_extract("text", r"[A-Za-z_]+", 0)).where("name <> ''")
    kind = F.when(F.length("name") % 5 == 0, "property").otherwise("class")
    return c.groupBy("name").agg(F.min("path").alias("path"), F.count("*").alias("in_degree")).select(F.concat(F.lit("symbol:"), "name").alias("id"), F.lit("symbol").alias("type"), "name", kind.alias("kind"), "path", "in_degree")


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _named(spark, d):
    return facts.question_entities(_questions(spark, d), _symbols(spark, d), limit=20)


def _best(spark, d):
    """The best thirty hits of each question, stored: the corpus is scored once for facts and packs."""
    return stored(search.ranked(base._hits(spark, d), limit=30), "best")


def _behind(spark, d, best=None):
    """Entities behind the best five hits; of every third document the file is code, of even ones the first word is a heading."""
    c = corpus(spark, d).select("id", "path", F.when(F.col("id") % 2 == 0, F.regexp_extract("text", r"[A-Za-z_]+", 0)).alias("heading"))
    best = search.ranked(base._hits(spark, d), limit=5) if best is None else best.where("rank <= 5")
    hits = best.join(c, "id").select("query_id", "rank", "path", "heading")
    kind = F.when(F.col("id") % 3 == 0, "code").otherwise("doc")
    files = c.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("name"), kind.alias("kind"), "path")
    return facts.hit_entities(hits, _symbols(spark, d).drop("in_degree").unionByName(files))


@query
def question_entities(spark, d):
    return _named(spark, d)


@query
def hit_entities(spark, d):
    return _behind(spark, d)


@query
def entities_for_questions(spark, d):
    return facts.entities_for_questions(_named(spark, d), _behind(spark, d))


def _facts(spark, d, best=None):
    about = facts.entities_for_questions(_named(spark, d), _behind(spark, d, best))
    fact = F.concat(F.regexp_replace("id", "^[a-z]+:", ""), F.lit(" — "), F.substring_index("id", ":", 1))
    return facts.facts_within(about.select("query_id", "rank", fact.alias("fact")), budget=80)


@query
def question_facts(spark, d):
    return _facts(spark, d)


@query
def pack_with_facts(spark, d):
    """Packs whose facts come first and count against the budget."""
    best = _best(spark, d)
    top = best.join(corpus(spark, d).select("id", F.col("source_id").alias("path"), "hash", "tokens"), "id")
    sizes = _facts(spark, d, best).groupBy("query_id").agg(F.sum("tokens").alias("facts_tokens"))
    return search.pack_hits(top.select("query_id", "rank", "id", "path", "hash", "tokens"), budget=3000, facts=sizes)


@query
def search_modes(spark, d):
    """Questions answered by words, by vectors or by both, in turn by their number."""
    words = stored(search.search_mode(base._hits(spark, d), base._terms(spark, d), limit=50), "words")
    v = base._vectors(spark, d)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id")).distinct().join(v, "id").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    kinds = F.element_at(F.array(*map(F.lit, ("bm25", "vector", "hybrid"))), (F.col("item_id") % 3 + 1).cast("int"))
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), kinds.alias("retriever"))
    out = search.search_detailed(words, search.vector_top_k(v.select("id", "vector"), asked, 50), questions)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank", "mode", "retriever")


# Evaluation


def _expected(spark, d):
    """Two groups a question: the document of its number, and as alternatives the two after it."""
    rows = F.inline(F.array(*(F.struct(F.lit(g).alias("group"), F.concat(F.lit("doc_"), F.col("item_id") + i, F.lit(".md")).alias("expected")) for g, i in ((0, 0), (1, 1), (1, 2)))))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), rows)


def _recalls(spark, d):
    top = search.ranked(base._hits(spark, d), limit=50).join(corpus(spark, d).select("id", "path"), "id")
    return evaluation.question_recalls(_expected(spark, d), top.where("rank <= 10"), top)


@query
def question_recalls(spark, d):
    return _recalls(spark, d)


@query
def evaluation_report(spark, d):
    return evaluation.report(_recalls(spark, d))


# Views


@query
def document_chunks(spark, d):
    c = chunking.document_chunks(corpus(spark, d))
    return c.select("path", "chunk_no", "start_line", "end_line", "heading", "tokens", text_hash(F.col("text")).alias("hash"))


@query
def files_view(spark, d):
    files = ownership.file_entities(corpus(spark, d)).select(F.col("name").alias("path"), "kind").join(_owners(spark, d), "path")
    return views.files_view(corpus(spark, d), files, "SRC1")


def _lines(spark, d):
    lines = F.size(chunking.split_lines(F.col("text")))
    return corpus(spark, d).withColumns({"start_line": F.lit(1), "end_line": lines, "heading": F.when(F.col("id") % 2 == 0, F.col("lang"))})


@query
def chunk_rows(spark, d):
    return views.chunk_rows(_lines(spark, d), base._vectors(spark, d))


@query
def file_texts(spark, d):
    c = corpus(spark, d).withColumns({"start_line": F.col("id"), "path": F.concat_ws("/", "source_id", "lang")})
    return views.file_texts(c).select("path", text_hash(F.col("text")).alias("hash"), estimate_tokens(F.col("text")).alias("whole"), "tokens")


@query
def entity_list(spark, d):
    return views.entity_list(_entities(spark, d), graph.degrees(_edges(spark, d)), "service", "_1")


@query
def entity_chunks(spark, d):
    c = _lines(spark, d)
    spans = c.select(F.concat(F.lit("e"), "id").alias("id"), "path", F.when(F.col("id") % 4 > 0, F.col("id") % 40).alias("start_line"), (F.col("id") % 40 + 5).alias("end_line"))
    return views.entity_chunks(spans, c)


@query
def mentioned_in(spark, d):
    names = table(spark, d, "benchmark").select(F.explode(base.T.search_terms(F.col("text"))).alias("name"))
    found = graph.name_mentions(corpus(spark, d).select("id", "text"), names, 4).select(F.col("name").alias("entity"), "id")
    return views.mentioned_in(found, _lines(spark, d))


@query
def corpus_counts(spark, d):
    return views.counts_by(corpus(spark, d), language="lang", bucket="bucket")


@query
def chunks_by_source_type(spark, d):
    c = corpus(spark, d)
    sources = c.select("source_id").distinct().withColumn("type", F.when(F.length("source_id") % 2 == 0, "code").otherwise("markdown"))
    return views.chunks_with_sources(c, sources, ["markdown"]).groupBy("source_type", "source_id").agg(F.count("*").alias("n"))


def _states(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("src"), F.col("user_id") % 40).alias("source_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))


@query
def latest_sources(spark, d):
    return views.latest_sources(_states(spark, d), corpus(spark, d).select("source_id"))


@query
def operations_by_user(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("operations"))


@query
def corpus_findings(spark, d):
    """Findings about a log of which each event is a question: views are fall-backs, errors found nothing."""
    e = table(spark, d, "events")
    mode = F.when(F.col("event_type") == "view", "any").otherwise("all")
    log = e.select(mode.alias("mode"), F.when(F.col("event_type") == "error", 0).otherwise(5).alias("candidates"), F.when(F.col("value") > 40, 1).otherwise(0).alias("over_budget"), F.array(F.concat(F.lit("src"), F.col("user_id") % 13)).alias("sources"))
    c = corpus(spark, d)
    sources = c.select("source_id").distinct().unionByName(spark.range(3).select(F.concat(F.lit("new"), "id").alias("source_id")))
    return views.findings(log, c, sources, base._vectors(spark, d), most=1000)


@query
def search_references(spark, d):
    """Where the best twenty hits of each question are, without their texts."""
    top = search.ranked(base._hits(spark, d), limit=20).join(_lines(spark, d).select("id", "path", "start_line", "end_line", "tokens"), "id")
    return top.select("query_id", "rank", render.citation(F.col("path"), F.col("start_line"), F.col("end_line")).alias("place"), "tokens")


@query
def render_pack_json(spark, d):
    c = _lines(spark, d).select("id", "bucket", "path", "start_line", "end_line", "text", "tokens", "hash")
    top = search.ranked(base._hits(spark, d), limit=30).join(c.select("id", "path", "hash", "tokens"), "id")
    packed = search.pack_hits(top.select("query_id", "rank", "id", "path", "hash", "tokens"), budget=3000).where("decision = 'included'")
    return render.json_packs(packed.select("query_id", "rank", "id").join(c, "id"))


@query
def name_parts(spark, d):
    """Folders, camel-case names, outer and inner names, and ids made from the paths of the corpus."""
    c = corpus(spark, d)
    dotted, kebab = F.concat_ws(".", "source_id", "lang", F.concat(F.lit("Doc"), "id")), F.concat_ws("-", "source_id", "lang", "bucket")
    return c.select("id", T.folder_of(F.col("path")).alias("folder"), T.kebab_to_camel(kebab).alias("camel"), T.class_of(dotted).alias("outer_name"), T.short_name(dotted).alias("inner_name"), T.entity_id("file", F.col("path")).alias("file_id"), T.entity_id("service", F.concat(F.lit("Svc"), "source_id")).alias("service_id"), T.symbol_id(dotted, F.col("path")).alias("symbol_id"))
