"""The queries over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.embedding import hash_embeddings
from loomspark.operators import chunking, graph, render, search, tables
from loomspark.sources.tables import corpus, table
from loomspark.streaming.ingest import tumbling_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The rules of the ownership and claim queries, in the order of the file.
OWNERS = [("**", "core"), ("src1/**", "team-one"), ("**/en/**", "english"), ("src1?/fr/*.md", "french")]
SOURCES = [("first", "src0/**"), ("spanish", "**/es/*.md"), ("teens", "src1[0-9]"), ("rest", "**/*.md")]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# Texts and chunks


@query
def token_estimate(spark, d):
    return corpus(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))


@query
def chunk_identity(spark, d):
    c = corpus(spark, d)
    return c.select("id", T.chunk_id(F.col("source_id"), F.col("path"), F.col("text")).alias("chunk_id"), "hash")


@query
def line_windows(spark, d):
    return chunking.line_windows(corpus(spark, d)).select("id", "window_no", "start_line", "end_line", "tokens", T.text_hash(F.col("body")).alias("hash"))


@query
def heading_sections(spark, d):
    return chunking.heading_sections(corpus(spark, d)).select("id", "section_no", "heading", "start_line", "end_line")


@query
def query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(T.query_terms(F.col("text"))).alias("pos", "term"))


@query
def search_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(T.search_terms(F.col("text"))).alias("pos", "term"))


@query
def identifier_terms(spark, d):
    p = table(spark, d, "part")
    name = F.concat_ws("_", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.regexp_replace("p_type", "[^A-Za-z0-9]", "_"))
    return p.select("p_partkey", F.array_join(T.identifier_terms(name), " ").alias("terms"))


# Paths


@query
def glob_filter(spark, d):
    c = corpus(spark, d)
    return c.where(T.matches_glob(F.col("path"), "src1*/**/doc_?[0-4]*.md", "src2/en")).select("id", "path")


@query
def path_prefix_filter(spark, d):
    c = corpus(spark, d)
    return c.where(F.lower("path").startswith("src1/") & F.col("bucket").isin("knowledge", "norms")).select("id", "path", "bucket")


@query
def claim_first_source(spark, d):
    c = corpus(spark, d)
    return c.select("id", graph.first_claim(c, SOURCES).alias("claimed_by"))


@query
def codeowners_last_match(spark, d):
    c = corpus(spark, d)
    return c.select("id", graph.last_match(c, OWNERS).alias("owner"))


@query
def test_paths(spark, d):
    c = corpus(spark, d).withColumn("path", F.concat_ws("/", "source_id", F.when(F.col("id") % 5 == 0, "test").otherwise("main"), F.concat(F.lit("Doc"), "id", F.when(F.col("id") % 7 == 0, "Spec").otherwise(""), F.lit(".kt"))))
    return c.groupBy("source_id").agg(F.count_if(T.is_test_path(F.col("path"))).alias("tests"), F.count_if(T.detect_language(F.col("path")) == "kotlin").alias("kotlin"))


# Full text


def _posts(spark, d):
    return search.postings(corpus(spark, d), "id")


def _terms(spark, d):
    return search.question_terms(table(spark, d, "benchmark"), "item_id")


@query
def postings(spark, d):
    return _posts(spark, d)


@query
def corpus_stats(spark, d):
    s = search.corpus_statistics(_posts(spark, d))
    return s.agg(F.count("*").alias("n_docs"), F.sum("length").alias("length"), F.round(F.max("mean_length"), 6).alias("mean_length"))


def _hits(spark, d):
    return search.bm25(corpus(spark, d), _terms(spark, d))


def _shown(hits):
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_loose(spark, d):
    return _shown(search.ranked(_hits(spark, d), limit=10))


@query
def bm25_strict(spark, d):
    return _shown(search.ranked(_hits(spark, d).where("strict"), limit=10))


@query
def bm25_filtered(spark, d):
    kept = corpus(spark, d).where("bucket = 'knowledge' AND lang = 'en'").select("id")
    return _shown(search.ranked(_hits(spark, d).join(kept, "id", "left_semi"), limit=10))


@query
def bm25_adjusted(spark, d):
    info = corpus(spark, d).select("id", F.when(F.col("bucket") == "norms", 0.5).otherwise(1.0).alias("penalty"), (F.col("id") % 10).alias("importance"))
    hits = _hits(spark, d).join(info, "id")
    return _shown(search.ranked(search.adjusted(hits, F.col("penalty"), F.col("importance"), 0.15), limit=10))


@query
def bm25_mode_rrf(spark, d):
    """Strict and loose hits of each question, fused; with the mode that answered."""
    return search.search_mode(_hits(spark, d), _terms(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"), "rank", "mode")


@query
def rerank_head(spark, d):
    """The best twenty hits, of which the first ten in the order of the share of the question's terms that they hold."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.transform(T.search_terms(F.col("text")), lambda t: F.lower(t)).alias("asked"))
    top = search.ranked(_hits(spark, d), limit=20).join(corpus(spark, d).select("id", "text"), "id").join(asked, "query_id")
    return search.rerank(top, search.covered_terms(F.col("asked"), F.col("text")), 10).select("query_id", "id", "rank")


# Vectors


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _nearest(spark, d, k, where="true"):
    v = _vectors(spark, d)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))  # the stated queries
    return search.vector_top_k(v.where(where).select("id", "vector"), asked, k)


@query
def vector_topk(spark, d):
    return _shown(_nearest(spark, d, 10))


@query
def vector_topk_filtered(spark, d):
    return _shown(_nearest(spark, d, 10, "label % 3 = 0"))


@query
def near_dup_greedy(spark, d):
    hits = _nearest(spark, d, 30).join(_vectors(spark, d).select("id", "vector"), "id")
    return search.drop_near_duplicates(hits, 0.9)


@query
def rrf_hybrid(spark, d):
    """BM25 fused with the nearest vectors; a question's vector is the one that carries its number."""
    words = search.ranked(_hits(spark, d), limit=50)
    v = _vectors(spark, d)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id")).distinct().join(v, "id").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    near = search.vector_top_k(v.select("id", "vector"), asked, 50)
    return _shown(search.reciprocal_rank_fusion([(words, 1.0), (near, 1.0)], k=60, limit=10))


@query
def pack_decisions(spark, d):
    top = search.ranked(_hits(spark, d), limit=30).join(corpus(spark, d).select("id", F.col("source_id").alias("path"), "hash", "tokens"), "id")
    return search.pack_hits(top.select("query_id", "rank", "id", "path", "hash", "tokens"), budget=3000)


@query
def bm25_stemmed(spark, d):
    return _shown(search.ranked(search.bm25_stemmed(corpus(spark, d), _terms(spark, d)), limit=10))


@query
def hash_embed(spark, d):
    v = hash_embeddings(corpus(spark, d))
    return v.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("square"))


@query
def render_pack_markdown(spark, d):
    c = corpus(spark, d).select("id", "bucket", "path", "text", "tokens", "hash")
    top = search.ranked(_hits(spark, d), limit=30).join(c, "id")
    packed = search.pack_hits(top.select("query_id", "rank", "id", "path", "hash", "tokens"), budget=3000).where("decision = 'included'")
    lines = F.size(chunking.split_lines(F.col("text")))
    rows = packed.join(c.select("id", "bucket", "text"), "id").select("query_id", "rank", "bucket", "path", F.lit(1).alias("start_line"), lines.alias("end_line"), "text")
    return render.markdown_packs(rows)


# Markup


@query
def page_structure(spark, d):
    return render.page_structure(table(spark, d, "pages"))


@query
def page_links(spark, d):
    return render.page_links(table(spark, d, "pages"))


# Upkeep of tables


@query
def incremental_diff(spark, d):
    c = corpus(spark, d).select("id", "source_id", "path", "text")
    key = T.chunk_id(F.col("source_id"), F.col("path"), F.col("text")).alias("id")
    new = c.where("id % 11 <> 0").withColumn("text", F.when(F.col("id") % 13 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return tables.content_diff(c.select(key), new.select(key)).groupBy("status").agg(F.count("*").alias("n"))


@query
def missing_embeddings(spark, d):
    done = _vectors(spark, d).select("id")
    return tables.missing(corpus(spark, d).select("id", "source_id"), done, "id").groupBy("source_id").agg(F.count("*").alias("n"))


@query
def prune_sources(spark, d):
    """Chunks of the sources that are still configured: here those that some user's log names."""
    configured = _log(spark, d).select(F.concat(F.lit("src"), F.col("user") % 13).alias("source_id")).distinct()
    return corpus(spark, d).join(configured, "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("n"))


# Graph


def _touches(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).distinct()


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("part:"), "l_partkey").alias("src"), F.concat(F.lit("supplier:"), "l_suppkey").alias("dst"), F.lower("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))


@query
def co_change(spark, d):
    return graph.co_changes(_touches(spark, d))


@query
def co_change_top10(spark, d):
    return graph.top_partners(graph.co_changes(_touches(spark, d)), 10)


@query
def authored(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"))
    return _touches(spark, d).join(o, "commit").groupBy("author", "file").agg(F.count("*").alias("commits"))


@query
def last_toucher(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("day"))
    last = F.max(F.struct("day", "commit", "author")).alias("last")
    return _touches(spark, d).join(o, "commit").groupBy("file").agg(F.count("*").alias("commits"), last).select("file", "commits", F.col("last.author").alias("author"))


@query
def ownership_propagation(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    own = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.select("s_suppkey", F.when(F.col("s_acctbal") < 0, F.lit("unassigned")).otherwise(F.col("r_name")).alias("owner"), F.col("n_name").alias("service"))


@query
def reference_counts(spark, d):
    """How often each term of the questions is named, and in how many documents."""
    names = table(spark, d, "benchmark").select(F.explode(T.search_terms(F.col("text"))).alias("name"))
    return graph.name_mentions(corpus(spark, d).select("id", "text"), names, 1).groupBy("name").agg(F.count("*").alias("documents"), F.sum("n").alias("mentions"))


@query
def mentions(spark, d):
    names = table(spark, d, "benchmark").select(F.explode(T.search_terms(F.col("text"))).alias("name"))
    return graph.name_mentions(corpus(spark, d).select("id", "text"), names, 4)


@query
def resolve_unique(spark, d):
    c = table(spark, d, "customer")
    cand = c.select(F.col("c_custkey").alias("target"), (F.col("c_custkey") % 701).alias("key"), F.col("c_nationkey").alias("scope"))
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), (F.col("o_custkey") % 701).alias("key"), (F.col("o_orderkey") % 25).cast("int").alias("scope"))
    return graph.resolve_unique(refs, cand)


@query
def edge_merge(spark, d):
    li = table(spark, d, "lineitem")
    raw = li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("references").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit(1).alias("n"), F.col("l_returnflag").alias("via"))
    return graph.merge_edges(raw)


@query
def entity_merge(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return graph.merge_entities(raw, ["status", "priority"])


@query
def in_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query
def file_importance(spark, d):
    refs = _edges(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return refs.select("id", "n", F.round(1 + 0.15 * F.log1p("n"), 6).alias("boost"))


@query
def entity_page(spark, d):
    return tables.page(graph.degrees(_edges(spark, d)), F.desc("in_degree"), F.desc("out_degree"), "id", limit=50, offset=10)


@query
def neighbors_1hop(spark, d):
    start = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("start"))
    return graph.neighbours(_edges(spark, d), start)


@query
def neighborhood_2hop(spark, d):
    start = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("start"))
    return graph.neighbourhood(_edges(spark, d), start)


@query
def find_entities(spark, d):
    ent = corpus(spark, d).select("id", F.regexp_replace("path", r"\.md$", "").alias("name"))
    asked = corpus(spark, d).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("DOC_"), "id")).otherwise(F.regexp_replace("path", r"\.md$", "")).alias("asked"))
    return graph.find_by_name(ent, asked)


@query
def line_overlap(spark, d):
    w = chunking.line_windows(corpus(spark, d)).select("id", "window_no", "start_line", "end_line")
    spans = corpus(spark, d).select("id", (F.col("id") % 40 + 1).alias("a"), (F.col("id") % 40 + 10).alias("b"))
    return w.join(spans, "id").where("end_line >= a AND start_line <= b").select("id", "window_no")


@query
def graph_counts(spark, d):
    return _edges(spark, d).groupBy("kind").agg(F.count("*").alias("edges"), F.sum("n").alias("weight"))


# Overviews, logs, evaluation


@query
def source_overview(spark, d):
    return corpus(spark, d).groupBy("source_id").agg(F.count("*").alias("chunks"), F.countDistinct("hash").alias("texts"), F.countDistinct("path").alias("paths"), F.sum("tokens").alias("tokens"))


@query
def token_percentiles(spark, d):
    return tables.nearest_rank(corpus(spark, d), "tokens", {"p50": 0.5, "p90": 0.9}, by="lang")


@query
def files_page(spark, d):
    files = corpus(spark, d).groupBy("path").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.min("hash").alias("hash"))
    return tables.page(files, F.desc("tokens"), "path", limit=40, offset=5)


@query
def largest_chunks(spark, d):
    return tables.page(corpus(spark, d).select("id", "tokens"), F.desc("tokens"), "id", limit=5)


def _log(spark, d):
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("user"), F.col("event_type").alias("mode"), "value")


@query
def query_log_stats(spark, d):
    return tables.log_statistics(_log(spark, d), 100.0)


@query
def stats_findings(spark, d):
    c = corpus(spark, d)
    seen = _log(spark, d).where("mode = 'view'").select(F.concat(F.lit("src"), F.col("user") % 23).alias("source_id")).distinct()
    never = c.select("source_id").distinct().join(seen, "source_id", "left_anti").select(F.lit("never_retrieved").alias("finding"), "source_id")
    long = c.where("tokens > 1200").select(F.lit("oversized_chunks").alias("finding"), "source_id").distinct()
    return never.unionAll(long)


@query
def log_tail(spark, d):
    return tables.page(_log(spark, d).select("event_id", "mode"), F.desc("event_id"), limit=20)


@query
def eval_recall(spark, d):
    """How often the best ten hold a document that contains the item's whole passage."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    top = search.ranked(_hits(spark, d), limit=10).join(corpus(spark, d).select("id", "text"), "id").join(b, "query_id")
    hit = top.groupBy("query_id").agg(F.max(F.contains("text", "passage").cast("int")).alias("hit"), F.min(F.when(F.contains("text", "passage"), F.col("rank"))).alias("first"))
    return hit.agg(F.count("*").alias("questions"), F.sum("hit").alias("found"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg(1 / F.col("first")), 6).alias("mean_reciprocal"))


@query
def grep_baseline(spark, d):
    """For each question the documents that hold most of its terms, by words: at most twenty."""
    q = _terms(spark, d).select("query_id", "term").distinct()
    posts = _posts(spark, d).where("col = 'text'").select("id", "term")
    cover = q.join(posts, "term").groupBy("query_id", "id").agg(F.count("*").alias("terms"))
    best = cover.groupBy("query_id").agg(F.max("terms").alias("most"))
    top = cover.join(best, "query_id").where("terms = most")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where("rank <= 20").select("query_id", "id", "terms", "rank")


@query
def events_tumbling(spark, d):
    out = tumbling_counts(table(spark, d, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
