import random
import sqlite3
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from loomspark.functions.embedding import _embed, hash_embeddings
from loomspark.functions.stemming import asked_forms, fold, stem, stemmed
from loomspark.operators import search
from loomspark.operators.render import fence, markdown_packs


def fts5_stems(words):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(words, 1)))
    return {words[d - 1]: term for term, d in db.execute("SELECT term, doc FROM v")}


def test_stems_equal_those_of_a_full_text_index():
    parts = "connect relat condition rational valenc hesitanc digit conform radical different analog vietnam operat feud hope form sens electric revive allow infer adjust depend adopt homolog activ effect bowdler rat cease control roll policy fly happy agree plaster motor".split()
    ends = ["", "s", "es", "ed", "ing", "er", "ly", "ion", "ions", "ness", "ful", "fulness", "able", "ible", "ance", "ence", "ment", "ements", "ative", "ational", "ization", "izer", "ality", "ivity", "ies", "y", "eed", "ical", "icate", "ousness", "ously", "entli", "ism", "ate", "iti", "ous", "ive", "ize", "e", "ll", "tional", "biliti"]
    words = sorted({p + e for p in parts for e in ends})
    rng = random.Random(1)
    words += ["".join(rng.choice("aeioustnrlydgb") for _ in range(rng.randrange(3, 9))) for _ in range(1500)]
    words = sorted(set(words))
    want = fts5_stems(words)
    wrong = {w: (stem(w), want[w]) for w in words if stem(w) != want[w]}
    assert len(wrong) <= 0.01 * len(words), dict(list(wrong.items())[:20])
    assert fold("Été") == "ete"


def test_hash_embeddings(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha beta gamma omega"), (4, "nothing in common here"), (5, None)]
    v = {r.id: r.vector for r in hash_embeddings(spark.createDataFrame(rows, "id long, text string")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert v[1] == v[2] and abs(dot(1, 1) - 1) < 1e-5 and dot(1, 3) > 0.5 and abs(dot(1, 4)) < 0.3 and not any(v[5])


def test_markdown(spark):
    rows = [(1, 2, "knowledge", "a.md", 1, 2, "x"), (1, 1, "norms", "b.md", 3, 9, "y ```` z")]
    got = markdown_packs(spark.createDataFrame(rows, "query_id long, rank int, bucket string, path string, start_line int, end_line int, text string")).first()
    assert got.markdown == "## norms\n\n### b.md#L3-9\n`````\ny ```` z\n`````\n\n## knowledge\n\n### a.md#L1-2\n```\nx\n```"
    assert spark.range(1).select(fence(F.lit("no"))).first()[0] == "```"


def test_search_by_stems_keeps_only_asked_ones(spark):
    """The same scores as over all stemmed postings, while words of other stems are dropped before any shuffle."""
    chunks = spark.createDataFrame([(1, "Connected relations ran", "a/happy.md"), (2, "connecting happiness", "b/Été.md"), (3, "nothing asked", None), (4, None, "c/connections.md")], "id long, text string, path string")
    terms = spark.createDataFrame([(1, 0, "connect", 2), (1, 1, "happy", 2), (2, 0, "ete", 1), (3, 0, "nowhere", 1)], "query_id long, pos int, term string, n_terms int")
    posts = stemmed(search.postings(chunks, "id")).groupBy("id", "col", "term").agg(F.sum("tf").alias("tf"))
    shown = lambda hits: sorted((r["query_id"], r["id"], round(r["score"], 9), r["strict"]) for r in hits.collect())
    hits = search.bm25_stemmed(chunks, terms)
    assert shown(hits) == shown(search.bm25_of_postings(posts, stemmed(terms))) and len(shown(hits)) == 4
    words = spark.createDataFrame([(w,) for w in "connected connection asked ran connected".split()], "term string")
    forms = asked_forms(words, stemmed(terms))
    assert sorted(map(tuple, forms.collect())) == [("connected", "connect"), ("connection", "connect")]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # the texts', once


def test_hash_embeddings_hold_one_row_of_words_at_a_time():
    words = [[f"w{j}" for j in range(500)]] * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["id", "terms"])
    run, _ = _embed(16, 10)
    tracemalloc.start()
    try:
        out = list(run(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 10e6 and sum(b.num_rows for b in out) == 2000
    finally:
        tracemalloc.stop()
