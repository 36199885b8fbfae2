import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import index as idx
from loomspark.operators import search

CHUNKS = "id long, text string, path string"
TERMS = "query_id long, pos int, term string, n_terms int"


def chunk(rng, i):
    words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rng.choice([0, 3, 12, 40]))]
    return (i, " ".join(words), rng.choice([None, "src/Alpha.kt", "docs/zeta.md"]))


@pytest.fixture(scope="module")
def terms(spark):
    asked = {1: ["alpha"], 2: ["alpha", "beta"], 3: ["alpha", "nowhere"], 4: ["nowhere"], 5: ["iota", "kappa", "kt"], 6: ["theta", "eta", "zeta", "docs"]}
    return spark.createDataFrame([(q, p, t, len(ts)) for q, ts in asked.items() for p, t in enumerate(ts)], TERMS)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


def expected(spark, chunks, terms, k, strict=False, allowed=None):
    hits = search.bm25(spark.createDataFrame(chunks, CHUNKS), terms)
    hits = hits.where("strict") if strict else hits
    hits = hits.join(allowed, "id", "left_semi") if allowed is not None else hits
    return rows(search.ranked(hits, limit=k))


def test_searches_equal_those_without_an_index(spark, tmp_path, terms, monkeypatch):
    monkeypatch.setattr(idx, "QUESTIONS", 4)
    rng = random.Random(3)
    chunks = [chunk(rng, i) for i in range(150)]
    index = idx.InvertedIndex(spark, f"file://{tmp_path}/i", cells=7)
    index.ingest(spark.createDataFrame(chunks, CHUNKS))
    assert rows(index.top_k(terms, 5)) == expected(spark, chunks, terms, 5)
    assert rows(index.top_k(terms, 5, strict=True)) == expected(spark, chunks, terms, 5, True)
    allowed = spark.createDataFrame([(i,) for i in range(0, 150, 7)], "id long")
    assert rows(index.top_k(terms, 5, allowed=allowed)) == expected(spark, chunks, terms, 5, False, allowed)


def test_updates_by_chunk_id(spark, tmp_path, terms):
    """Replaced, removed and new chunks; then all segments as one."""
    rng = random.Random(5)
    state = {i: chunk(rng, i) for i in range(60)}
    index = idx.InvertedIndex(spark, f"file://{tmp_path}/i", cells=3)
    index.ingest(spark.createDataFrame(list(state.values()), CHUNKS), name="base")
    for step in range(2):
        new = [chunk(rng, i) for i in (*range(step, 20, 2), 100 + step)]
        gone = [30 + step, 100 + step - 1, 999]
        index.ingest(spark.createDataFrame(new, CHUNKS), spark.createDataFrame([(g,) for g in gone], "id long"), f"step-{step}")
        for g in gone:
            state.pop(g, None)
        state |= {c[0]: c for c in new}
        assert rows(index.top_k(terms, 6)) == expected(spark, list(state.values()), terms, 6)
    version = index.table.version()
    assert index.ingest(spark.createDataFrame([(0, "alpha", None)], CHUNKS), name="step-1") == version  # a repeated ingest
    index.compact(5)
    assert index.table.live().count() == 1
    assert rows(index.top_k(terms, 6, strict=True)) == expected(spark, list(state.values()), terms, 6, True)


def test_only_folders_of_asked_terms_are_read_and_headers_have_no_postings(spark, tmp_path, terms):
    index = idx.InvertedIndex(spark, f"file://{tmp_path}/i", cells=2)
    rng = random.Random(7)
    index.ingest(spark.createDataFrame([chunk(rng, i) for i in range(40)], CHUNKS))
    plan = index.bounds(index.asked(terms), False)._jdf.queryExecution().executedPlan().toString()
    heads = next(line for line in plan.splitlines() if "FileScan" in line and "max_f" in line)
    assert "dynamicpruning" in plan and "kind#" in heads and "= block" in heads
    assert "ids:" not in heads.split("ReadSchema:")[1] and "max_f:double" in heads


def test_cells_below_the_last_place_are_not_read(spark, tmp_path):
    """A cell's bound decides; cells of weak documents stay unread."""
    index = idx.InvertedIndex(spark, f"file://{tmp_path}/i", cells=40)
    chunks = [(i, "alpha " * (30 if i < 20 else 1) + "pad " * (1 if i < 20 else 60), None) for i in range(400)]
    index.ingest(spark.createDataFrame(chunks, CHUNKS))
    terms = spark.createDataFrame([(1, 0, "alpha", 1)], TERMS)
    bounds = index.bounds(index.asked(terms), False)
    best = index.top_k(terms, 3)
    least = best.agg(F.min("score")).first()[0]
    assert bounds.where(F.col("bound") >= least).count() < bounds.count()
    assert rows(best) == expected(spark, chunks, terms, 3)


def test_texts_are_dealt_once_and_words_not_at_all(spark, tmp_path):
    """The only shuffle of an ingest is that of texts by cell; no posting is a row of its own."""
    index = idx.InvertedIndex(spark, f"file://{tmp_path}/i", cells=3)
    rng = random.Random(11)
    plan = index._segment(spark.createDataFrame([chunk(rng, i) for i in range(20)], CHUNKS), 3)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") == 1 and "Generate" not in plan and "collect_list" not in plan


def test_a_cell_of_many_words_has_several_blocks(spark, tmp_path, terms, monkeypatch):
    rng = random.Random(13)
    chunks = [*(chunk(rng, i) for i in range(40)), (40, None, None), (41, "alpha " * 50, "alpha/beta.md"), (41, "alpha " * 50, "alpha/beta.md")]
    monkeypatch.setattr(idx, "WORDS", 30)
    index = idx.InvertedIndex(spark, f"file://{tmp_path}/i", cells=2)
    index.ingest(spark.createDataFrame(chunks, CHUNKS).coalesce(1))
    whole = index.table.read().where("kind = 'block'")
    assert whole.groupBy("term", "cell").count().agg(F.max("count")).first()[0] > 1
    assert index.entries().count() == 42
    assert rows(index.top_k(terms, 5)) == expected(spark, chunks[:-1], terms, 5)


def test_a_first_ingest_looks_for_no_older_entries_and_a_later_one_for_its_own(spark, tmp_path, monkeypatch):
    seen = []
    entries = idx.InvertedIndex.entries
    monkeypatch.setattr(idx.InvertedIndex, "entries", lambda self, ids=None: seen.append(ids) or entries(self, ids))
    index = idx.InvertedIndex(spark, f"file://{tmp_path}/i", cells=1)
    index.ingest(spark.createDataFrame([(1, "alpha", None), (2, "beta", None)], CHUNKS), name="first")
    assert seen == []
    index.ingest(spark.createDataFrame([(1, "gamma", None)], CHUNKS), name="second")
    assert [r[0] for r in seen[0].collect()] == [1]


def test_both_lists_come_from_one_search(spark, tmp_path, terms, monkeypatch):
    rng = random.Random(17)
    chunks = [chunk(rng, i) for i in range(60)]
    index = idx.InvertedIndex(spark, f"file://{tmp_path}/i", cells=5)
    index.ingest(spark.createDataFrame(chunks, CHUNKS))
    calls, scores = [], idx.InvertedIndex._scores
    monkeypatch.setattr(idx.InvertedIndex, "_scores", lambda self, *a: calls.append(1) or scores(self, *a))
    got = idx.search_lists(index, terms, limit=5, pool=8)
    assert len(calls) == 2  # the first cells and the rest
    assert rows(got) == rows(search.search_mode(search.bm25(spark.createDataFrame(chunks, CHUNKS), terms), terms, limit=5, pool=8))


def test_postings_are_bytes_and_documents_of_a_batch_are_one_row(spark, tmp_path, terms):
    rng = random.Random(19)
    state = {i: chunk(rng, i) for i in range(30)}
    index = idx.InvertedIndex(spark, f"file://{tmp_path}/i", cells=1)
    index.ingest(spark.createDataFrame(list(state.values()), CHUNKS))
    assert index.table.schema["posts"].dataType.simpleString() == "binary"
    assert index.table.read().where("kind = 'entry'").count() == 1
    new = [(i, "alpha nowhere", None) for i in range(0, 30, 2)]
    index.ingest(spark.createDataFrame(new, CHUNKS), spark.createDataFrame([(1,)], "id long"))
    state = {i: c for i, c in (state | {c[0]: c for c in new}).items() if i != 1}
    df = {r["term"]: r["df"] for r in index.table.read().where("kind IN ('block', 'df')").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    assert all(df[t] == sum(t in c[1].split() for c in state.values()) for t in ("beta", "iota", "nowhere"))
    assert rows(index.top_k(terms, 5)) == expected(spark, list(state.values()), terms, 5)
