import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomspark.operators import chunking, graph, search, tables
from loomspark.streaming.ingest import ingest_stream, tumbling_counts


def test_heading_sections(spark):
    text = "# Title\nintro\n## Alpha\nx\n```\n# not a heading\n```\n### Alpha child\ny\n## Beta\nz"
    rows = chunking.heading_sections(spark.createDataFrame([(1, text), (2, "plain"), (3, "")], "id long, text string")).orderBy("id", "section_no").collect()
    assert [(r.id, r.heading, r.start_line, r.end_line) for r in rows] == [
        (1, "Title", 1, 2),
        (1, "Title > Alpha", 3, 7),
        (1, "Title > Alpha > Alpha child", 8, 9),
        (1, "Title > Beta", 10, 11),
        (2, "", 1, 1),
    ]


def test_line_windows_cover_every_line_once(spark):
    text = "\n".join("word " * (3 + i % 40) for i in range(300))
    rows = chunking.line_windows(spark.createDataFrame([(1, text), (2, "short")], "id long, text string"), target=100, most=120).orderBy("id", "window_no").collect()
    own = [r for r in rows if r.id == 1]
    assert [r.start_line for r in own] == [1] + [r.end_line + 1 for r in own[:-1]] and own[-1].end_line == 300
    assert len(own) > 1 and len([r for r in rows if r.id == 2]) == 1


def test_document_chunks(spark):
    small = {"target": 60, "most": 80, "least": 5, "overlap": 0.2}
    text = "# Title\nintro words here to be long enough\n\n## Alpha\nalpha body text of some length\n\n### Alpha child\nchild body text of some length\n\n## Beta\nbeta body text of some length\n"
    got = chunking.chunk_spans(text, **small)
    assert [h for _, _, h in got] == ["Title", "Title > Alpha", "Title > Alpha > Alpha child", "Title > Beta"]
    assert chunking.chunk_spans("```\n# not a heading\n```\nmore", **small) == [(1, 4, "")]
    assert chunking.chunk_spans("# A\na\n\n## B\nb\n\n## C\nshort\n", **small | {"least": 40}) == [(1, 8, "A")]
    paragraphs = ["paragraph %d " % i + "word " * 16 for i in range(12)]
    windows = chunking.chunk_spans("\n\n".join(paragraphs), **small | {"overlap": 0.5})
    assert [a for a, _, _ in windows] == sorted({a for a, _, _ in windows}) and windows[0][0] == 1 and windows[-1][1] == 23
    assert any(b >= c for (_, b, _), (c, _, _) in zip(windows, windows[1:], strict=False))
    block = "```\n" + "\n".join(f"line_{i} some code here" for i in range(60)) + "\n```"
    cut = chunking.chunk_spans(block, **small)
    assert len(cut) > 1 and cut[0][0] == 1 and cut[-1][1] == 62 and all(b + 1 >= c for (_, b, _), (c, _, _) in zip(cut, cut[1:], strict=False))
    docs = spark.createDataFrame([("docs/readMe_first.md", text), ("empty.md", ""), ("none.md", None), ("blank.md", " \n\n")], "path string, text string")
    rows = chunking.document_chunks(docs, **small).orderBy("chunk_no").collect()
    assert {r.path for r in rows} == {"docs/readMe_first.md"} and rows[1].text.startswith("[docs/readMe_first.md > Title > Alpha]\n## Alpha") and "read" in rows[0].terms
    sections = chunking.heading_sections(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("section_no").collect()
    assert [r.heading for r in sections] == [h for _, _, h in got]


def test_bm25_equals_fts5(spark):
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(5 + i % 9))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", docs)
    chunks = spark.createDataFrame(docs, "id long, text string")
    terms = search.question_terms(spark.createDataFrame([(1, "w11 w13 w22")], "qid long, text string"), "qid")
    got = {r.id: r.score for r in search.bm25(chunks, terms, weights={"text": 1.0}).collect()}
    again = {r.id: r.score for r in search.bm25_of_postings(search.postings(chunks, "id", ("text",)), terms).collect()}
    assert got.keys() == again.keys() and all(math.isclose(got[i], again[i]) for i in got)
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'w11 OR w13 OR w22'")}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_rank_fusion(spark):
    lists = [spark.createDataFrame([(1, d, r) for r, d in enumerate(ids, 1)], "query_id long, id long, rank int") for ids in ([1, 2, 3], [3, 1, 4])]
    got = search.reciprocal_rank_fusion([(x, 1.0) for x in lists]).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3, 2, 4] and got[0].score > got[1].score > got[2].score


def test_pack_decisions(spark):
    hits = [(1, 1, 1, "a", "h1", 50), (1, 2, 2, "b", "h1", 10), (1, 3, 3, "a", "h2", 60), (1, 4, 4, "a", "h3", 20), (1, 5, 5, "a", "h4", 5), (1, 6, 6, "c", "h2", 1)]
    rows = spark.createDataFrame(hits, "query_id long, rank int, id long, path string, hash string, tokens long")
    got = [r.decision for r in search.pack_hits(rows, budget=100).orderBy("rank").collect()]
    assert got == ["included", "duplicate", "over_budget", "included", "file_cap", "duplicate"]


def test_near_duplicates_keep_the_first(spark):
    rows = [(1, 1, 10, [1.0, 0.0]), (1, 2, 11, [0.99, 0.01]), (1, 3, 12, [0.0, 1.0])]
    got = search.drop_near_duplicates(spark.createDataFrame(rows, "query_id long, rank int, id long, vector array<float>"), 0.95).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == [(10, 1), (12, 2)]


def test_upsert_is_idempotent_and_drops_what_vanished(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "id string, v int")
    once = tables.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("b", 2), ("c", 3)]
    assert sorted(map(tuple, tables.upsert(once, new).collect())) == [("b", 2), ("c", 3)]
    assert {r.id: r.status for r in tables.content_diff(old, new).collect()} == {"a": "removed", "b": "unchanged", "c": "added"}


def test_nearest_rank(spark):
    r = tables.nearest_rank(spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v long"), "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (r.n, r.p50, r.p90, r["max"], r.total) == (4, 3, 4, 4, 10)


def test_graph(spark):
    touches = spark.createDataFrame([(c, f) for c in range(3) for f in "ab"] + [(9, f"f{i}") for i in range(40)] + [(8, f"f{i}") for i in range(40)], "commit long, file string")
    assert [tuple(r) for r in graph.co_changes(touches).collect()] == [("a", "b", 3)]
    edges = spark.createDataFrame([("a", "b", "r", 1, 1, "x"), ("a", "b", "r", 0, 2, "y"), ("a", "a", "r", 2, 1, "z")], "src string, dst string, kind string, seq int, n int, via string")
    assert [tuple(r) for r in graph.merge_edges(edges).collect()] == [("a", "b", "r", 3, "y")]
    path = spark.createDataFrame([(str(i), str(i + 1), "k") for i in range(5)], "src string, dst string, kind string")
    got = graph.neighbourhood(path, spark.createDataFrame([("2",)], "start string")).collect()
    assert {r.id: r.depth for r in got} == {"2": 0, "1": 1, "3": 1, "0": 2, "4": 2}
    hub = spark.createDataFrame([("hub", f"x{i}", "k") for i in range(30)] + [("x9", f"y{i}", "k") for i in range(9)] + [("hub", "z", "contains")], "src string, dst string, kind string")
    near = {r.id: r.depth for r in graph.neighbourhood(hub, spark.createDataFrame([("hub",)], "start string"), (5, 2), 6).collect()}
    assert len(near) == 6 and "z" not in near and sorted(near.values()) == [0, 1, 1, 1, 1, 1]
    cand = spark.createDataFrame([("t1", "k", "api"), ("t2", "k", "model"), ("t3", "u", "x")], "target string, key string, scope string")
    refs = spark.createDataFrame([(1, "k", "api"), (2, "k", "none"), (3, "u", "none")], "ref int, key string, scope string")
    assert {r.ref: r.target for r in graph.resolve_unique(refs, cand).collect()} == {1: "t1", 2: None, 3: "t3"}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([("s", "p", "one"), ("s", "p", "two"), ("s", "p", "one")], "source_id string, path string, text string")
    rows.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(src)
        ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
        rows.limit(2).write.mode("append").parquet(src)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D")
    assert [(r.n, r.total) for r in tumbling_counts(events).collect()] == [(2, 3.0)]


def test_repository_files(spark, tmp_path):
    from loomspark.sources.tables import repository_files

    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "c.md").write_text("y" * 3000)
    got = {r.path.rsplit("/", 1)[-1]: (r.language, r.skipped) for r in repository_files(spark, str(tmp_path), max_kb=2).collect()}
    assert got == {"a.py": ("python", None), "b.bin": (None, "binary"), "c.md": (None, "too large")}


def test_codeowners(spark):
    files = spark.createDataFrame([("src/a.py",), ("docs/x.md",), ("other",)], "path string")
    got = {r[0]: r[1] for r in files.select("path", graph.last_match(files, [("src/**", "one"), ("**/*.py", "two"), ("docs", "three")])).collect()}
    assert got == {"src/a.py": "two", "docs/x.md": "three", "other": None}
    got = {r[0]: r[1] for r in files.select("path", graph.first_claim(files, [("one", "src/**"), ("two", "**/*.py")]).alias("x")).collect()}
    assert got == {"src/a.py": "one", "docs/x.md": None, "other": None}


def test_neighbourhood_ranks_neighbours_once(spark):
    """Both steps read the stored neighbours; edges are not ranked again for each."""
    edges = spark.createDataFrame([(f"p{i}", f"s{j}", "uses") for i in range(6) for j in range(3)], "src string, dst string, kind string")
    out = graph.neighbourhood(edges, spark.createDataFrame([("p0",)], "start string"), (2, 2))
    assert sorted(map(tuple, out.collect())) == [("p0", "p0", 0), ("p0", "p1", 2), ("p0", "s0", 1), ("p0", "s1", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("row_number(") <= 2  # one window


def test_search_mode_scores_hits_once(spark):
    """Both lists come from a stored pool: the hits' own plan is not part of the result's."""
    hits = spark.createDataFrame([(1, i, float(i), i % 2 == 0) for i in range(9)], "query_id long, id long, score double, strict boolean").withColumn("score", F.col("score") + 0.125)
    terms = spark.createDataFrame([(1, 0, "a", 2), (1, 1, "b", 2)], "query_id long, pos int, term string, n_terms int")
    out = search.search_mode(hits, terms, limit=3, pool=3)
    assert "0.125" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["id"], r["mode"]) for r in out.orderBy("rank").collect()] == [(8, "all"), (6, "all"), (4, "all")]


@pytest.mark.parametrize("cell", [10, 1_000_000])
def test_neighbourhood_is_whole(spark, monkeypatch, cell):
    """All vertices within two steps, however many a vertex has and in however many cells they are found."""
    monkeypatch.setattr(graph, "CELL", cell)
    kind = lambda i: "contains" if i % 11 == 0 else "uses"
    rows = [("hub", f"x{i}", kind(i)) for i in range(60)] + [(f"y{i}", f"x{i % 7 * 5}", "uses") for i in range(80)] + [("y1", "hub", "uses"), ("x1", "x1", "uses"), ("x2", "far", "uses"), ("far", "farther", "uses"), (None, "hub", "uses")]
    near = {}
    for a, b, k in rows:
        if k == "uses" and a and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    starts = ["hub", "y3", "x2", "alone", "hub", None]
    want = {(s, s, 0) for s in starts}
    for s in starts:
        one = near.get(s, set())
        two = {v for m in one for v in near[m]} - one - {s}
        want |= {(s, v, 1) for v in one} | {(s, v, 2) for v in two}
    edges = spark.createDataFrame(rows, "src string, dst string, kind string")
    got = graph.neighbourhood(edges, spark.createDataFrame([(s,) for s in starts], "start string")).collect()
    assert len(want) > 150 and len(got) == len(want) and set(map(tuple, got)) == want


def test_neighbourhood_shuffles_edges_not_paths(spark, monkeypatch):
    """Between the join of a step and its distinct ends there is no shuffle."""
    monkeypatch.setattr(graph, "CELL", 10)
    edges = spark.createDataFrame([(f"p{i}", f"s{i * j % 5}", "uses") for i in range(20) for j in range(3)], "src string, dst string, kind string")
    out = graph.neighbourhood(edges, edges.select(F.col("src").alias("start")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("HashAggregate") : plan.index("Join")]
    assert "min(depth" in above and "Exchange" not in above
