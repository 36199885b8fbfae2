"""Ownership, facts about entities, evaluation and views on small tables."""

from pyspark.sql import functions as F

from loomspark.plans import context_queries
from loomspark.operators import evaluation, facts, ownership, search, views


def test_owners(spark, tmp_path):
    text = "# rules\n* @core\n/docs/ @docs @writers # the docs\n*.kt @kotlin\nsrc/api/ @api\n\nonly_a_pattern\n"
    rules = ownership.owner_rules(text)
    assert rules == [("**/*", ["core"]), ("docs/", ["docs", "writers"]), ("**/*.kt", ["kotlin"]), ("src/api/", ["api"])]
    (tmp_path / "docs").mkdir()
    (tmp_path / ".github").mkdir()
    (tmp_path / "docs" / "CODEOWNERS").write_text("* @late\n")
    (tmp_path / ".github" / "CODEOWNERS").write_text(text)
    assert ownership.read_owner_rules(spark, str(tmp_path)) == rules
    files = spark.createDataFrame([(p,) for p in ("docs/a.md", "src/x.kt", "src/api/y.kt", "lib/z.py")], "path string")
    patterns = ownership.service_patterns(spark, [{"name": "api", "team": "t1", "paths": "src/**"}, {"name": "lib", "paths": ["lib/**", "src/api/**"]}])
    got = {r.path: (r.service, r.owner) for r in ownership.file_owners(files, patterns, rules).collect()}
    assert got == {"docs/a.md": (None, "docs"), "src/x.kt": ("api", "t1"), "src/api/y.kt": ("lib", "t1"), "lib/z.py": ("lib", "core")}
    edges = ownership.ownership_edges(files, patterns, spark.createDataFrame([("Ann", "t1")], "person string, team string"), spark.createDataFrame([("api", "lib", None)], "source string, target string, via string"))
    assert {tuple(r) for r in edges.where("kind <> 'contains'").collect()} == {("team:t1", "service:api", "owns", None), ("person:ann", "team:t1", "member_of", None), ("service:api", "service:lib", "depends_on", "unknown")}
    kinds = ownership.file_entities(spark.createDataFrame([("a.md",), ("b.py",), ("c.txt",), ("b.py",)], "path string"))
    assert {r.name: r.kind for r in kinds.collect()} == {"a.md": "doc", "b.py": "code", "c.txt": "text"}


ENTITY = "id string, type string, name string, kind string, path string, in_degree long"


def test_facts_and_questions(spark):
    rows = [("s:Stage", "symbol", "Stage", "class", "src/Stage.kt", 3), ("s:StageTest", "symbol", "StageTest", "class", "src/test/StageTest.kt", 9), ("s:run", "symbol", "Run", "class", "src/Run.kt", 0)]
    rows += [("s:Stage.go", "symbol", "Stage.go", "function", "src/Stage.kt", 8), ("o:Order_Item", "object", "Order_Item", None, None, 0), ("p:stage", "person", "stage", None, None, 50)]
    entities = spark.createDataFrame(rows, ENTITY)
    assert {r.id: r.score for r in entities.select("id", facts.importance(entities).alias("score")).collect()}["s:Stage.go"] == 6
    ask = lambda text: [r.id for r in facts.question_entities(spark.createDataFrame([(1, text)], "query_id long, text string"), entities).orderBy("rank").collect()]
    assert ask("how does a stage run here") == ["s:Stage"] and ask("Run it") == ["s:run"] and ask("order item rules") == ["o:Order_Item"] and ask("the Stage.go call") == ["s:Stage.go"]
    edges = spark.createDataFrame([("s:Stage", f"x{i}", "uses") for i in range(8)] + [("s:run", "s:Stage", "calls")], "src string, dst string, kind string")
    more = entities.unionByName(spark.createDataFrame([(f"x{i}", "symbol", f"X{i}" if i else "XTest", None, None, 0) for i in range(8)], ENTITY))
    got = {r.id: r.fact for r in facts.describe(more, edges, {("uses", "out"): "uses", ("calls", "in"): "called by"}).collect()}
    assert got["s:Stage"] == "Stage — class, src/Stage.kt; uses: X1, X2, X3, X4, X5, X6 (+2 more); called by: Run"
    assert '"kind":"calls"' in {r.id: r.json for r in facts.describe_json(more, edges).collect()}["s:run"]
    hits = spark.createDataFrame([(1, 1, "src/test/StageTest.kt", "StageTest > a"), (1, 2, "src/Stage.kt", "Stage > go"), (1, 3, "none.md", None)], "query_id long, rank int, path string, heading string")
    behind = facts.hit_entities(hits, entities)
    assert [r.id for r in behind.orderBy("rank").collect()] == ["s:Stage", "s:StageTest"]
    named = facts.question_entities(spark.createDataFrame([(1, "Stage")], "query_id long, text string"), entities)
    assert [r.id for r in facts.entities_for_questions(named, behind, 2).orderBy("rank").collect()] == ["s:Stage", "s:StageTest"]
    lines = spark.createDataFrame([(1, i, "x" * 40) for i in range(1, 9)], "query_id long, rank int, fact string")
    assert facts.facts_within(lines, 100).count() == 4


def test_packs_with_facts(spark):
    hits = spark.createDataFrame([(1, r, r, f"p{r}", f"h{r}", 40) for r in range(1, 4)], "query_id long, rank int, id long, path string, hash string, tokens long")
    plain = search.pack_hits(hits, 100, 0.1)
    assert [r.decision for r in plain.orderBy("rank").collect()] == ["included", "included", "over_budget"]
    charged = search.pack_hits(hits, 100, 0.1, facts=spark.createDataFrame([(1, 25)], "query_id long, facts_tokens long"))
    assert [r.decision for r in charged.orderBy("rank").collect()] == ["included", "over_budget", "over_budget"]


def test_rerank_moves_the_head_only(spark):
    hits = spark.createDataFrame([(1, i, i, s) for i, s in ((1, 0.1), (2, 0.9), (3, 0.5), (4, 1.0))], "query_id long, id long, rank int, s double")
    assert [r.id for r in search.rerank(hits, F.col("s"), 3).orderBy("rank").collect()] == [2, 3, 1, 4]

    @F.pandas_udf("double")
    def longer(question, text):
        return text.str.len().astype(float)

    texts = spark.createDataFrame([(1, 1, 1, "q", "a"), (1, 2, 2, "q", "abc")], "query_id long, id long, rank int, question string, text string")
    assert [r.id for r in search.rerank(texts, longer, 2).orderBy("rank").collect()] == [2, 1]


def test_search_detailed(spark):
    words = spark.createDataFrame([(q, i, 1.0, i, "any") for q in (1, 2, 3) for i in (1, 2)], "query_id long, id long, score double, rank int, mode string")
    near = spark.createDataFrame([(q, i, 0.5, i - 1) for q in (1, 2, 4) for i in (2, 3)], "query_id long, id long, score double, rank int")
    asked = spark.createDataFrame([(1, "hybrid"), (2, "vector"), (3, "auto"), (4, "auto"), (5, "vector")], "query_id long, retriever string")
    got = {q: [(r.id, r.mode, r.retriever) for r in rows] for q in range(1, 6) for rows in [search.search_detailed(words, near, asked).where(F.col("query_id") == q).orderBy("rank").collect()]}
    assert [x[0] for x in got[1]] == [2, 1, 3] and got[1][0][1:] == ("any+vec", "hybrid") and got[2][0][1:] == ("vec", "vector")
    assert got[3][0][1:] == ("any", "bm25") and got[4][0] == (2, "vec", "vector") and got[5] == []


def test_evaluation(spark):
    rows = [("main.py", "src/main.py", True), ("src/*.py", "src/main.py", False), ("main.py", "src/domain.py", False)]
    got = spark.createDataFrame(rows, "e string, p string, want boolean").select("want", evaluation.path_matches(F.col("e"), F.col("p")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    glob = spark.createDataFrame([("src/*.py", "src/main.py", "^src/[^/]*[.]py$")], "e string, p string, r string")
    assert glob.select(evaluation.path_matches(F.col("e"), F.col("p"), F.col("r")).alias("x")).first().x
    one = spark.range(1).select(F.array(F.lit("Order.total — field, a.cls#L3-4"), F.lit("x — y")).alias("f"), F.array(F.lit("Guide > Retry rules")).alias("h"))
    ok = lambda e: one.select(evaluation.entity_present(F.lit(e), F.col("f"), F.col("h")).alias("x")).first().x
    assert ok("order") and ok("total") and ok("retry rules") and not ok("rules")
    assert one.select(evaluation.cited_paths(F.col("f")[0]).alias("x")).first().x == ["a.cls"]
    expected = spark.createDataFrame([(1, 0, "a.py"), (1, 1, "b.py"), (1, 1, "c.py"), (2, 0, "z.py")], "query_id long, group int, expected string")
    packed = spark.createDataFrame([(1, "x/a.py"), (2, "y.py")], "query_id long, path string")
    candidates = packed.unionByName(spark.createDataFrame([(1, "c.py")], "query_id long, path string"))
    recalls = evaluation.question_recalls(expected, packed, candidates)
    assert {tuple(r) for r in recalls.collect()} == {(1, 2, 1, 2, 1), (2, 1, 0, 0, 0)}
    assert tuple(evaluation.report(recalls).first()) == (2, 0.25, 0.5, 1, 1)
    tagged = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"])], "query_id long, tags array<string>")
    assert [r.query_id for r in evaluation.with_tags(tagged, ["c", "d"]).collect()] == [2] and evaluation.with_tags(tagged, []).count() == 2


def test_tables_of_a_corpus(spark, tmp_path):
    old = spark.createDataFrame([(1, "m", [0.0]), (2, "m", [1.0]), (3, "old", [2.0])], "id long, model string, vector array<double>")
    new = spark.createDataFrame([(2, "m", [5.0]), (4, "m", [6.0]), (5, "x", [7.0])], "id long, model string, vector array<double>")
    assert {r.id: r.vector for r in views.one_model(old, new, "m").collect()} == {1: [0.0], 2: [5.0], 4: [6.0]}
    log = spark.createDataFrame([("q", ["b", "a", "b"])], "text string, sources array<string>")
    views.append_log(log, str(tmp_path / "log"))
    views.append_log(log, str(tmp_path / "log"))
    assert [r.sources for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [["a", "b"]] * 2
    files = spark.createDataFrame([("code", "kotlin"), ("code", "xml"), ("markdown", None)], "type string, language string")
    assert views.languages_filter(files, F.col("type"), F.col("language"), ["kotlin"]).count() == 2


def test_facts_and_packs_score_the_corpus_once(spark, monkeypatch):
    calls, hits = [], context_queries.base._hits
    monkeypatch.setattr(context_queries.base, "_hits", lambda *a: calls.append(a) or hits(*a))
    context_queries.QUERIES["pack_with_facts"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
