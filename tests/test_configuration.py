import json

import pytest

from loomspark.sources.configuration import KINDS, ConfigurationError, entries, read_configuration

QUESTIONS = """
version: 1
questions:
  - {id: retry, q: deprecated retry pattern, expect_paths: [CONTRIBUTING.md], tags: norms}
  - {q: why sqlite, expect_entities: [nothing-here], budget_tokens: 2000}
"""


def test_questions_teams_and_dependencies_are_tables(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.yaml").write_text(QUESTIONS)
    (tmp_path / "q" / "b.json").write_text(json.dumps({"questions": [{"id": "miss", "q": "x", "expect_any_paths": ["a.md", "b.md"]}]}))
    df = read_configuration(spark, "questions", f"{tmp_path}/q")
    assert df.rdd.getNumPartitions() == 2
    rows = {r["id"]: r.asDict() for r in df.collect()}
    assert rows["retry"]["expect_paths"] == ["CONTRIBUTING.md"] and rows["retry"]["tags"] == ["norms"] and rows["q2"]["budget_tokens"] == 2000
    assert rows["miss"]["expect_any_paths"] == ["a.md", "b.md"] and rows["miss"]["sources"] == []
    own = tmp_path / "teams.yaml"
    own.write_text("teams:\n  - {name: core, oncall: '#core', members: [Ann, Bo]}\n  - {oncall: none}\nservices:\n  - {name: api, team: core, paths: src/**}\n")
    get = lambda kind: [tuple(r) for r in read_configuration(spark, kind, str(own)).orderBy("pos").collect()]
    assert get("teams") == [(0, "core", "#core")] and sorted(get("members")) == [(0, "core", "Ann"), (0, "core", "Bo")]
    assert get("services") == [(0, "api", "core", None, ["src/**"])] and get("dependencies") == []
    deps = tmp_path / "deps.json"
    deps.write_text(json.dumps({"edges": [{"from": "api", "to": "db"}, {"from": "api"}, {"from": "a", "to": "b", "kind": "http"}]}))
    assert [tuple(r) for r in read_configuration(spark, "dependencies", str(deps)).collect()] == [(0, "api", "db", "unknown"), (2, "a", "b", "http")]
    with pytest.raises(Exception, match="no configuration at"):
        read_configuration(spark, "teams", f"{tmp_path}/none.yaml").collect()
    (tmp_path / "bad.yaml").write_text("questions:\n  - {id: a, q: x}\n")
    with pytest.raises(Exception, match="needs one of expect_paths"):
        read_configuration(spark, "questions", f"{tmp_path}/bad.yaml").collect()
    with pytest.raises(Exception, match="'kind' must be one of"):
        read_configuration(spark, "poems", str(own)).collect()


@pytest.mark.parametrize(
    ("kind", "data", "says"),
    [
        ("questions", {"questions": [{"q": "x", "id": "a", "expect_paths": "p"}, {"q": "y", "id": "a", "expect_paths": "p"}]}, "duplicate id 'a'"),
        ("questions", {"questions": [{"id": "a", "expect_paths": "p"}]}, r"questions\[0\] needs q"),
        ("questions", {"questions": []}, "non-empty list 'questions'"),
        ("questions", ["x"], "non-empty list"),
        ("questions", {"questions": [{"q": "x", "expect_paths": [1]}]}, "string or a list of strings"),
        ("sources", {"sources": [{"id": "a", "type": "code", "bucket": "other", "paths": "x"}]}, "bucket must be one of"),
        ("sources", {"sources": [{"id": "a", "type": "code", "bucket": "norms"}]}, "needs paths"),
    ],
)
def test_what_is_rejected(kind, data, says):
    with pytest.raises(ConfigurationError, match=says):
        list(entries(data, KINDS[kind]))
