import random
import re

from pyspark.sql import functions as F

from loomspark.operators import assemble, mentions, ownership

FILES = "path string, text string, source_type string"


def graph(spark, files, **more):
    df = spark.createDataFrame([(p, t, "code" if not p.endswith(".md") else "markdown") for p, t in files], FILES)
    return assemble.build_graph(df, **more)


def edges(g, kind):
    return {(r["src"], r["dst"], r["n"]) for r in g.edges.where(F.col("kind") == kind).collect()}


def test_types_of_one_name_are_told_apart_by_import_package_and_folder(spark):
    g = graph(
        spark,
        [
            ("api/src/main/java/com/x/api/Task.java", "package com.x.api;\npublic interface Task {\n  void run();\n}\n"),
            ("model/src/main/java/com/x/model/Task.java", "package com.x.model;\npublic class Task {\n  public String id;\n}\n"),
            ("core/src/main/java/com/x/core/ApiUser.java", "package com.x.core;\nimport com.x.api.Task;\npublic class ApiUser {\n  Task t; // ModelUser\n}\n"),
            ("core/src/main/java/com/x/core/ModelUser.java", 'package com.x.core;\nimport com.x.model.*;\npublic class ModelUser {\n  Task t; Task u; /* ApiUser */ String s = "ApiUser";\n  void go() {\n    help();\n  }\n  void help() {\n  }\n}\n'),
            ("model/src/main/java/com/x/model/Sibling.java", "package com.x.model;\npublic class Sibling {\n  Task t;\n}\n"),
            ("core/src/main/java/com/x/core/Unknown.java", "package com.x.core;\npublic class Unknown {\n  Task t;\n}\n"),
        ],
    )
    sym = lambda name, path: f"symbol:{name}@{path}"
    core, model = "core/src/main/java/com/x/core/", sym("Task", "model/src/main/java/com/x/model/Task.java")
    assert edges(g, "references") == {
        (sym("ApiUser", core + "ApiUser.java"), sym("Task", "api/src/main/java/com/x/api/Task.java"), 2),  # the import is one
        (sym("ModelUser", core + "ModelUser.java"), model, 2),
        (sym("Sibling", "model/src/main/java/com/x/model/Sibling.java"), model, 1),
    }
    user = core + "ModelUser.java"
    assert edges(g, "calls") == {(sym("ModelUser.go", user), sym("ModelUser.help", user), 1)}
    assert edges(g, "contains") == {(sym("ModelUser", user), sym(f"ModelUser.{m}", user), None) for m in ("go", "help")}
    assert ("file:" + user, sym("ModelUser", user), None) in edges(g, "declares") and len(edges(g, "declares")) == 6
    attrs = g.entities.where(F.col("id") == model).select(F.variant_get("attrs", "$.kind", "string").alias("k"), F.variant_get("attrs", "$.start_line", "int").alias("s"), F.variant_get("attrs", "$.simple", "string").alias("n")).first()
    assert tuple(attrs) == ("class", 2, "Task")


def test_triggers_components_metadata_history_and_prose(spark):
    files = [
        ("force/triggers/Acc.trigger", "trigger Acc on Account (before insert) {\n  Handler.run();\n}\n"),
        ("force/classes/Handler.cls", "public class Handler {\n  public static void run() {\n    List<Order> o = [SELECT Total__c FROM Order];\n  }\n}\n"),
        ("force/lwc/myPart/myPart.js", "import load from '@salesforce/apex/Handler.run';\nimport T from '@salesforce/schema/Order.Total__c';\n"),
        ("force/lwc/other/other.html", "<template><c-my-part></c-my-part></template>"),
        ("force/objects/Order/fields/Total__c.field-meta.xml", "<CustomField><fullName>Total__c</fullName></CustomField>"),
        ("docs/a.md", "about Handler"),
        ("null.java", None),
    ]
    patterns = ownership.service_patterns(spark, [{"name": "core", "team": "ann team", "paths": ["force/**"]}])
    df = spark.createDataFrame([(p,) for p, _ in files], "path string")
    none = spark.createDataFrame([], "source string, target string, via string")
    owned = ownership.ownership_edges(df, patterns, spark.createDataFrame([("Ann", "ann team")], "person string, team string"), none)
    days = [(c, "Bo", f"2024-01-0{c}", p) for c in (1, 2) for p in ("force/triggers/Acc.trigger", "force/classes/Handler.cls")] + [(3, "Al", "2024-01-03", "docs/a.md"), (3, "Al", "2024-01-03", "gone.txt")]
    prose = spark.createDataFrame([(1, "The handler of ANN TEAM, not HandlerX, x.Handler or Acc."), (2, None)], "id long, text string")
    g = graph(spark, files, ownership=owned, owners=ownership.file_owners(df, patterns, []), commits=spark.createDataFrame(days, "commit int, author string, day string, path string"), prose=prose)
    handler = "symbol:Handler@force/classes/Handler.cls"
    assert edges(g, "triggers_on") == {("symbol:Acc@force/triggers/Acc.trigger", "object:Account", None)}
    assert edges(g, "part_of") == {("file:force/lwc/myPart/myPart.js", "component:myPart", None), ("file:force/lwc/other/other.html", "component:other", None)}
    assert edges(g, "uses") == {("component:other", "component:myPart", None)}
    assert ("symbol:Acc@force/triggers/Acc.trigger", handler, 1) in edges(g, "references")
    assert {e for e in edges(g, "references") if e[0] == handler} == {(handler, "object:Order", 2), (handler, "field:Order.Total__c", 1)}
    assert ("component:myPart", "symbol:Handler.run@force/classes/Handler.cls", None) in edges(g, "calls")
    assert edges(g, "authored") == {("person:bo", "file:force/triggers/Acc.trigger", 2), ("person:bo", "file:force/classes/Handler.cls", 2), ("person:al", "file:docs/a.md", 1)}
    assert edges(g, "co_changed") == {("file:force/classes/Handler.cls", "file:force/triggers/Acc.trigger", 2)}
    assert ("team:ann team", "service:core", None) in edges(g, "owns") and ("person:ann", "team:ann team", None) in edges(g, "member_of")
    attrs = {r["id"]: r["a"] for r in g.entities.select("id", F.to_json("attrs").alias("a")).collect()}
    assert attrs["file:force/classes/Handler.cls"] == '{"commits":2,"kind":"code","language":"apex","last_author":"Bo","last_day":"2024-01-02","owner":"ann team","service":"core"}'
    assert attrs["object:Account"] == '{"standard":true}'
    assert sorted(r["entity_id"] for r in g.mentions.collect()) == [handler, "team:ann team"]


def test_an_empty_table_gives_an_empty_graph(spark):
    g = graph(spark, [])
    assert g.entities.count() == 0 and g.edges.count() == 0


def test_the_first_writer_of_an_attribute_wins(spark):
    rows = [("a", "t", "A", '{"x":1,"s":"12"}', 2), ("a", "u", "B", '{"x":2,"q":"say \\"hi\\"","b":true}', 3), ("b", "t", "B", "{}", 1)]
    got = {r["id"]: (r["type"], r["name"], r["a"]) for r in assemble.merged_entities(spark.createDataFrame(rows, "id string, type string, name string, attrs string, step int")).select("*", F.to_json("attrs").alias("a")).collect()}
    assert got == {"a": ("t", "A", '{"b":true,"q":"say \\"hi\\"","s":"12","x":1}'), "b": ("t", "B", "{}")}


def brute(texts, names, least, most):
    index = {}
    for e, n in names:
        if n is not None and len(n) >= least:
            index.setdefault(n.lower(), []).append(e)
    pattern = re.compile(r"(?<![\w.])(" + "|".join(re.escape(n) for n in sorted(index, key=len, reverse=True)) + r")(?!\w)", re.I)
    out = []
    for i, text in texts:
        found = []
        for m in pattern.finditer(text or ""):
            found += [e for e in sorted(set(index[m[1].lower()])) if e not in found]
            if len(found) >= most:
                break
        out += [(i, e) for e in found]
    return sorted(out)


def test_phrases_equal_an_alternation_of_all_names(spark):
    rng = random.Random(2)
    tokens = ["order", "item", "Order", "a", "b", ".", " ", " ", "-", "é", "x1", "_"]
    name = lambda n: "".join(rng.choice(tokens) for _ in range(rng.randrange(1, n)))
    names = [(f"e{i}", name(6)) for i in range(60)] + [("dup", "order item"), ("dup2", "Order Item"), ("none", None)]
    texts = [(i, name(60)) for i in range(80)] + [(98, None), (99, "")]
    for most in (20, 2):
        got = mentions.phrase_mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "entity_id string, name string"), 2, most)
        assert sorted((r["id"], r["entity_id"]) for r in got.collect()) == brute(texts, names, 2, most)


def test_comments_are_not_stored(spark, tmp_path):
    """What the graph stores grows with the code, not with what comments hold; lines keep their numbers."""
    rng = random.Random(4)
    prose = lambda: "\n".join("".join(rng.choice("abcdefghij klmnopqrstuvwxyz.") for _ in range(80)) for _ in range(500))
    files = [(f"src/C{i}.java", f"/* {prose()} */\nclass C{i} {{\n  C{(i + 1) % 4} x;\n  void go() {{\n  }}\n}}\n") for i in range(4)]

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    g = graph(spark, files, keep=keep)
    assert len(edges(g, "references")) == 4 and len(edges(g, "contains")) == 4
    start = F.variant_get("attrs", "$.start_line", "int")
    assert {r["s"] for r in g.entities.where("type = 'symbol' and name like 'C_'").select(start.alias("s")).collect()} == {501}
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < sum(len(t) for _, t in files) / 2
