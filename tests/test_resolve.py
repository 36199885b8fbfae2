"""Names to entities: imports, folders, deferred names, imports of components and tags."""

from loomspark.operators import resolve


def test_imports_and_folders(spark):
    files = [("api/Task.java", "class Task"), ("model/Task.java", "class Task"), ("a/One.java", "import org.x.Other;\nimport api.Task;\n"), ("a/Two.java", "import model.*;\n"), ("model/Three.java", "x"), ("b/Four.java", "")]
    table = spark.createDataFrame(files, "path string, text string")
    imports = resolve.imports_of(table)
    assert {(r.path, r.pos, r.package) for r in imports.collect()} == {("a/One.java", 0, "org/x/Other"), ("a/One.java", 1, "api/Task"), ("a/Two.java", 0, "model")}
    cand = spark.createDataFrame([("task", "api.Task", "api/Task.java"), ("task", "model.Task", "model/Task.java"), ("only", "z.Only", "z/Only.java")], "key string, target string, path string")
    refs = spark.createDataFrame([(1, "task", "a/One.java"), (2, "task", "a/Two.java"), (3, "task", "model/Three.java"), (4, "task", "b/Four.java"), (5, "only", "b/Four.java"), (6, "none", "b/Four.java")], "ref int, key string, path string")
    assert {r.ref: r.target for r in resolve.resolve_by_imports(refs, cand, imports).collect()} == {1: "api.Task", 2: "model.Task", 3: "model.Task", 4: None, 5: "z.Only", 6: None}


def test_deferred_and_components(spark):
    named = lambda *rows: spark.createDataFrame(list(rows), "id string, name string")
    pending = spark.createDataFrame([("f", "calls", "account"), ("f", "calls", "Order"), ("f", "calls", "gone")], "src string, kind string, name string")
    got = resolve.resolve_deferred(pending, [named(("symbol:Account", "Account")), named(("object:account", "Account"), ("object:order", "Order"))])
    assert {tuple(r) for r in got.collect()} == {("f", "calls", "symbol:Account"), ("f", "calls", "object:order")}
    files = spark.createDataFrame([("lwc/a/a.js", "import x from '@salesforce/apex/Acc.load';\nimport y from '@salesforce/apex/Acc.none';\nimport N from '@salesforce/schema/Order.Total__c';"), ("lwc/a/a.html", "<c-my-part x></c-my-part><c-other>")], "path string, text string")
    found = resolve.import_references(files, named(("s:Acc", "Acc"), ("s:Acc.load", "Acc.load")), named(("o:Order", "Order"), ("f:total", "Order.Total__c")))
    assert {tuple(r) for r in found.collect()} == {("lwc/a/a.js", "s:Acc.load", "import"), ("lwc/a/a.js", "s:Acc", "import"), ("lwc/a/a.js", "f:total", "schema")}
    assert [tuple(r) for r in resolve.component_tags(files, named(("c:myPart", "myPart"))).collect()] == [("lwc/a/a.html", "c:myPart")]
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, v string")
    assert resolve.first_choice(rows, "k", "o").first().v == "a"
