from loomspark.operators import code, code_chunks

HANDLER = '''/* a class { in a comment
   that goes on } */
public class Handler {
  // String s = "{";
  void run(int x) {
    String s = "go(} {";
    Util.go(x);
    help();
    log.error("x");
  }
  private int help() { return 1; }
}
'''
UTIL = "public class Util {\n  static void go(int x) {\n    if (x > 0) {\n      stop();\n    }\n  }\n  static void stop() {\n  }\n}\n"
TEST = "class LogTest {\n  void error(String x) {\n  }\n}\n"


def test_declarations_references_and_calls(spark):
    files = spark.createDataFrame([("src/Handler.java", HANDLER), ("src/Util.java", UTIL), ("test/LogTest.java", TEST)], "path string, text string")
    lines = code.code_lines(files)
    decl = code.declarations(lines)
    got = {(r.qualified, r.kind, r.start_line, r.end_line) for r in decl.collect()}
    assert got == {
        ("Handler", "class", 3, 12),
        ("Handler.run", "function", 5, 10),
        ("Handler.help", "function", 11, 11),
        ("Util", "class", 1, 9),
        ("Util.go", "function", 2, 6),
        ("Util.stop", "function", 7, 8),
        ("LogTest", "class", 1, 4),
        ("LogTest.error", "function", 2, 3),
    }
    refs = code.references(lines, decl)
    assert {(r.path, r.target) for r in refs.collect()} == {("src/Handler.java", "Util@src/Util.java")}
    called = code.calls(lines, decl)
    edges = {(r.caller, r.target): r.n for r in code.resolve_calls(called, decl, refs).collect()}
    assert edges == {("Handler.run", "Util.go"): 1, ("Handler.run", "Handler.help"): 1, ("Util.go", "Util.stop"): 1}


PYTHON = """import os

# helps
@cached
def first(x):
    return x

class Thing:
    def one(self):
        return 1

    async def two(self):
        if self:
            return 2
        return 3

print(first(1))
"""


def test_python_blocks():
    lines = PYTHON.split("\n")
    got = code_chunks.with_headers(lines, code_chunks.python_blocks(lines))
    assert [(a + 1, b, n) for a, b, n in got] == [(3, 6, "first"), (8, 15, "Thing"), (9, 10, "Thing.one"), (12, 15, "Thing.two")]


def test_code_chunks(spark):
    small = {"target": 16, "most": 20, "least": 2, "overlap": 0.0}
    files = spark.createDataFrame([("src/Util.java", UTIL), ("src/thing.py", PYTHON), ("e.py", ""), ("n.py", None)], "path string, text string")
    rows = code_chunks.code_chunks(files, **small).orderBy("path", "chunk_no").collect()
    of = lambda path: [(r.start_line, r.end_line, r.heading) for r in rows if r.path == path]
    assert [(a, b, h) for a, b, h in of("src/Util.java") if "." in h] == [(2, 6, "Util.go"), (7, 9, "Util.stop")]
    assert {"first", "Thing.two"} <= {h for _, _, h in of("src/thing.py")}
    assert {r.path for r in rows} == {"src/Util.java", "src/thing.py"} and rows[0].language == "java" and rows[0].text.startswith("[src/Util.java")
    covered = {i for a, b, _ in of("src/thing.py") for i in range(a, b + 1)}
    assert covered >= {i for i, line in enumerate(PYTHON.split("\n"), 1) if line.strip()}
    whole = code_chunks.code_chunks(files).where("path = 'src/Util.java'").collect()
    assert len(whole) == 1 and whole[0].heading == "Util" and (whole[0].start_line, whole[0].end_line) == (1, 9)
