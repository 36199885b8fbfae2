import random
import re

import pytest

from loomspark.operators import masking


def lexed(lines, language):
    """A character at a time, one lexer for the whole file."""
    quotes = '"' + ("" if language == "rust" else "'") + ("`" if language in ("javascript", "typescript", "go") else "")
    out, where = [], ""
    for line in lines:
        i, buf = 0, ""
        while i < len(line):
            if where == "":
                if line.startswith("//", i):
                    buf += " " * (len(line) - i)
                    i = len(line)
                elif line.startswith("/*", i):
                    where, buf, i = "*", buf + "  ", i + 2
                else:
                    where, buf, i = line[i] if line[i] in quotes else "", buf + line[i], i + 1
            elif where == "*":
                done = line.startswith("*/", i)
                where, buf, i = "" if done else "*", buf + ("  " if done else " "), i + 1 + done
            elif line[i] == "\\":
                buf, i = buf + "  ", i + 2
            else:
                done = line[i] == where
                where, buf, i = "" if done else where, buf + (line[i] if done else " "), i + 1
        out.append(buf[: len(line)])
        if where in ("'", '"'):
            where = ""
    return out


def depths(code):
    out, depth = [], 0
    for line in code:
        before = depth
        for c in line:
            depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
        out.append((before, depth))
    return out


@pytest.mark.parametrize("group", [256, 3])
def test_equals_a_lexer(spark, monkeypatch, group):
    monkeypatch.setattr(masking, "GROUP", group)
    rng = random.Random(group)
    parts = ["//", "/*", "*/", '"', "'", "`", "\\", "{", "}", "a", " ", "x.y(", "é", "/", "*", "\\\\"]
    files = {}
    for i in range(60):
        language = ("java", "rust", "typescript", "go", "apex", None)[i % 6]
        n = rng.choice([1, 2, 10, 40])
        files[f"f{i}"] = (language, ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(n)] + ["end"])
    files["wide"] = ("typescript", ["x = 'it" + "s \\' " * 20000 + "' + `" + "é { " * 20000, "y" * 50000 + "` // {", "z /*" + " * /" * 20000])
    files["long"] = ("java", ["/* opens"] + ["still in { it"] * 700 + ["out */ { x"] + ["}", "}", "{"])
    df = spark.createDataFrame([(p, lang, "\n".join(lines)) for p, (lang, lines) in files.items()], "path string, language string, text string")
    got = {}
    for r in masking.with_depths(masking.masked_lines(df)).orderBy("path", "line_no").collect():
        got.setdefault(r["path"], []).append((r["code"], r["before"], r["after"]))
    for path, (language, lines) in files.items():
        want = lexed(lines, language)
        assert [g[0] for g in got[path]] == want, path
        assert [g[1:] for g in got[path]] == depths(want), path


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([("a.java", None), ("b.java", ""), ("c.java", "\n\n x")], "path string, text string")
    rows = [(r["path"], r["line_no"], r["code"]) for r in masking.masked_lines(df).orderBy("path", "line_no").collect()]
    assert [r for r in rows if r[0] == "c.java"] == [("c.java", 1, ""), ("c.java", 2, ""), ("c.java", 3, " x")]
    assert all(not re.sub(r"\s", "", r[2]) for r in rows if r[0] != "c.java")


def test_lines_are_shuffled_once(spark):
    """States, lines and depths of a file meet where the file is dealt, and no line function is computed again."""
    df = spark.createDataFrame([(f"f{i}.java", "class A { /* it's\nplain */ }\n" * 300) for i in range(5)], "path string, text string")
    out = masking.with_depths(masking.masked_lines(df))
    assert out.count() == 5 * 600 and all(r["after"] == 0 for r in out.where("line_no = 600").collect())
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#\d+, \d+\)", plan)) == {"path"}
    assert not re.search(r"Exchange hashpartitioning\(\w+#\w+, \w+#", plan) and "regexp_replace(line#" not in plan.split("FileScan", 1)[1]
