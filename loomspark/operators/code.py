"""Structure of brace-language source files as tables: lines with depths, declarations, references, calls.

Strings and comments are blanked and depths counted by scans over lines (``masking``); all else is joins and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import is_test_path
from loomspark.operators.masking import masked_lines, with_depths

#: Words that stand before a parenthesis or brace without naming anything.
NOT_NAMES = "if else for foreach while do switch case default try catch finally return throw with when match new get set synchronized using lock super this sizeof typeof".split()

TYPE_DECLARATION = r"\b(class|interface|enum|trigger|record|struct|object|trait)\s+([A-Za-z_]\w*)"
FUNCTION_NAME = r"(?:\b(?:fn|func|function|def|fun)\s+|[\w>\]?]\s+)([A-Za-z_]\w*)\s*\([^;{}]*\)?[^;={}]*\{"
CALL = r"(?:([A-Za-z_]\w*)\s*\.\s*)?([A-Za-z_]\w*)\s*\("


def code_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, code, before, after): each line's code without strings and comments, and the brace depth around it."""
    return with_depths(masked_lines(files)).select("path", "line_no", "code", "before", "after")


def declarations(lines: DataFrame) -> DataFrame:
    """(path, kind, name, qualified, start_line, end_line, depth) of types and functions with a body that opens on their line.

    A declaration ends at the first line after which the depth is back at where it began; its qualified name is that of
    the types around it.
    """
    kind, name = F.regexp_extract("code", TYPE_DECLARATION, 1), F.regexp_extract("code", TYPE_DECLARATION, 2)
    function = F.regexp_extract("code", FUNCTION_NAME, 1)
    found = lines.select("path", "line_no", "before", "after", "code", kind.alias("kind"), name.alias("type_name"), function.alias("function"))
    is_type = (F.col("type_name") != "") & F.contains("code", F.lit("{"))
    is_function = (F.col("function") != "") & ~F.col("function").isin(*NOT_NAMES) & ~is_type
    heads = found.where(is_type | is_function).select("path", F.when(is_type, F.col("kind")).otherwise("function").alias("kind"), F.when(is_type, F.col("type_name")).otherwise(F.col("function")).alias("name"), F.col("line_no").alias("start_line"), F.col("before").alias("depth"), (F.col("after") <= F.col("before")).alias("at_once"))
    # A line closes the depths from where it ends up to one below where it began; a head ends at the next line that closes its own.
    closes = lines.where("before > after").select("path", F.explode(F.sequence("after", F.col("before") - 1)).alias("depth"), F.col("line_no").alias("closed"))
    none = F.lit(None).cast("string")
    events = heads.select("path", "depth", F.col("start_line").alias("at"), F.when(F.col("at_once"), F.col("start_line")).alias("closed"), "kind", "name")
    events = events.unionByName(closes.select("path", "depth", F.col("closed").alias("at"), "closed", none.alias("kind"), none.alias("name")))
    later = Window.partitionBy("path", "depth").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    at_end = F.coalesce("closed", F.min(F.when(F.col("kind").isNull(), F.col("closed"))).over(later))
    spans = events.withColumn("end_line", at_end).where("kind is not null").select("path", "kind", "name", F.col("at").alias("start_line"), "depth", "end_line").distinct()
    last = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    spans = spans.join(last, "path").withColumn("end_line", F.coalesce("end_line", "last")).drop("last")
    outer = spans.where("kind <> 'function'").select(F.col("path").alias("p"), F.col("name").alias("outer"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("depth").alias("d"))
    around = spans.join(outer, (F.col("path") == F.col("p")) & (F.col("s") < F.col("start_line")) & (F.col("e") >= F.col("end_line")), "left")
    trail = around.groupBy("path", "kind", "name", "start_line", "end_line", "depth").agg(F.array_sort(F.collect_list(F.struct("d", "outer"))).alias("trail"))
    qualified = F.array_join(F.concat(F.transform("trail", lambda x: x["outer"]), F.array("name")), ".")
    return trail.select("path", "kind", "name", qualified.alias("qualified"), "start_line", "end_line", "depth")


def references(lines: DataFrame, types: DataFrame) -> DataFrame:
    """(path, target, n): capitalised names in code that are types declared elsewhere (in one file only)."""
    used = lines.select("path", F.explode(F.regexp_extract_all("code", F.lit(r"\b[A-Z][A-Za-z0-9_]*\b"), F.lit(0))).alias("word"))
    used = used.groupBy("path", F.lower("word").alias("key")).agg(F.count("*").alias("n"))
    known = types.where("kind <> 'function' AND depth = 0").groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("m"), F.min(F.struct("path", "name")).alias("t")).where("m = 1")
    hits = used.join(known, "key").where(F.col("path") != F.col("t.path"))
    return hits.select("path", F.concat("t.name", F.lit("@"), "t.path").alias("target"), "n")


def calls(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, line_no, receiver, callee, caller, own_type): calls in code with the innermost function around them."""
    found = lines.select("path", "line_no", F.explode(F.regexp_extract_all("code", F.lit(CALL), F.lit(0))).alias("call"))
    found = found.select("path", "line_no", F.regexp_extract("call", CALL, 1).alias("receiver"), F.regexp_extract("call", CALL, 2).alias("callee")).where(~F.col("callee").isin(*NOT_NAMES))
    f = declared.where("kind = 'function'").select(F.col("path").alias("p"), "qualified", F.col("name").alias("own_name"), "start_line", "end_line")
    inside = found.join(f, (F.col("path") == F.col("p")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")), "left")
    inside = inside.where(F.col("start_line").isNull() | (F.col("line_no") > F.col("start_line")) | (F.col("callee") != F.col("own_name")))
    one = inside.groupBy("path", "line_no", "receiver", "callee").agg(F.max_by("qualified", "start_line").alias("caller"))
    return one.withColumn("own_type", F.regexp_extract("caller", r"^(.*)\.[^.]+$", 1))


def resolve_calls(called: DataFrame, declared: DataFrame, refs: DataFrame) -> DataFrame:
    """(caller, target, n, path, target_path): the receiver's type, else the caller's own, else the only one among referenced types, else the only one at all.

    A candidate counts only if it is the single one of its rung; production code never resolves to a test path by the last.
    Each rung is an equi-join on all that it knows of its candidates, and the last takes counts by name, so that a name of
    many methods never meets all its calls.
    """
    methods = declared.where("kind = 'function' AND qualified LIKE '%.%'").select(F.lower("name").alias("key"), "qualified", F.regexp_extract("qualified", r"([^.]+)\.[^.]+$", 1).alias("type"), F.col("path").alias("target_path"))
    plain = F.col("receiver").isin("", "this", "self")
    calls_ = called.withColumn("key", F.lower("callee")).withColumn("call", F.xxhash64("path", "line_no", "receiver", "callee", F.coalesce("caller", F.lit(""))))
    asked = calls_.select("call", "key", "path", F.coalesce("caller", F.lit("")).alias("caller"), F.lower("receiver").alias("receiver_type"), F.regexp_extract("own_type", r"([^.]+)$", 1).alias("short_own"), plain.alias("plain"), (F.coalesce("own_type", F.lit("")) == "").alias("outside"))
    known = refs.select("path", "target").distinct()
    rungs = [
        asked.join(methods.withColumn("receiver_type", F.lower("type")), ["key", "receiver_type"]),
        asked.where("plain").join(methods.withColumnsRenamed({"type": "short_own"}).withColumn("path", F.col("target_path")), ["key", "short_own", "path"]),
        asked.join(known, "path").join(methods.withColumn("target", F.concat("type", F.lit("@"), "target_path")), ["key", "target"]),
    ]
    found = asked.select("call", "path", "caller")
    for i, rung in enumerate(rungs):
        one = rung.where("caller <> qualified").groupBy("call").agg(F.count("*").alias(f"m{i}"), F.min(F.struct("qualified", "target_path")).alias(f"t{i}"))
        found = found.join(one, "call", "left")
    # The last rung: of all methods of the name less the caller itself, one must be left.
    fair = lambda what: F.when(~is_test_path(F.col("target_path")), what)
    what = F.struct("qualified", "target_path")
    names = methods.groupBy("key").agg(F.count("*").alias("all_n"), F.min(what).alias("all_low"), F.max(what).alias("all_high"), F.count(fair(F.lit(1))).alias("fair_n"), F.min(fair(what)).alias("fair_low"), F.max(fair(what)).alias("fair_high"))
    own = methods.groupBy("key", F.col("qualified").alias("caller")).agg(F.count("*").alias("all_own"), F.count(fair(F.lit(1))).alias("fair_own"))
    last = asked.where("not plain or outside").join(names, "key").join(own, ["key", "caller"], "left")
    pick = lambda c: F.when(is_test_path(F.col("path")), F.col(f"all_{c}")).otherwise(F.col(f"fair_{c}"))
    left = pick("n") - F.coalesce(pick("own"), F.lit(0))
    other = F.when(pick("low")["qualified"] == F.col("caller"), pick("high")).otherwise(pick("low"))
    found = found.join(last.select("call", left.alias("m3"), other.alias("t3")), "call", "left")
    count = F.coalesce("m0", "m1", "m2", "m3")
    target = F.when(F.col("m0").isNotNull(), F.col("t0")).when(F.col("m1").isNotNull(), F.col("t1")).when(F.col("m2").isNotNull(), F.col("t2")).otherwise(F.col("t3"))
    single = found.where(count == 1).select(F.when(F.col("caller") != "", F.col("caller")).alias("caller"), "path", target.alias("t"))
    return single.groupBy("caller", F.col("t.qualified").alias("target"), "path", F.col("t.target_path").alias("target_path")).agg(F.count("*").alias("n")).select("caller", "target", "n", "path", "target_path")
