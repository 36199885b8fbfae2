"""Facts about entities, and the entities that a question is about.

Entities are rows (id, type, name, kind, path, in_degree); edges (src, dst, kind). All questions of a table are answered
in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import estimate_tokens

SHOWN = 6
#: Test folders and names of entities.
TEST_FOLDER = r"(^|/)(test|tests|spec|specs|__tests__)(/|$)"
TEST_NAME = r"(Test|Tests|Spec|IT)$"
#: Types in the order in which facts prefer them, and what a question's word looks like.
TYPE_ORDER = ("symbol", "object", "service", "team", "component", "flow", "field")
QUESTION_WORD = r"[A-Za-z_][A-Za-z0-9_.]*"


def is_test(name: Column, path: Column) -> Column:
    """Whether an entity is test code: by its path's folders, or by the first part of its name."""
    return F.coalesce(path, F.lit("")).rlike(TEST_FOLDER) | F.substring_index(name, ".", 1).rlike(TEST_NAME)


def shown_names(rows: DataFrame, by: list[str], n: int = SHOWN) -> DataFrame:
    """(by, names) of rows (by, name, test): the first ``n`` names, production code first, and how many more there are."""
    order = Window.partitionBy(*by).orderBy("test", "name")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)  # Spark keeps n a group before it shuffles
    names = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("first"))
    total = rows.groupBy(*by).agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > n, F.concat(F.lit(" (+"), F.col("total") - n, F.lit(" more)"))).otherwise("")
    return names.join(total, by).select(*by, F.concat(F.array_join(F.transform("first", lambda x: x["name"]), ", "), more).alias("names"))


def describe(entities: DataFrame, edges: DataFrame, labels: dict[tuple[str, str], str]) -> DataFrame:
    """(id, fact): one line an entity: name, kind and place, then for each (edge kind, direction) of ``labels`` its neighbours."""
    info = entities.select("id", "name", is_test(F.col("name"), F.col("path")).alias("test"))
    ends = edges.select(F.col("src").alias("of"), F.col("dst").alias("id"), "kind", F.lit("out").alias("direction"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("of"), F.col("src").alias("id"), "kind", F.lit("in").alias("direction")))
    order = F.create_map(*[x for i, (k, d) in enumerate(labels) for x in (F.lit(f"{k}|{d}"), F.lit(i))])
    texts = F.array(*(F.lit(t) for t in labels.values()))
    near = ends.distinct().join(info, "id").withColumn("slot", order[F.concat_ws("|", "kind", "direction")]).where("slot is not null")
    near = shown_names(near.select("of", "slot", "name", "test"), ["of", "slot"])
    parts = near.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("slot", "names"))).alias("parts"))
    tail = F.array_join(F.transform("parts", lambda p: F.concat(texts[p["slot"]], F.lit(": "), p["names"])), "; ")
    head = F.concat("name", F.lit(" — "), F.coalesce("kind", "type"), F.when(F.col("path").isNotNull() & (F.col("path") != F.col("name")), F.concat(F.lit(", "), "path")).otherwise(""))
    out = entities.join(parts.withColumnRenamed("of", "id"), "id", "left")
    return out.select("id", F.concat(head, F.when(F.col("parts").isNotNull(), F.concat(F.lit("; "), tail)).otherwise("")).alias("fact"))


def describe_json(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, json): an entity with its neighbours by edge kind, names sorted, keys always in one order."""
    info = entities.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))

    def side(of: str, to: str, name: str) -> DataFrame:
        rows = edges.select(F.col(of).alias("id"), F.col(to).alias("other"), "kind").distinct().join(info, "other")
        each = rows.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct(F.col("other").alias("id"), F.col("other_name").alias("name"), F.col("other_type").alias("type")))).alias("v"))
        return each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", F.col("v").alias("entities")))).alias(name))

    out = entities.join(side("src", "dst", "outgoing"), "id", "left").join(side("dst", "src", "incoming"), "id", "left")
    return out.select("id", F.to_json(F.struct("id", "type", "name", "kind", "path", "outgoing", "incoming")).alias("json"))


def importance(entities: DataFrame) -> Column:
    """How much rests on an entity: incoming edges, less for nested symbols, properties and tests."""
    symbol = F.col("type") == "symbol"
    score = F.coalesce("in_degree", F.lit(0)).cast("double")
    score -= F.when(symbol & F.contains("name", F.lit(".")), 2).otherwise(0)
    score -= F.when(symbol & F.coalesce(F.col("kind") == "property", F.lit(False)), 3).otherwise(0)
    return score - F.when(is_test(F.col("name"), F.col("path")), 5).otherwise(0)


def question_candidates(questions: DataFrame) -> DataFrame:
    """(query_id, word, deliberate) of questions (query_id, text): words of three letters up, and neighbours joined plainly
    or by an underscore; deliberate if it looks like an identifier (a dot, an underscore, mixed case inside)."""
    rows = questions.select("query_id", F.regexp_extract_all("text", F.lit(QUESTION_WORD), F.lit(0)).alias("w"))
    inner = lambda w: F.substring(w, 2, 1 << 20)
    looks = lambda w: w.rlike("[._]") | ((inner(w) != F.lower(inner(w))) & (inner(w) != F.upper(inner(w))))
    single = F.transform(F.filter("w", lambda w: F.length(w) >= 3), lambda w: F.struct(w.alias("word"), looks(w).alias("deliberate")))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    joined = lambda gap: F.transform(pairs, lambda p: F.struct(F.concat(p["a"], F.lit(gap), p["b"]).alias("word"), F.lit(True).alias("deliberate")))
    return rows.select("query_id", F.inline(F.concat(single, joined(""), joined("_")))).distinct()


def question_entities(questions: DataFrame, entities: DataFrame, least: float = 2, limit: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): entities named in a question, people and files apart.

    A plain word counts only if it names a top-level symbol of at least ``least`` importance, or one of exactly its
    capitalised spelling; one that is no symbol always counts.
    """
    known = entities.where(~F.col("type").isin("person", "file")).withColumn("score", importance(entities))
    hits = question_candidates(questions).join(known, F.lower("word") == F.lower("name"))
    deliberate = F.col("deliberate") | (F.substring("word", 1, 1).rlike(r"\p{Lu}") & (F.col("name") == F.col("word")))
    plain = (F.col("type") == "symbol") & ((F.col("score") < least) | F.contains("name", F.lit(".")))
    kept = hits.where(deliberate | ~plain).groupBy("query_id", "id").agg(F.max("score").alias("score"), F.first("type").alias("type"), F.first("name").alias("name"))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type")), F.lit(0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.when(kind == 0, 99).otherwise(kind), "name", "id")
    out = kept.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "score", "rank")
    return out.where(F.col("rank") <= limit) if limit else out


def hit_entities(hits: DataFrame, entities: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, id, rank): behind each of the best hits (query_id, rank, path, heading) its top-level symbol, else its code
    file; production code first."""
    best = hits.where(F.col("rank") <= top).withColumn("symbol", F.substring_index(F.coalesce("heading", F.lit("")), " > ", 1))
    info = entities.select("id", "type", "name", "kind", "path", is_test(F.col("name"), F.col("path")).alias("test"))
    symbols = info.where("type = 'symbol'").select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol"), "path", F.col("test").alias("symbol_test"))
    files = info.where("type = 'file' and kind = 'code'").select(F.col("id").alias("file_id"), F.col("name").alias("path"), F.col("test").alias("file_test"))
    found = best.join(symbols, ["symbol", "path"], "left").join(files, "path", "left").select("query_id", "rank", F.coalesce("symbol_id", "file_id").alias("id"), F.coalesce("symbol_test", "file_test").alias("test"))
    first = found.where("id is not null").groupBy("query_id", "id").agg(F.min("rank").alias("hit_rank"), F.first("test").alias("test"))
    order = Window.partitionBy("query_id").orderBy("test", "hit_rank", "id")
    return first.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "rank")


def entities_for_questions(asked: DataFrame, behind_hits: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, id, rank): those named in the question, then those behind its hits, each once, ``limit`` in all."""
    both = asked.select("query_id", "id", F.lit(0).alias("list"), "rank").unionByName(behind_hits.select("query_id", "id", F.lit(1).alias("list"), "rank"))
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("list", "rank")).alias("place"))
    order = Window.partitionBy("query_id").orderBy("place", "id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "rank")


def facts_within(facts: DataFrame, budget: int, share: float = 0.4) -> DataFrame:
    """(query_id, rank, fact, tokens): a question's facts in order while their tokens stay within a share of the budget."""
    sized = facts.withColumn("tokens", estimate_tokens(F.col("fact")))
    run = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sized.withColumn("run", run).where(F.col("run") <= F.lit(budget * share)).select("query_id", "rank", "fact", "tokens")
