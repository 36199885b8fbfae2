"""Names of entities in texts: an equi-join of the first token, then of whole phrases, then the leftmost longest ones.

A name is a sequence of tokens (runs of word characters, or any other single character), so names of several words and
names with dots are found like single words. Texts are taken apart once. Only positions whose token begins some name go on,
with the lengths that such names have; their phrases meet the names by an equi-join. Of the phrases of a text the leftmost,
and of those that begin together the longest, is taken, and the search goes on behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least length of a name, and when a text has mentions enough.
LEAST, MOST = 4, 20

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"
_WORD_FIRST = r"^[\p{L}\p{N}_]"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def phrase_mentions(texts: DataFrame, names: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(id, entity_id): entities (entity_id, name) whose names texts (id, text) hold, whatever their case.

    A name stands alone: no word character or dot before it, no word character after it. All entities of a name are
    mentioned with it. Once a text has ``most`` entities, no further name counts. Names of fewer than ``least`` characters,
    null texts and null names are left out.
    """
    known = names.where(F.length("name") >= least).select("entity_id", tokens_of(F.col("name")).alias("t"))
    known = known.groupBy("t").agg(F.array_sort(F.collect_set("entity_id")).alias("ids")).select(F.array_join("t", "").alias("phrase"), F.col("t")[0].alias("first"), F.size("t").alias("n"), "ids")
    firsts = known.groupBy("first").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    parts = texts.where("text is not null").select("id", tokens_of(F.col("text")).alias("t"))
    begins = parts.select("id", F.posexplode("t").alias("at", "first")).join(firsts, "first").groupBy("id").agg(F.collect_list(F.struct("at", "lengths")).alias("begins"))
    places = parts.join(begins, "id").select("id", "t", F.explode("begins").alias("b"))
    before, at = F.col("t")[F.col("b.at") - 1], F.col("b.at")
    alone = (at == 0) | (~before.rlike(_WORD_FIRST) & (before != "."))
    spans = places.where(alone).select("id", "t", at.alias("at"), F.explode("b.lengths").alias("n")).where("at + n <= size(t)")
    after = F.col("t")[F.col("at") + F.col("n")]
    whole = (F.col("at") + F.col("n") == F.size("t")) | ~after.rlike(_WORD_FIRST)
    phrases = spans.where(whole).select("id", "at", "n", F.array_join(F.slice("t", F.col("at") + 1, F.col("n")), "").alias("phrase"))
    hits = phrases.join(known.select("phrase", "n", "ids"), ["phrase", "n"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("at", (-F.col("n")).alias("minus"), "ids"))).alias("hits"))
    kind = names.schema["entity_id"].dataType.simpleString()
    chosen = F.expr(
        f"""aggregate(hits, named_struct('end', 0, 'found', CAST(array() AS array<{kind}>)), (s, h) ->
            CASE WHEN h.at < s.end OR size(s.found) >= {most} THEN s
            ELSE named_struct('end', h.at - h.minus, 'found', array_union(s.found, h.ids)) END, s -> s.found)"""
    )
    return hits.select("id", F.explode(chosen).alias("entity_id"))
