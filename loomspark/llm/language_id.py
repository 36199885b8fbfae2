"""Operator 5: language identification by Bayesian fusion of text, markup, address suffix and host.

* Text: byte trigrams under one smoothed model a language, for every declared language, each fitted in a task on a
  bounded sample of its documents (``SAMPLE`` a language, picked by a hash of their ids); whole texts are scored. As trigrams are not
  independent, a text's mean log-likelihood counts as at most ``EVIDENCE`` of them.
* Declared markup language (``<html lang=...>``) and address suffix: P(value | language), counted over all pages against
  the language of their document's text, smoothed; every value has its own row. A document's pages add up.
* Host: a prior over languages by grouped aggregation, smoothed from the whole table to registered domain to host
  (Dirichlet weights ``DOMAIN_WEIGHT``, ``HOST_WEIGHT``), counted over pages; each page adds what its host says beyond the whole table. A document without
  a page has its source as host. ``host`` and ``declared`` are given of a document's first page.

The language is the largest posterior. A document is rejected if its posterior is under ``least``, if its text holds no
letter, or if its likelihood is far below that of its language's sample (no language known here). Of a text too short
for a trigram the other evidence decides.

Null and empty texts are rejected with language null; null ids and sources have no page and an empty source; repeated
rows are judged alike; of languages with equal posteriors the first by name is taken; extra columns, whatever their names,
are ignored; texts of any length are scored whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import bounded_batches, byte_view, forget, write_out
from loomspark.llm.textbytes import LOWER
from loomspark.llm.url_reputation import host_and_path, suffix_and_domain

SAMPLE = 400
CELLS = 1 << 16
EVIDENCE = 40.0
LEAST = 0.5
FAR = 12.0
DOMAIN_WEIGHT = 50.0
HOST_WEIGHT = 20.0


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # (CELLS, languages)
    usual: np.ndarray  # (languages, 2): mean and deviation of the sample's mean log-likelihoods


def trigram_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams of all rows, letters A-Z lowered, and the offsets of the rows in them."""
    n = np.diff(offsets)
    low = LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)) & np.uint32(CELLS - 1)
    inside = np.ones(len(code), dtype=bool)
    for back in (1, 2):
        cut = offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(code))]] = False
    return code[inside], np.concatenate(([0], np.cumsum(np.maximum(0, n - 2))))


def _row_means(cells: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    out = np.zeros((len(n), table.shape[1]))
    full = np.flatnonzero(n > 0)
    if len(full):
        for k in range(table.shape[1]):
            out[full, k] = np.add.reduceat(table[:, k][cells], offsets[:-1][full]) / n[full]
    return out


def fit_text_model(rows: list[tuple[str, str]]) -> TextModel:
    """``rows``: (language, text)."""
    languages = sorted({lang for lang, _ in rows})
    counts = np.full((CELLS, max(1, len(languages))), 0.05)
    held = []
    for k, lang in enumerate(languages):
        data, offsets = byte_view(pa.array([t or "" for x, t in rows if x == lang], pa.string()))
        cells, at = trigram_cells(data, offsets)
        counts[:, k] += np.bincount(cells, minlength=CELLS)
        held.append((cells, at))
    log_p = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    usual = []
    for k, (cells, at) in enumerate(held):
        m = _row_means(cells, at, log_p[:, k : k + 1])[np.diff(at) > 0, 0]
        usual.append((float(m.mean()), float(m.std()) + 0.05) if len(m) else (0.0, 1e9))
    return TextModel(languages, log_p, np.array(usual).reshape(-1, 2))


def _likelihoods(model):
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_grams", pa.int64()), ("ll", pa.list_(pa.float64())), ("usual", pa.bool_()), ("letters", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = model.value
        for batch in batches:
            for i, j in bounded_batches(batch.column(2)):
                part = batch.slice(i, j - i)
                cells, at = trigram_cells(*byte_view(part.column(2)))
                means, n = _row_means(cells, at, m.log_p), np.diff(at)
                best = means.argmax(axis=1)
                spread = FAR * m.usual[best, 1] * np.sqrt(1 + 300 / np.maximum(1, n))  # short texts vary more
                near = (n == 0) | (means.max(axis=1) >= m.usual[best, 0] - spread)
                ll = pa.array(list(means * np.minimum(n, EVIDENCE)[:, None]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(n, pa.int64()), ll, pa.array(near), part.column(3), part.column(4), part.column(5)], schema=schema)

    return run, "doc_id bigint, source string, n_grams bigint, ll array<double>, usual boolean, letters boolean, k1 bigint, k2 bigint"


def _fit_language(group: pa.Table) -> pa.Table:
    """One language's column of the model, of a table (lang, text)."""
    lang = group.column(0)[0].as_py()
    own = fit_text_model([(lang, t.as_py()) for t in group.column(1)])
    return pa.table({"lang": pa.array([lang], pa.string()), "log_p": pa.array([own.log_p[:, 0].tobytes()], pa.binary()), "mean": pa.array([own.usual[0, 0]]), "deviation": pa.array([own.usual[0, 1]])})


def train_text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> TextModel:
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 2))
    sizes = known.groupBy(F.col("lang").alias("own_lang")).agg(F.approx_count_distinct("id").alias("n"))
    order = F.xxhash64("id")
    # Half as many again of the smallest hashes as are wanted: the window sees few rows of each language.
    least = F.least(F.lit(1.0), 1.5 * SAMPLE / F.col("n")) * 2.0**64 - 2.0**63
    near = known.select(F.col("id").alias("own_id"), F.col("lang").alias("own_lang"), order.alias("own_hash")).join(F.broadcast(sizes), "own_lang")
    near = near.where(F.col("own_hash").cast("double") <= least).select("own_id", "own_lang", "own_hash").distinct()
    place = F.row_number().over(Window.partitionBy("own_lang").orderBy("own_hash", "own_id"))
    ids = near.withColumn("place", place).where(F.col("place") <= SAMPLE).select("own_id", "own_lang")
    picked = known.join(F.broadcast(ids), (F.col("id") == F.col("own_id")) & (F.col("lang") == F.col("own_lang")))
    fitted = picked.select("lang", "text").groupBy("lang").applyInArrow(_fit_language, "lang string, log_p binary, mean double, deviation double")
    rows = sorted(fitted.collect(), key=lambda r: r.lang)  # one a language
    if not rows:
        return TextModel([], np.zeros((CELLS, 1), dtype=np.float32), np.zeros((0, 2)))
    log_p = np.column_stack([np.frombuffer(bytes(r.log_p), dtype=np.float32) for r in rows])
    return TextModel([r.lang for r in rows], log_p, np.array([(r["mean"], r.deviation) for r in rows]))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, host, declared, page_id, pages, suffix, domain): the pages of each document, known by the number in their
    paths, with the first page_id and the number of those that say the same."""
    host, path = host_and_path(F.col("url"))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    seen = pages.select("page_id", host.alias("host"), F.regexp_extract(path, "^/[^/]*/([0-9]{1,18})", 1).alias("number"), F.nullif(declared, F.lit("")).alias("declared")).where("number <> ''")
    some = seen.groupBy(F.col("number").cast("long").alias("doc_id"), "host", "declared").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))
    suffix, domain = suffix_and_domain(F.col("host"))
    return some.withColumns({"suffix": suffix, "domain": domain})


def _by_language(counts: DataFrame, keys: list[str], languages: int) -> DataFrame:
    """``keys`` and ``c``, the array of counts by language, of (keys, best, n)."""
    grouped = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"))
    c = F.transform(F.sequence(F.lit(0), F.lit(languages - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("double"))
    return grouped.select(*keys, c.alias("c"))


def _given_language(counted: DataFrame, column: str, languages: int) -> tuple[DataFrame, F.Column]:
    """(column, said): the logs of P(value | language) of every value, counted against the text's language; and those of a
    value that no document with a text has."""
    counts = write_out(counted.where(F.col(column).isNotNull()).groupBy(column, "best").agg(F.sum("pages").alias("n")), column)
    total = np.zeros(languages)
    for best, n in counts.groupBy("best").agg(F.sum("n")).collect():  # one number a language
        total[best] = n
    base = np.log(total + counts.select(column).distinct().count() + 1)
    rest = F.array(*map(F.lit, (-base).tolist()))
    said = F.zip_with("c", rest, lambda n, r: F.log(n + 1) + r)
    return write_out(_by_language(counts, [column], languages).select(column, said.alias("said")), column), rest


def row_key(id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[F.Column, F.Column]:
    """Two hashes by which rows of equal id, source and text, which are judged alike, are known again."""
    own = [F.col(c) for c in (id_col, source_col, text_col)]
    return F.xxhash64(*own), F.xxhash64(F.lit(1), *own[::-1])


def identify_languages(docs: DataFrame, pages: DataFrame | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keyed: bool = False) -> DataFrame:
    """(doc_id, language, posterior, text_language, declared, host, kept) for each row; ``keyed``: and its ``row_key``."""
    spark = docs.sparkSession
    model = train_text_model(docs, id_col, text_col, lang_col)
    names = model.languages
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), *(k.alias(n) for k, n in zip(row_key(id_col, source_col, text_col), ("k1", "k2"), strict=True)))
    keys = ["k1", "k2"] if keyed else []
    if not names:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", none.alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"), none.alias("declared"), none.alias("host"), F.lit(False).alias("kept"), *keys)
    scored = rows.mapInArrow(*_likelihoods(shared))
    none = F.lit(None).cast("string")
    if pages is not None:
        pages_of = write_out(page_evidence(pages), "evidence")
        first = pages_of.groupBy("doc_id").agg(F.min(F.struct("page_id", "host", "declared")).alias("p"))
        scored = scored.join(first.select("doc_id", F.lit(True).alias("paged"), "p.host", "p.declared"), "doc_id", "left")
    else:
        scored = scored.withColumns({"paged": F.lit(False), "host": none, "declared": none})
    own = F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))
    best = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    scored = scored.withColumns({"best": best, "paged": F.coalesce("paged", F.lit(False)), "host": F.coalesce("host", own)})
    scored = write_out(scored, "languages")

    n = len(names)
    seen = scored.where("n_grams > 0")
    total = np.zeros(n)
    for k, c in seen.groupBy("best").count().collect():  # one number a language
        total[k] = c
    whole = ((total + 1) / (total.sum() + n)).tolist()
    blend = lambda own, prior, m: F.zip_with(own, prior, lambda c, p: c + m * p)
    share = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda s, y: s + y))
    hosts = seen.where("not paged").groupBy(F.lit("source").alias("domain"), "host", "best").agg(F.count("*").alias("n"))
    if pages is not None:
        counted = write_out(pages_of.join(seen.where("paged").select("doc_id", "best"), "doc_id").select("domain", "host", "suffix", "declared", "pages", "best"), "counted")
        hosts = hosts.unionByName(counted.groupBy("domain", "host", "best").agg(F.sum("pages").alias("n")))
    hosts = write_out(hosts, "hosts")
    domains = _by_language(hosts.groupBy("domain", "best").agg(F.sum("n").alias("n")), ["domain"], n)
    flat = F.array(*map(F.lit, whole))
    domains = domains.select("domain", share(blend(F.col("c"), flat, DOMAIN_WEIGHT)).alias("up"))
    priors = write_out(_by_language(hosts, ["domain", "host"], n).join(domains, "domain").select("domain", "host", share(blend(F.col("c"), F.col("up"), HOST_WEIGHT)).alias("prior")), "priors")

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    sources = priors.where("domain = 'source'").select("host", F.lit(False).alias("paged"), "prior")
    fused = scored.join(sources, ["host", "paged"], "left")
    logs = add(F.col("ll"), F.transform(F.coalesce("prior", flat), lambda p: F.log(p)))
    if pages is not None:
        nothing = F.array(*[F.lit(0.0)] * n)
        says = pages_of.join(priors, ["domain", "host"], "left")
        page = F.zip_with(F.coalesce("prior", flat), flat, lambda p, w: F.log(p / w))
        for column in ("declared", "suffix"):
            table, rest = _given_language(counted, column, n)
            says = says.join(table.withColumnRenamed("said", f"said_{column}"), column, "left")
            page = add(page, F.when(F.col(column).isNull(), nothing).otherwise(F.coalesce(f"said_{column}", rest)))
        says = says.select("doc_id", F.transform(page, lambda x: x * F.col("pages")).alias("said"))
        says = says.groupBy("doc_id").agg(F.aggregate(F.collect_list("said"), nothing, add).alias("said"))
        fused = fused.join(says, "doc_id", "left")
        logs = add(logs, F.coalesce("said", nothing))
    fused = fused.withColumn("logs", logs)
    top = F.array_max("logs")
    fused = fused.withColumn("posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    label = lambda k: F.element_at(F.array(*map(F.lit, names)), k)
    has = F.col("letters")
    language = F.when(has, label(F.array_position("logs", top).cast("int")))
    posterior = F.when(has, F.round("posterior", 6)).otherwise(F.lit(0.0))
    return fused.select("doc_id", language.alias("language"), posterior.alias("posterior"), F.when(F.col("n_grams") > 0, label(F.col("best") + 1)).alias("text_language"), "declared", "host", (has & F.col("usual") & (F.col("posterior") >= least)).alias("kept"), *keys)
