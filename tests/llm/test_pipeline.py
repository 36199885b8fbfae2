"""The pipeline's stages, each over what its predecessor kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm.common import read_table, write_out
from loomspark.llm.shingle_join import shingle_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = write_out(stage(spark, docs, SF), "test")
        seen[name] = out
        if name != "packing":
            assert out.columns == columns
        docs = out
    all_ids = {r.doc_id for r in read_table(spark, SF, "documents").select("doc_id").collect()}
    known = {r.doc_id: r for r in seen["language_id"].collect()}
    assert len(known) >= 0.95 * len(all_ids)
    alone = seen["near_duplicates"]
    assert all(r.component_id == r.doc_id for r in shingle_components(alone, 5, 80).collect())
    groups = {r.doc_id: r.component_id for r in shingle_components(seen["language_id"], 5, 80).collect()}
    assert {r.doc_id for r in alone.collect()} == set(groups.values())
    replaced = {r.doc_id: r for r in seen["surrogates"].collect()}
    assert replaced.keys() == {r.doc_id for r in alone.collect()} and all(r.n_chars == len(r.text) for r in replaced.values())
    mixed = Counter(r.doc_id for r in seen["mixing"].collect())
    packed = Counter(r.doc_id for r in seen["packing"].where("piece = 0").collect())
    assert mixed == packed


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, ties and clashing columns; and empty tables."""
    base = [(i, f"{w} " * 40, "en", "s", 1) for i, w in enumerate(("alpha beta gamma", "delta epsilon zeta", "theta iota kappa"))]
    rows = [*base, (None, "no id at all in here", "en", "s", 1), (None, None, None, None, None), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, "long words here " * 50_000, "en", "s", 1)]
    rows += [(0, base[0][1], "en", "s", 1), (6, base[1][1], "en", "s", 1), (1, "123 456", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("found", "own_id", "u", "count", "row", "kept", "k1", "language", "n")})
    spark.createDataFrame([(1, "http://x.org/en/0", "<html lang=en>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    by = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    known = by["language_id"](spark, docs, str(tmp_path))
    assert known.columns == docs.columns and ids(known) == [0, 0, 1, 2, 5, 6, None]  # without letters: rejected by row, not by id
    alone = by["near_duplicates"](spark, docs, str(tmp_path))
    assert alone.columns == docs.columns and ids(alone) == [0, 1, 2, 3, 4, 5, None, None]
    for name in ("surrogates", "mixing"):
        out = by[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and ids(out) == ids(docs)
    packed = by["packing"](spark, docs, str(tmp_path)).where("piece = 0")
    assert ids(packed) == ids(docs)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
