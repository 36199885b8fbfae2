"""Operator 11 against a Merkle tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomspark.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    """Levels from the leaves to the single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        run = i - i % 3
        out.append((level[run:i], level[i + 1 : run + 3]))
        i //= 3
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    upper = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = way(trees[s], i) + way(upper, k)
            node = leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = leaf((*r[:4], r[4].replace("\n", "")))
            for a, b in steps:
                node = sha([*a, node, *b])
            root = upper[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, sha(h for a, b in steps for h in (*a, *b)), node, node == root))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(kind):
    rng = random.Random(kind)
    text = lambda: rng.choice([None, "", "a", "x\ny", "é\n\n" * 3, "long " * 2000])
    if kind == "plain":
        ids = rng.sample(range(-200, 5000), 700)
        return [(i, rng.choice([None, "", "a", "b", "zz", "é", "hot", "hot", "hot"]), rng.choice([None, "en"]), rng.choice([None, 7]), text()) for i in ids]
    if kind == "repeats":
        rows = [(rng.choice([None, 1, 2, 64, 65, 130, 2**62, -(2**62)]), rng.choice([None, "a"]), None, 1, text()) for _ in range(300)]
        return rows + [(5, "a", None, 1, "same\n")] * 120
    if kind == "powers":  # sources of exactly one slot array, one more, one less, a single leaf
        return [(i, s, "en", i, f"{i}\n{s}") for s, n in (("one", 1), ("run", 3), ("less", 80), ("full", 81), ("more", 82), ("square", 6561), ("next", 6562)) for i in range(n)]
    return []


@pytest.mark.parametrize("kind", ["plain", "repeats", "powers", "empty"])
def test_manifest_equals_brute_force(spark, kind):
    rows = rows_of(kind)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert collected(merkle.merkle_manifest(docs, merkle.tampered_text())) == brute(rows)


def test_copies_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 7)
    rows = rows_of("repeats")
    assert collected(merkle.merkle_manifest(spark.createDataFrame(rows, DOCS), merkle.tampered_text())) == brute(rows)


def test_siblings_fold_to_the_root_and_tampering_shows(spark):
    rows = [(i, f"s{i % 4}", "en", 3, f"t{i}\n") for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("root", F.lit("x")).withColumn("pos", F.lit(2))
    got = merkle.merkle_manifest(docs, F.when(F.col("doc_id") == 77, F.lit("other")), full=True)
    for r in got.collect():
        assert hashlib.sha256("".join(r["siblings"]).encode()).hexdigest() == r["proof_sha256"]
        assert r["verified"] == (r["doc_id"] != 77) == (r["folded_root"] == r["root"])


def test_ids_are_ranked_without_a_window_over_a_source(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    words = merkle.popcount_directory(merkle.id_bitmaps(merkle.manifest_rows(docs)))
    assert [r["base"] for r in words.orderBy("word").collect()] == list(range(0, 3000, 64))
