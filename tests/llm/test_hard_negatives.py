"""Operator 13 against all pairs in plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import hard_negatives

ROWS = "vec_id long, embedding array<double>, label int"


def brute(rows, every=3):
    fit = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) or not math.isfinite(256 * v) for v in x):
            continue
        fit.append((i, [math.floor(256 * v) for v in x], label))
    out = []
    for k, (i, q, label) in enumerate(fit):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, m == label) for n, (j, p, m) in enumerate(fit) if n != k and len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2]][:5]:
            fits = [(-t, n) for t, n, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r + 1, n, min(-s, 2**63 - 1), t) for r, (t, n) in enumerate(fits[:3])]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def mined(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("q", F.lit(1)).withColumn("block", F.lit("x"))
    return collected(hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 3 == 0))


def random_rows(n, d, labels, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    return [(i, [float(v) for v in centres[i % labels] * 0.3 + rng.normal(size=d) * spread], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("block", "chunk"), [(2048, 256), (16, 2)])
def test_equals_all_pairs(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "HELD", 20)
    rows = random_rows(160, 5, 3, 1)
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0, 0.0], i % 3) for i in range(9)]  # ties
    rows += [(3, rows[3][1], rows[3][2]), (900, [0.0] * 5, 1), (903, [-1.0] * 5, 2)]  # a repeated id, a zero vector, negative scores
    rows += [(None, [1.0] * 5, 1), (906, None, 1), (909, [1.0] * 5, None), (912, [1.0, None, 1.0, 1.0, 1.0], 1), (915, [1.0, float("nan"), 1.0, 1.0, 1.0], 1)]
    rows += [(918 + i, [1.0 + i, 2.0], i % 2) for i in range(8)] + [(930 + i, [], i % 2) for i in range(4)]  # other lengths
    assert mined(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [float(3**i), 1.0 - i, 2.0**40 + i], i % 2) for i in range(14)]
    assert mined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_blocks_out_of_reach_are_not_read():
    """Bounds hold for every pair, and far clusters are told apart."""
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    blocks = [rng.normal(size=(50, 8)) * 4 + centre for centre in (np.full(8, 300.0), np.full(8, -300.0))]
    zones = np.array([np.concatenate((x.min(0), x.max(0), (x @ axes).min(0), (x @ axes).max(0))) for x in blocks])
    a = blocks[0][:5]
    low, high = hard_negatives.score_bounds(a, zones, axes)
    for j, x in enumerate(blocks):
        s = a @ x.T
        assert (low[:, j] <= s.min(1)).all() and (high[:, j] >= s.max(1)).all()
    assert (high[:, 1] < low[:, 0]).all()


def test_hilbert_curve_visits_every_cell_and_moves_one_step():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    h = hard_negatives.hilbert_index(cells, 3)
    assert sorted(h) == list(range(512))
    path = cells[np.argsort(h)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_labels_move_on(spark):
    rows = spark.createDataFrame([(7, 9), (8, 9), (14, 3), (21, None)], "vec_id long, label int")
    assert [r[0] for r in rows.select(hard_negatives.relabelled()).collect()] == [0, 9, 4, None]


def test_random_tables(spark):
    rng = random.Random(9)
    for seed in range(2):
        rows = random_rows(90, rng.choice([1, 3]), rng.choice([1, 2, 4]), seed)
        assert mined(spark, rows) == brute(rows)
