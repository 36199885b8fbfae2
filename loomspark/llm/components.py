"""Connected components of a distributed edge table: local contraction in each partition, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import write_out


def spanning_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of an edge list and the smallest vertex of each one's component."""
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(len(ids))
    x, y = flat[: len(a)], flat[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


#: Edges that are contracted at once, in memory; a graph of no more is left to one task.
HELD = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of edges become the stars of their own components: fewer edges, the same connectivity."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        ids, root = spanning_roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        keep = ids != root
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], names=["v", "u"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > HELD:
            yield stars()
            held = []
    if held:
        yield stars()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no vertex is both a centre and a ray, and each ray has one centre."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("ray"), F.lit(0).alias("centre")).union(edges.select("u", F.lit(0), F.lit(1)))
    odd = ends.groupBy("x").agg(F.sum("ray").alias("rays"), F.max("centre").alias("centre")).where("rays + centre > 1")
    return odd.limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each vertex of ``edges`` (longs): the smallest vertex that it reaches.

    Edges are (v, u) with v > u. Large star: each vertex hands its larger neighbours its smallest neighbour; small star:
    each vertex hands its smaller neighbours, and itself, the smallest. Both keep connectivity; at the fixed point every
    vertex points at its component's smallest. A vertex's minimum is a partial aggregate and the join that follows can be
    split, so that a star with very many rays does not meet in one task. Once no more than ``HELD`` edges are left, one
    task contracts them.
    """
    flat = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    contracted = flat.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).mapInArrow(_contract, "v bigint, u bigint")
    stars = write_out(contracted.distinct(), "stars")
    while True:
        if stars.count() <= HELD:
            stars = write_out(stars.coalesce(1).mapInArrow(_contract, "v bigint, u bigint"), "stars")
            break
        if _are_stars(stars):
            break
        both = stars.select(F.col("v").alias("x"), F.col("u").alias("y")).union(stars.select("u", "v"))
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").mapInArrow(_contract, "v bigint, u bigint")
        large = write_out(large.distinct(), "stars")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", "m"))
        stars = write_out(small.distinct().mapInArrow(_contract, "v bigint, u bigint").distinct(), "stars")
    return stars.select(F.col("v").alias("id"), F.col("u").alias("component")).union(stars.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
