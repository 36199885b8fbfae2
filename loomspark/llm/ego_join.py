"""Operator 4: cosine near-duplicates of vectors by an epsilon grid order join.

For unit vectors a cosine of at least ``c`` is a distance of at most ``eps = sqrt(2 - 2c)``. Vectors are projected on the
``DIRECTIONS`` leading principal directions of all of them (an orthonormal basis); the length of what is left outside is
one more coordinate, and distances between such points never exceed those between the vectors. Vectors get the grid
cells of side ``eps`` in the first ``GRID`` directions and are sorted by those cells (the epsilon grid order). The sorted
sequence is cut into blocks of at most ``BLOCK`` vectors, where the leading cells change if a quarter is full, with their
bounding boxes. Intervals of the sequence are joined recursively, from all of it down to blocks, ``FAN`` bits of children
at a time by equi-joins on the parents: a pair of intervals whose boxes are further apart than ``eps`` is dropped with all
that lies below. A pair of blocks that is left meets in one task, where runs of ``LEAF`` points are compared if their boxes
allow a link, and the vectors themselves, in double precision, of the pairs of points that are near enough. Each such task gives numbers of links and a spanning forest, never the pairs, so
that a large group of near copies costs rows in proportion to its blocks.

How much is skipped depends on the data: groups of near vectors are told apart, and work grows with their number. Of
vectors spread evenly over 64 directions nearly all pairs of blocks meet, though few pairs of points in them are near.

Equal vectors are joined first and stand as one with their number. Vectors that are null, zero or hold null or
non-finite components link with nothing, nor do rows with a null id (component null); vectors of different lengths are not
compared. Vectors of floats are stored as such, all others as doubles. Repeated rows count as vectors of their own; extra
columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import write_out
from loomspark.llm.components import connected_components, spanning_roots

DIRECTIONS = 16
GRID = 8
BLOCK = 4096
FAN = 6  # bits: 64 children an interval
LEAF = 64


def _matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is first scaled by a power of two (exact) to components of at most 1, so that no square over- or underflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, v) of a task's sums: of x_i * x_j, of x_i with j = -1, of 1 with i = -1."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = unit(_matrix(batch.column(0)))
            x = np.column_stack((x, np.ones(len(x))))
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        d = len(total)
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])


def principal_directions(unique: DataFrame, length: int, k: int = DIRECTIONS) -> np.ndarray:
    """The ``k`` leading eigenvectors of the covariance of the normalised vectors: a (length, k) matrix."""
    sums = unique.select("embedding").mapInArrow(_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    m = np.zeros((length + 1, length + 1))
    for i, j, v in sums.collect():  # (length + 1)^2 sums, whatever the number of vectors
        m[i, j] = v
    n = max(1.0, m[length, length])
    mean = m[:length, length] / n
    values, vectors = np.linalg.eigh(m[:length, :length] / n - np.outer(mean, mean))
    return np.ascontiguousarray(vectors[:, np.argsort(-values)[: min(k, length)]])


def _points(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Coordinates of the unit vectors of x in the basis u, and the length of what lies outside of it."""
    p = unit(x) @ u
    return np.column_stack((p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))))


def _cells(basis, eps: float, k: int, vector_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = basis.value
        for batch in batches:
            if batch.num_rows:
                cell = np.floor(_points(_matrix(batch.column(1)), u)[:, :k] / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(cell[:, i]) for i in range(k))], names=["id", "embedding", "copies", *(f"c{i}" for i in range(k))])

    return run, f"id bigint, embedding {vector_type}, copies bigint, " + ", ".join(f"c{i} int" for i in range(k))


def _blocks(basis, dtype):
    """Sorted rows of a partition to blocks: (part, block, ids, copies, vectors, lo, hi)."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("vectors", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        u, part, at = basis.value, TaskContext.get().partitionId(), 0
        held = None

        def cut(rows: pa.Table) -> int:
            """Where the block that starts these rows ends: the last change of a leading cell beyond a quarter, the earliest column first."""
            for c in range(3, rows.num_columns):
                cells = rows.column(c).slice(0, BLOCK + 1).to_numpy()
                ends = np.flatnonzero(cells[1:] != cells[:-1]) + 1
                ends = ends[ends >= BLOCK // 4]
                if len(ends):
                    return int(ends[-1])
            return BLOCK

        def block(rows: pa.Table):
            x = _matrix(rows.column("embedding").combine_chunks())
            p = _points(x, u)
            cols = [[part], [at], [rows.column("id").to_numpy()], [rows.column("copies").to_numpy()], [x.astype(dtype).tobytes()], [p.min(axis=0)], [p.max(axis=0)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
            while held.num_rows > BLOCK:
                n = cut(held)
                yield block(held.slice(0, n))
                held, at = held.slice(n), at + 1
        if held is not None and held.num_rows:
            yield block(held)

    return run, "part bigint, block bigint, ids array<bigint>, copies array<bigint>, vectors binary, lo array<double>, hi array<double>"


def _leaves(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of the runs of ``LEAF`` points."""
    at = np.arange(0, len(p), LEAF)
    return np.minimum.reduceat(p, at, axis=0), np.maximum.reduceat(p, at, axis=0)


def close_pairs(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, eps: float, least: float, same: bool):
    """Index pairs of rows of x and y (points p and q) with a cosine of at least ``least``, a run of ``LEAF`` rows of x at a time.

    Runs of y whose boxes are further away than ``eps`` are skipped. Points have length 1, so that their inner product is
    never below the vectors' cosine: vectors are compared only where it reaches ``least``. ``same``: x is y, and each pair
    is given once, without a row and itself.
    """
    x, y = unit(x), unit(y)
    (lo_p, hi_p), (lo_q, hi_q) = _leaves(p), _leaves(q)
    for a in range(len(lo_p)):
        gap = np.maximum(0, np.maximum(lo_p[a] - hi_q, lo_q - hi_p[a]))
        near = np.flatnonzero((gap * gap).sum(axis=1) <= eps * eps)
        if same:
            near = near[near >= a]
        if not len(near):
            continue
        rows = (near[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = rows[rows < len(y)]
        i, j = np.nonzero(p[a * LEAF : (a + 1) * LEAF] @ q[rows].T >= least - 1e-7)
        i, j = i + a * LEAF, rows[j]
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):  # at most so many rows are laid out at once
            part = slice(at, at + (1 << 16))
            near = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= least
            i[part], j[part] = np.where(near, i[part], -1), j[part]
        i, j = i[i >= 0], j[i >= 0]
        if len(i):
            yield i, j


def _compare(basis, eps: float, least: float, length: int, dtype):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = basis.value
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch.column(0)[r].as_py()
                ids_a, ids_b = (np.asarray(batch.column(i)[r].values) for i in (1, 4))
                n_a, n_b = (np.asarray(batch.column(i)[r].values) for i in (2, 5))
                x, y = (np.frombuffer(batch.column(i)[r].as_buffer(), dtype=dtype).reshape(-1, length).astype(np.float64) for i in (3, 6))
                links_a, links_b = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
                forest: list[tuple[np.ndarray, np.ndarray]] = []
                for i, j in close_pairs(x, _points(x, u), y, _points(y, u), eps, least, same):
                    np.add.at(links_a, i, n_b[j])
                    np.add.at(links_b, j, n_a[i])
                    v, w = spanning_roots(ids_a[i], ids_b[j])
                    forest.append((v[v != w], w[v != w]))
                if not forest:
                    continue
                ids, root = spanning_roots(*(np.concatenate(z) for z in zip(*forest, strict=True)))
                of = dict(zip(ids.tolist(), root.tolist(), strict=True))
                both = [(ids_a, links_a + links_b)] if same else [(ids_a, links_a), (ids_b, links_b)]
                v = np.concatenate([z[n > 0] for z, n in both])
                n = np.concatenate([n[n > 0] for _, n in both])
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n), pa.array([of.get(z, z) for z in v.tolist()], pa.int64())], schema=schema)

    return run, "id bigint, links bigint, root bigint"


def _near(a: str, b: str, eps: float):
    gaps = F.zip_with(F.zip_with(f"lo_{a}", f"hi_{b}", lambda x, y: x - y), F.zip_with(f"lo_{b}", f"hi_{a}", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps


def block_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """(a, b) with a <= b for all blocks whose boxes are within ``eps``: the recursion over intervals, level by level."""
    top, dims = boxes.agg(F.max("seq"), F.max(F.size("lo"))).first()
    levels = max(1, -(-int(top or 0).bit_length() // FAN))
    pairs = None
    for level in reversed(range(levels)):
        bits = FAN * level
        name = F.shiftright("seq", bits)
        if bits:
            at = lambda agg, c: F.array(*(agg(F.col(c)[i]) for i in range(dims or 1)))
            spans = boxes.groupBy(name.alias("node")).agg(at(F.min, "lo").alias("lo"), at(F.max, "hi").alias("hi"))
        else:
            spans = boxes.select(F.col("seq").alias("node"), "lo", "hi")
        spans = spans.withColumn("up", F.shiftright("node", FAN))
        left = spans.select(F.col("node").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("up").alias("up_a"))
        right = spans.select(F.col("node").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("up").alias("up_b"))
        if pairs is None:
            both = left.join(right, F.col("up_a") == F.col("up_b"))  # one root: at most 2^FAN nodes a side
        else:
            both = pairs.join(left, F.col("pa") == F.col("up_a")).join(right, F.col("pb") == F.col("up_b"))
        pairs = both.where("a <= b").where(_near("a", "b", eps)).select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    return pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def grid_blocks(unique: DataFrame, length: int, least: float) -> tuple[DataFrame, DataFrame, object, float]:
    """The blocks of the sorted vectors (id, embedding, copies), the pairs of blocks to compare, the basis, and eps."""
    spark = unique.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-7)
    basis = principal_directions(unique, length)
    k = min(GRID, basis.shape[1])
    shared = spark.sparkContext.broadcast(basis)
    order = [*(f"c{i}" for i in range(k)), "id"]
    placed = unique.select("id", "embedding", "copies").mapInArrow(*_cells(shared, eps, k, unique.schema["embedding"].dataType.simpleString()))
    blocks = write_out(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(*_blocks(shared, _dtype(unique))), "blocks")
    widest = blocks.agg(F.max("block")).first()[0]
    bits = max(1, int(widest or 0).bit_length())
    blocks = blocks.withColumn("seq", F.shiftleft(F.col("part"), bits) + F.col("block"))
    return blocks, write_out(block_pairs(blocks.select("seq", "lo", "hi"), eps), "pairs"), shared, eps


def _dtype(vectors: DataFrame):
    return np.float64 if vectors.schema["embedding"].dataType.elementType.simpleString() == "double" else np.float32


def _join_length(unique: DataFrame, length: int, least: float) -> DataFrame:
    """(id, links, root) parts for the distinct vectors of one length."""
    blocks, pairs, shared, eps = grid_blocks(unique, length, least)
    side = lambda s: blocks.select(F.col("seq").alias(s), F.col("ids").alias(f"ids_{s}"), F.col("copies").alias(f"n_{s}"), F.col("vectors").alias(f"x_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = both.select((F.col("a") == F.col("b")).alias("same"), "ids_a", "n_a", "x_a", "ids_b", "n_b", "x_b")
    return rows.mapInArrow(*_compare(shared, eps, least, length, _dtype(unique)))


def cosine_components(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if element == "float" else "array<double>").alias("embedding"))
    fit = F.expr("id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(embedding, x -> x <> 0)")
    keyed = rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("h1", F.when(F.col("fit"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("fit"), F.xxhash64(F.lit(1), "embedding")))
    classes = keyed.where("fit").groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    unique = write_out(classes.withColumn("id", F.col("class_id")), "vectors")
    lengths = [r[0] for r in unique.select(F.size("embedding").alias("n")).distinct().collect()]  # usually one
    parts = None
    for n in sorted(lengths):
        own = _join_length(unique.where(F.size("embedding") == n), n, least)
        parts = own if parts is None else parts.union(own)
    if parts is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    parts = write_out(parts, "links")
    links = parts.groupBy("id").agg(F.sum("links").alias("links"))
    comp = connected_components(parts.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = unique.select("h1", "h2", "class_id", "copies").join(links.withColumnRenamed("id", "class_id"), "class_id", "left").join(comp.withColumnRenamed("id", "class_id"), "class_id", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "class_id").alias("component"))
    out = keyed.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
