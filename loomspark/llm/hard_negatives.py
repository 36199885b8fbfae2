"""Operator 13: hard negatives from Hilbert-ordered blocks with zone maps.

Components become integers (floor of 256 x), a score is an exact integer inner product. All rows are sorted by label and by
the Hilbert curve through ``DIMENSIONS`` principal directions and cut into Parquet blocks of ``BLOCK`` rows. A block's zone
map holds the least and greatest value of each component, of each principal coordinate, and of the label. Interval
arithmetic on the zone map bounds the scores that an anchor can have with a block's rows:

1. each anchor is compared with the rows of its own block; the last of its best positives bounds what it still needs;
2. blocks with its label whose upper bound reaches that are read, and no others;
3. for its negatives, the block with the greatest upper bound is read first; the windows of scores that its positives
   allow are narrowed by what is found;
4. blocks with other labels whose bounds meet a narrowed window are read.

The anchors (a stated set) of a block travel together; zone maps are met in chunks of ``CHUNK``. Tasks hand on the best
rows of each window only. How much is skipped depends on the data: of vectors spread evenly over many directions nearly all
blocks are read; results are exact in any case.

Rows with a null id, label or vector, or with a component that is null, not finite, or too large to be a number after
multiplication take no part. Vectors are compared with those of equal length; empty ones have score 0. Rows that repeat an
id stand for themselves; of equal scores the smaller id comes first. Scores beyond a long are given as the nearest long.
Extra columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import write_out

BLOCK = 2048
CHUNK = 256
DIMENSIONS = 6
BITS = 5
#: Entries of best rows that a task holds.
HELD = 200_000
EXACT = 2.0**53
LONG = 2**63 - 1

_ANCHORS = "array<struct<ak:bigint,anchor_id:bigint,label:bigint,q:binary,windows:array<struct<w:bigint,lo:bigint,hi:bigint>>>>"


def quantised(rows: DataFrame, anchor: Column, id_col: str, label_col: str | Column, vector_col: str) -> DataFrame:
    """(id, label, anchor, q) of the rows that take part."""
    q = F.transform(F.col(f"`{vector_col}`"), lambda x: F.lit(256.0) * x.cast("double"))
    label = F.col(f"`{label_col}`") if isinstance(label_col, str) else label_col
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), q.alias("q"))
    fit = own.where("id is not null and label is not null and forall(q, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    # An empty vector is a single zero in a group of its own.
    return fit.withColumn("length", F.size("q")).withColumn("q", F.expr("if(size(q) = 0, array(0d), transform(q, x -> if(abs(x) < 9e15, cast(floor(x) as double), x)))"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = np.column_stack((np.clip(_matrix(batch.column(0)), -(2.0**20), 2.0**20), np.ones(batch.num_rows)))
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        i, j = np.divmod(np.arange(total.size), len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])


def principal_axes(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, orthonormal axes (d, d) by falling variance, and deviations, of all rows."""
    m = np.zeros((d + 1, d + 1))
    for i, j, v in rows.select("q").mapInArrow(_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (d + 1)^2 sums
        m[i, j] = v
    n = max(1.0, m[d, d])
    mean = m[:d, d] / n
    values, axes = np.linalg.eigh(m[:d, :d] / n - np.outer(mean, mean))
    order = np.argsort(-values)
    return mean, np.ascontiguousarray(axes[:, order]), np.sqrt(np.maximum(values[order], 1e-12))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2^bits: axes to transposed index, then interleaved."""
    x = cells.T.astype(np.int64).copy()
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inside, q - 1, 0) ^ swap
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & q, q - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = out << 1 | (row >> b & 1)
    return out


def _curve(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes, spread = shared.value
        k = min(DIMENSIONS, len(mean))
        for batch in batches:
            if batch.num_rows:
                y = (np.clip(_matrix(batch.column(3)), -(2.0**20), 2.0**20) - mean) @ axes[:, :k] / spread[:k]
                cells = np.clip((y + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hilbert_index(cells, BITS))], names=["id", "label", "anchor", "q", "h"])

    return run, "id bigint, label bigint, anchor boolean, q array<double>, h bigint"


def _blocks(shared):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("anchors", pa.list_(pa.int32())), ("vectors", pa.binary()), ("zone", pa.binary()), ("label_lo", pa.int64()), ("label_hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        axes, part, at, held = shared.value[1], TaskContext.get().partitionId(), 0, None

        def block(rows: pa.Table) -> pa.RecordBatch:
            x, labels = _matrix(rows.column("q").combine_chunks()), rows.column("label").to_numpy()
            with np.errstate(all="ignore"):
                y = x @ axes
            zone = np.concatenate((x.min(axis=0), x.max(axis=0), y.min(axis=0), y.max(axis=0)))
            cols = [[part << 32 | at], [rows.column("id").to_numpy()], [labels], [np.flatnonzero(rows.column("anchor").to_numpy()).astype(np.int32)], [x.tobytes()], [zone.tobytes()], [labels.min()], [labels.max()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
            while held.num_rows >= BLOCK:
                yield block(held.slice(0, BLOCK))
                held, at = held.slice(BLOCK), at + 1
        if held is not None and held.num_rows:
            yield block(held)

    return run, "block bigint, ids array<bigint>, labels array<bigint>, anchors array<int>, vectors binary, zone binary, label_lo bigint, label_hi bigint"


def inner_products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as longs; where doubles would round, by Python's integers."""
    if np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1] < EXACT:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object)
    return np.clip(whole(a) @ whole(x).T, -LONG - 1, LONG).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best: greatest scores, of equal ones the smallest ids."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]] if len(at) else at


class _Best:
    """The k best rows of each (anchor, window) that a task has met, handed on when too many are held."""

    SCHEMA = "ak bigint, w bigint, id bigint, score bigint"

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, key: tuple[int, int], ids: np.ndarray, scores: np.ndarray) -> None:
        if key in self.rows:
            ids, scores = (np.concatenate(z) for z in zip(self.rows[key], (ids, scores), strict=True))
        at = _best(ids, scores, self.k)
        self.rows[key] = ids[at], scores[at]

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) * self.k >= least:
            n = [len(ids) for ids, _ in self.rows.values()]
            keys = np.repeat(np.array(list(self.rows), dtype=np.int64), n, axis=0)
            ids, scores = (np.concatenate(z) for z in zip(*self.rows.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[:, 0], keys[:, 1], ids, scores)], names=["ak", "w", "id", "score"])
            self.rows = {}


def _own_block(k: int, d: int):
    """Step 1: anchors with their best positives in their own block."""
    names = ["block", "ak", "anchor_id", "label", "q", "ids", "scores"]
    types = [*[pa.int64()] * 4, pa.binary(), *[pa.list_(pa.int64())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in range(batch.num_rows):
                block = batch.column(0)[r].as_py()
                ids, labels, slots = (np.asarray(batch.column(i)[r].values) for i in (1, 2, 3))
                x = np.frombuffer(batch.column(4)[r].as_buffer()).reshape(-1, d)
                for slot, scores in zip(slots.tolist(), inner_products(x[slots], x), strict=True):
                    ok = labels == labels[slot]
                    ok[slot] = False
                    ok = np.flatnonzero(ok)
                    ok = ok[_best(ids[ok], scores[ok], k)]
                    for c, v in zip(out, (block, block << 11 | slot, ids[slot], labels[slot], x[slot].tobytes(), ids[ok], scores[ok]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run, "block bigint, ak bigint, anchor_id bigint, label bigint, q binary, ids array<bigint>, scores array<bigint>"


def score_bounds(a: np.ndarray, zones: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each row of ``a`` with each block, by its zone map (n, 4 d)."""
    d = a.shape[1]
    low, high = np.full((len(a), len(zones)), -np.inf), np.full((len(a), len(zones)), np.inf)
    with np.errstate(all="ignore"):
        for own, lo, hi in ((a, zones[:, :d], zones[:, d : 2 * d]), (a @ axes, zones[:, 2 * d : 3 * d], zones[:, 3 * d :])):
            up, down = np.maximum(own, 0), np.minimum(own, 0)
            slack = np.abs(own) @ np.maximum(np.abs(lo), np.abs(hi)).T * 1e-9 + 1e-6
            low = np.fmax(low, up @ lo.T + down @ hi.T - slack)
            high = np.fmin(high, up @ hi.T + down @ lo.T + slack)
    return low, high


def _needed(shared, same: bool, first: bool, d: int):
    """Groups of anchors and chunks of zone maps to (block, anchors that must read it); ``first``: the most promising block only, as (ak, block, bound)."""
    kind = pa.list_(pa.struct([("ak", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("q", pa.binary()), ("windows", pa.list_(pa.struct([("w", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value[1]
        for batch in batches:
            for r in range(batch.num_rows):
                skip, anchors = batch.column(0)[r].as_py(), batch.column(1)[r].values
                maps = batch.column(2)[r].values
                blocks, lo_label, hi_label = (maps.field(n).to_numpy() for n in ("block", "label_lo", "label_hi"))
                zones = np.frombuffer(b"".join(maps.field("zone").to_pylist())).reshape(len(blocks), -1)
                a = np.frombuffer(b"".join(anchors.field("q").to_pylist())).reshape(-1, d)
                label = anchors.field("label").to_numpy()[:, None]
                low, high = score_bounds(a, zones, axes)
                fits = (lo_label <= label) & (label <= hi_label) & (blocks != skip) if same else (lo_label != label) | (hi_label != label)
                if first:
                    bound = np.where(fits, high, -np.inf)
                    best = bound.argmax(axis=1)
                    own = np.flatnonzero(fits.any(axis=1))
                    yield pa.RecordBatch.from_arrays([anchors.field("ak").take(pa.array(own)), pa.array(blocks[best[own]]), pa.array(bound[own, best[own]])], names=["ak", "block", "bound"])
                    continue
                need = np.zeros(fits.shape, dtype=bool)
                for i, windows in enumerate(anchors.field("windows").to_pylist()):
                    for w in windows or ():
                        need[i] |= (high[i] >= w["lo"]) & (low[i] <= w["hi"])
                need &= fits
                hit = np.flatnonzero(need.any(axis=0))
                if len(hit):
                    own = [anchors.take(pa.array(np.flatnonzero(need[:, b]))) for b in hit]
                    offsets = np.concatenate(([0], np.cumsum([len(o) for o in own])))
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[hit]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(own)).cast(kind)], names=["block", "anchors"])

    return run, "ak bigint, block bigint, bound double" if first else f"block bigint, anchors {_ANCHORS}"


def _read(same: bool, k: int, d: int):
    """Blocks with the anchors that must read them to the best rows of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, labels = (np.asarray(batch.column(i)[r].values) for i in (2, 3))
                x = np.frombuffer(batch.column(4)[r].as_buffer()).reshape(-1, d)
                anchors = batch.column(1)[r].as_py()
                scores = inner_products(np.frombuffer(b"".join(a["q"] for a in anchors)).reshape(-1, d), x)
                for a, s in zip(anchors, scores, strict=True):
                    ok = np.flatnonzero((labels == a["label"]) == same)
                    for w in a["windows"] or ():
                        hit = ok[(s[ok] >= w["lo"]) & (s[ok] <= w["hi"])]
                        if len(hit):
                            best.add((a["ak"], w["w"]), ids[hit], s[hit])
            yield from best.flush(HELD)
        yield from best.flush(0)

    return run, _Best.SCHEMA


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each (ak, w) with their rank."""
    order = Window.partitionBy("ak", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _percent(score: str, percent: int, up: bool) -> str:
    """A score's percentage, rounded to a whole number without leaving the longs."""
    return f"({score} div 100) * {percent} + (({score} % 100) * {percent}{' + 99' if up else ''}) div 100"


def _mine(rows: DataFrame, d: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(principal_axes(rows, d))
    order = ["label", "h", "id"]
    placed = rows.select("id", "label", "anchor", "q").mapInArrow(*_curve(shared))
    blocks = write_out(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(*_blocks(shared)), "blocks")
    n_chunks = -(-blocks.count() // CHUNK)
    chunk = F.pmod(F.xxhash64("block"), F.lit(n_chunks)).alias("chunk")
    chunks = write_out(blocks.groupBy(chunk).agg(F.collect_list(F.struct("block", "zone", "label_lo", "label_hi")).alias("zones")), "zones")
    data = blocks.select("block", "ids", "labels", "vectors")

    def groups(anchors: DataFrame) -> DataFrame:
        """Anchors of a block (at most ``BLOCK``) in one row, once for each chunk of zone maps."""
        met = anchors.groupBy("block").agg(F.collect_list(F.struct("ak", "anchor_id", "label", "q", "windows")).alias("anchors"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))).alias("chunk")
        return met.select("block", "anchors", every).join(chunks, "chunk").select("block", "anchors", "zones")

    def read(needed: DataFrame, same: bool, k: int) -> DataFrame:
        return needed.join(data, "block").select("block", "anchors", "ids", "labels", "vectors").mapInArrow(*_read(same, k, d))

    own = write_out(blocks.select("block", "ids", "labels", "anchors", "vectors").mapInArrow(*_own_block(positives, d)), "anchors")
    least = F.when(F.size("scores") >= positives, F.array_min("scores")).otherwise(F.lit(-LONG - 1))
    window = F.struct(F.lit(0).cast("long").alias("w"), least.cast("long").alias("lo"), F.lit(LONG).alias("hi"))
    needed = groups(own.withColumn("windows", F.array(window))).mapInArrow(*_needed(shared, True, False, d))
    found = own.select("ak", F.lit(0).cast("long").alias("w"), F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("ak", "w", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    best = write_out(_top(found.unionByName(read(needed, True, positives)), positives).select("ak", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = best.where("positive_score >= 0").select("ak", "positive_score").distinct().withColumns({"lo": F.expr(_percent("positive_score", low, True)), "hi": F.expr(_percent("positive_score", high, False))})
    anchors = own.select("block", "ak", "anchor_id", "label", "q")

    def with_windows(bounds: DataFrame) -> DataFrame:
        return anchors.join(bounds.groupBy("ak").agg(F.collect_list(F.struct(F.col("positive_score").alias("w"), "lo", "hi")).alias("windows")), "ak")

    asked = with_windows(windows)
    promising = groups(asked).mapInArrow(*_needed(shared, False, True, d)).groupBy("ak").agg(F.max_by("block", "bound").alias("first"))
    promising = write_out(promising, "first")
    probes = asked.join(promising, "ak").groupBy(F.col("first").alias("block"), F.col("block").alias("home")).agg(F.collect_list(F.struct("ak", "anchor_id", "label", "q", "windows")).alias("anchors"))
    probed = write_out(_top(read(probes.select("block", "anchors"), False, negatives), negatives), "probed")
    # A window that has all its rows needs only what is as good as its last.
    last = probed.groupBy("ak", "w").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") >= negatives).select("ak", F.col("w").alias("positive_score"), "last")
    narrowed = windows.join(last, ["ak", "positive_score"], "left").withColumn("lo", F.coalesce("last", "lo"))
    # The first block is read again with the others, by the windows that still need it.
    needed = groups(with_windows(narrowed)).mapInArrow(*_needed(shared, False, False, d))
    hard = _top(read(needed, False, negatives), negatives).select("ak", F.col("w").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(own.select("ak", "anchor_id"), "ak").join(hard, ["ak", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", label: str | Column = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor its ``positives`` best other rows of its label, and for each of these the ``negatives`` best rows of
    other labels whose score is between ``low`` and ``high`` per cent of the positive's.
    """
    taken = write_out(quantised(rows, anchor, id_col, label, vector_col), "quantised")
    out = None
    for n in sorted(r[0] for r in taken.select("length").distinct().collect()):  # lengths of vectors, usually one
        own = _mine(taken.where(F.col("length") == n), max(1, n), positives, negatives, low, high)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def relabelled(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The label, moved on by one (of ten) where 7 divides the id."""
    label = F.col(label_col)
    return F.when(F.col(id_col) % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
